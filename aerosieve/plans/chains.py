"""The three station chains, each one lazy plan from landed rows to its station-day table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import local_clock
from ..operators import fusion, geo, qc, temporal


@dataclass(frozen=True)
class GroundConfig:
    start: str = "2025-03-01"
    end: str = "2026-02-28"
    hours: tuple[int, ...] = (10, 11, 12, 13)
    exclude: tuple[int, ...] = ()
    min_hours: int = 2


def ground_daily(measurements: DataFrame, registry: DataFrame, config: GroundConfig = GroundConfig()) -> DataFrame:
    """Hourly measurements -> (location_id, date, pm25_daily, hours_used, season) of kept stations."""
    d = measurements.withColumn("dt_local", local_clock("datetime_from_local"))
    d = temporal.hour_window(temporal.trim_window(d, "dt_local", config.start, config.end), "dt_local", config.hours)
    d = temporal.exclude_keys(d, "location_id", list(config.exclude))
    d = qc.keep_registered(d, registry, "location_id")
    d = temporal.daily_mean(d, ["location_id"], "dt_local", "value", config.min_hours, "pm25_daily", "hours_used")
    return temporal.with_season(d, "date")


@dataclass(frozen=True)
class OverpassConfig:
    scales: dict[str, float] = field(default_factory=lambda: {"aod_055": 0.001, "aod_047": 0.001, "aod_uncertainty": 0.0001})
    strictness: str = "moderate"


def overpass_daily(overpasses: DataFrame, registry: DataFrame, config: OverpassConfig = OverpassConfig()) -> DataFrame:
    """Overpass samples -> (location_id, date, means, n_overpasses, season)."""
    d = qc.keep_registered(overpasses, registry, "location_id")
    d = qc.decode_bits(qc.fill_to_null_and_scale(d, config.scales), "aod_qa")
    kept, _ = qc.strictness_filter(d, "qa_aod", config.strictness)
    kept = kept.withColumn("date", F.to_date("date"))
    return temporal.with_season(temporal.overpass_daily(kept, ["location_id", "date"], list(config.scales), "aod_055"), "date")


@dataclass(frozen=True)
class ModelConfig:
    hours: tuple[int, ...] = (5, 6, 7)
    low: float = 0.0
    high: float = 10.0
    tol: float = 0.05
    min_hours: int = 2


def model_daily(cell_hourly: DataFrame, mapping: DataFrame, value: str = "TOTEXTTAU", config: ModelConfig = ModelConfig()) -> DataFrame:
    """Hourly cell series -> station-day means. The coordinate gate runs first and raises on a wrong grid."""
    d = qc.coordinate_gate(cell_hourly, mapping, "cell_id", "latitude", "longitude", "cell_lat", "cell_lon", config.tol)
    d = temporal.hour_window(temporal.epoch_ms_to_utc(d, "time"), "datetime_utc", config.hours)
    d = qc.dedup_keep_first(d, ["cell_id", "datetime_utc"], ["time", value])
    d = qc.range_filter(d, value, config.low, config.high)
    daily = temporal.daily_mean(d, ["cell_id"], "datetime_utc", value, config.min_hours, "totexttau", "n_hours_available")
    return geo.broadcast_cells_to_stations(mapping, daily, "cell_id")


def fused(ground: DataFrame, aod: DataFrame, model: DataFrame, group: str, min_n: int = 2) -> DataFrame:
    """Ground station-days with satellite depth, gaps filled from the calibrated model by ``group``."""
    keys = ["location_id", "date"]
    both = aod.select(*keys, "aod_055").join(model.select(*keys, "totexttau", group), keys)
    coefficients = fusion.calibrate(both, group, "aod_055", "totexttau", min_n)
    d = fusion.align(ground, aod.select(*keys, "aod_055"), keys, "aod_055", "maiac").drop("aod_source")
    d = d.join(model.select(*keys, "totexttau", group), keys, "left")
    return fusion.gap_fill(d, coefficients, group, "aod_055", "totexttau").withColumnRenamed("source", "aod_source")
