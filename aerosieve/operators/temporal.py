"""Time windows, seasons, daily aggregation and completeness."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SEASONS, epoch_ms_clock, round_even, season


def trim_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` 00:00 through the whole of ``end`` (dates)."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def trim_report(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows before and after trimming, in one pass."""
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df.agg(F.count("*").alias("rows_before"), F.count_if(inside).alias("rows_after")).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def epoch_ms_to_utc(df: DataFrame, ms: str, ts: str = "datetime_utc", date: str = "date", hour: str = "hour") -> DataFrame:
    """UTC clock, date and hour of epoch milliseconds; not moved by the session's zone."""
    return df.withColumn(ts, epoch_ms_clock(ms)).withColumns({date: F.to_date(ts), hour: F.hour(ts)})


def hour_window(df: DataFrame, ts: str, hours: Iterable[int]) -> DataFrame:
    """Rows whose clock hour is in ``hours`` (10..13 keeps 10:00 to 13:59)."""
    return df.filter(F.hour(ts).isin(*hours))


def with_season(df: DataFrame, date: str, out: str = "season", seasons: Mapping[str, tuple[int, ...]] = SEASONS) -> DataFrame:
    """T4: season of a date; NULL dates stay NULL."""
    return df.withColumn(out, season(date, seasons))


def season_span(df: DataFrame, ts: str, key: str, season_col: str = "season", seasons: Mapping[str, tuple[int, ...]] = SEASONS) -> DataFrame:
    """T5: for every season, in fixed order: rows, first and last time, distinct keys; 0 rows where it has none."""
    per = df.groupBy(season_col).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.countDistinct(key).alias("k"))
    names = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(seasons)], "season_order int, season string")
    return names.join(per.withColumnRenamed(season_col, "season"), "season", "left").select(
        "season_order", "season", F.coalesce("n", F.lit(0)).alias("n_rows"), "first_ts", "last_ts", F.coalesce("k", F.lit(0)).alias("n_keys"))


def season_pivot(df: DataFrame, key: str, value: str | None = None, season_col: str = "season", seasons: Mapping[str, tuple[int, ...]] = SEASONS) -> DataFrame:
    """Counts by key and season, one column each and ``total``; non-null values of ``value``, or rows without one."""
    seen = F.lit(True) if value is None else F.col(value).isNotNull()
    counts = [F.count_if((F.col(season_col) == s) & seen).alias(s) for s in seasons]
    out = df.groupBy(key).agg(*counts)
    total = F.lit(0)
    for s in seasons:
        total = total + F.col(s)
    return out.withColumn("total", total.cast("long"))


def exclude_keys(df: DataFrame, key: str, keys: list | DataFrame) -> DataFrame:
    """Rows whose key is not listed; rows with a NULL key stay. A table is anti-joined, a list tested in place."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias("_excluded")).distinct(), F.col(key) == F.col("_excluded"), "left_anti")
    return df.filter(F.col(key).isNull() | ~F.col(key).isin(*keys)) if keys else df


def exclusion_report(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows and keys before and after."""
    kept = F.col(key).isNull() | ~F.col(key).isin(*keys) if keys else F.lit(True)
    return df.agg(F.count("*").alias("rows_before"), F.count_if(kept).alias("rows_after"),
                  F.countDistinct(key).alias("keys_before"), F.countDistinct(F.when(kept, F.col(key))).alias("keys_after"))


def daily_mean(df: DataFrame, keys: list[str], ts: str, value: str, min_n: int = 2, mean: str = "daily_mean", count: str = "n_used") -> DataFrame:
    """Mean and count of non-null values by key and date; days with fewer than ``min_n`` are left out."""
    out = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(value).alias(mean), F.count(value).alias(count))
    return out.filter(F.col(count) >= min_n)


def threshold_sensitivity(daily: DataFrame, count: str, thresholds: Iterable[int] = (1, 2)) -> DataFrame:
    """Groups that survive each minimum count, and how many fewer than the one before."""
    t = sorted(thresholds)
    one = daily.agg(*[F.count_if(F.col(count) >= k).alias(f"t{k}") for k in t])
    rows = F.array(*[F.struct(F.lit(k).alias("threshold"), F.col(f"t{k}").alias("n_groups"), (F.col(f"t{p}") - F.col(f"t{k}")).alias("n_lost")) for p, k in zip([t[0], *t], t)])
    return one.select(F.inline(rows))


def single_count_days(daily: DataFrame, key: str, count: str, n: int = 1) -> DataFrame:
    """For each key the days with exactly ``n`` values."""
    return daily.filter(F.col(count) == n).groupBy(key).agg(F.count("*").alias("n_days"))


def overpass_daily(df: DataFrame, keys: list[str], means: list[str], counted: str, count: str = "n_overpasses") -> DataFrame:
    """Means by key and the number of non-null ``counted``; days without any stay, with 0."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], F.count(counted).alias(count))


def count_histogram(df: DataFrame, value: str, count: str = "n_groups") -> DataFrame:
    """How often each value occurs."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias(count))


def completeness(daily: DataFrame, key: str, start: str, end: str, percent: float = 60.0, registry: DataFrame | None = None) -> DataFrame:
    """Days of each key against the days of the period, percentage rounded to one decimal, pass mark on the
    rounded value. With a registry its keys without rows appear with 0."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    per = daily.groupBy(key).agg(F.count("*").alias("actual_days"))
    if registry is not None:
        per = registry.select(key).distinct().join(per, key, "left").withColumn("actual_days", F.coalesce("actual_days", F.lit(0)))
    pct = round_even(F.col("actual_days") / F.col("possible_days") * 100, 1)
    return per.withColumn("possible_days", days).withColumn("pct_complete", pct).withColumn("passes", F.col("pct_complete") >= percent)


def missing_slots(df: DataFrame, key: str, ts: str, start: str, end: str, step: str = "1 hour") -> DataFrame:
    """(key, slot) of the calendar from ``start`` through ``end`` for which a key has no row."""
    last = F.expr(f"date_add(date'{end}', 1)").cast("timestamp_ntz") - F.expr(f"interval {step}")
    slots = F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), last, F.expr(f"interval {step}")))
    want = df.select(key).filter(F.col(key).isNotNull()).distinct().select(key, slots.alias("slot"))
    return want.join(df.select(key, F.col(ts).alias("slot")).distinct(), [key, "slot"], "left_anti")


def missing_days(missing: DataFrame, key: str, slots_per_day: int) -> DataFrame:
    """Days of which a key misses every slot."""
    per = missing.groupBy(key, F.to_date("slot").alias("date")).agg(F.count("*").alias("n"))
    return per.filter(F.col("n") >= slots_per_day).select(key, "date")


def _slot(ts: str, start: str, step: dt.timedelta) -> Column:
    """Number of the slot that holds a clock time, 0 at ``start`` 00:00."""
    since = F.col(ts).cast("timestamp_ntz") - F.lit(start).cast("timestamp_ntz")
    parts = (F.extract(F.lit(u), since).cast("decimal(20,6)") * n for u, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)))
    return F.floor(sum(parts) / F.lit(int(step.total_seconds()))).cast("long")


def _slot_start(number: Column, start: str, step: dt.timedelta) -> Column:
    seconds = number * F.lit(int(step.total_seconds()))
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def missing_intervals(df: DataFrame, key: str, ts: str, start: str, end: str, step: dt.timedelta = dt.timedelta(hours=1), registry: DataFrame | None = None) -> DataFrame:
    """T13 as intervals: (key, gap_start, gap_end, n_slots), one row for each run of slots in which a key has no row; gap_start and gap_end
    are its first and last slot. A slot lasts ``step``, which must divide a day. Keys are those of ``df``, with a registry its keys.

    No calendar is joined: a gap lies between neighbouring slots that have rows, with a mark before the first slot and one behind the last.
    What is sorted for a key is its distinct slots, so never more than the period has."""
    day = dt.timedelta(days=1)
    if step.total_seconds() % 1 or day % step:
        raise ValueError("step must be whole seconds and divide a day")
    n = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start) + day) // step
    known = df.filter(F.col(key).isNotNull())
    have = known.select(key, _slot(ts, start, step).alias("_n")).filter(F.col("_n").between(0, n - 1)).distinct()
    keys = (known if registry is None else registry.filter(F.col(key).isNotNull())).select(key).distinct()
    if registry is not None:
        have = have.join(keys, key, "left_semi")
    marks = keys.select(key, F.explode(F.array(F.lit(-1), F.lit(n)).cast("array<bigint>")).alias("_n"))
    after = F.lead("_n").over(Window.partitionBy(key).orderBy("_n"))
    gaps = have.unionByName(marks).withColumn("_after", after).filter(F.col("_after") - F.col("_n") > 1)
    return gaps.select(key, _slot_start(F.col("_n") + 1, start, step).alias("gap_start"), _slot_start(F.col("_after") - 1, start, step).alias("gap_end"), (F.col("_after") - F.col("_n") - 1).alias("n_slots"))


def missing_everywhere(gaps: DataFrame, n_keys: int, step: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """(gap_start, gap_end) of the slots that all ``n_keys`` keys miss: where as many gaps are open as there are keys. Openings and
    closings are summed by time first, so the running sum goes over at most one row for each slot of the period."""
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(step.total_seconds())).cast("decimal(18,6)"))
    turns = F.array(F.struct(F.col("gap_start").alias("at"), F.lit(1).alias("by")), F.struct((F.col("gap_end") + length).alias("at"), F.lit(-1).alias("by")))
    at = gaps.select(F.inline(turns)).groupBy("at").agg(F.sum("by").alias("by")).filter("by <> 0")
    w = Window.orderBy("at")
    run = at.withColumns({"open": F.sum("by").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "until": F.lead("at").over(w)})
    return run.filter((F.col("open") == n_keys) & F.col("until").isNotNull()).select(F.col("at").alias("gap_start"), (F.col("until") - length).alias("gap_end"))


def whole_days(gaps: DataFrame, step: dt.timedelta = dt.timedelta(hours=1), also: Iterable[str] = ()) -> DataFrame:
    """(columns ``also``, date) of the days that lie wholly in a gap."""
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(step.total_seconds())).cast("decimal(18,6)"))
    first = F.when(F.col("gap_start") == F.date_trunc("day", "gap_start").cast("timestamp_ntz"), F.to_date("gap_start")).otherwise(F.date_add(F.to_date("gap_start"), 1))
    last = F.date_add(F.to_date(F.col("gap_end") + length), -1)
    return gaps.select(*also, first.alias("_f"), last.alias("_l")).filter("_f <= _l").select(*also, F.explode(F.sequence("_f", "_l")).alias("date"))
