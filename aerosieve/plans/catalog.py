"""Registered queries of the station operators, each with SQL for the same rows.

The tables at hand are not air-quality data, so each role is played by a projection:
events as hourly series, lineitem as dated values and overpasses, suppliers and customers as points.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import haversine_km
from ..operators import fusion, geo, qc, temporal
from ..sources import ingest, schemas, tables
from ..sources.scratch import scratch_path
from ..streaming import streams
from . import chains

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# projections, valid in both dialects
HOURLY = ["user_id AS station", "ts", "event_id", "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS value"]
STUCK = ["user_id AS station", "ts", "event_id", "CASE WHEN event_id % 29 = 0 THEN NULL ELSE floor(value / 40) END AS value"]
DATED = ["l_suppkey AS station", "l_orderkey", "l_linenumber", "l_shipdate AS ts", "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS value", "l_extendedprice AS price", "l_returnflag AS airshed"]
# one division of whole numbers: a sum of decimals is exact in Spark, but off by an ulp in DuckDB's doubles, which moves points off an edge
POINTS = ["s_suppkey AS id", "CAST(284126 + s_suppkey * 7919 % 4688 AS DOUBLE) / 10000 AS lat", "CAST(768381 + s_suppkey * 104729 % 5096 AS DOUBLE) / 10000 AS lon", "CASE WHEN s_acctbal > 0 THEN 'KEEP' ELSE 'DROP_low' END AS status"]
OVERPASS = ["l_suppkey AS location_id", "l_orderkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS date", "CASE WHEN l_orderkey % 13 = 0 THEN -28672 ELSE CAST(floor(l_quantity * 20) AS INT) END AS aod_055",
            "CASE WHEN l_orderkey % 7 = 0 THEN -28672 ELSE CAST(floor(l_quantity * 25) AS INT) END AS aod_047", "CAST((l_orderkey * 7919 + l_linenumber * 104729) % 32768 AS INT) AS aod_qa"]


def _cte(name: str, exprs: list[str], table: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {table})"


C_HOURLY, C_STUCK = _cte("h", HOURLY, "events"), _cte("h", STUCK, "events")
C_DATED, C_POINTS, C_OVER = _cte("d", DATED, "lineitem"), _cte("p", POINTS, "supplier"), _cte("o", OVERPASS, "lineitem")
SEASON_SQL = "CASE WHEN month({0}) IN (3, 4, 5) THEN 'summer' WHEN month({0}) IN (6, 7, 8, 9) THEN 'monsoon' WHEN month({0}) IN (10, 11) THEN 'post_monsoon' WHEN month({0}) IN (12, 1, 2) THEN 'winter' END"
HAVERSINE_SQL = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


def table(spark: SparkSession, sf_dir: str, name: str, exprs: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if exprs is None else df.selectExpr(*exprs)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def hourly(spark, d):
    return table(spark, d, "events", HOURLY)


def dated(spark, d):
    return table(spark, d, "lineitem", DATED)


def points(spark, d):
    return table(spark, d, "supplier", POINTS)


def overpass(spark, d):
    return table(spark, d, "lineitem", OVERPASS)


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ---- time windows, seasons, daily aggregation

@query("t1_trim_window", f"WITH {C_HOURLY} SELECT station, event_id, ts, value FROM h WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'")
def t1(spark, d):
    return temporal.trim_window(hourly(spark, d), "ts", "2024-01-05", "2024-01-20").select("station", "event_id", "ts", "value")


@query("t1_trim_report", f"WITH {C_HOURLY} SELECT count(*) AS rows_before, count(*) FILTER (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21') AS rows_after, count(*) - count(*) FILTER (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21') AS rows_dropped FROM h")
def t1_report(spark, d):
    return temporal.trim_report(hourly(spark, d), "ts", "2024-01-05", "2024-01-20")


@query("t2_epoch_ms", "SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute FROM events")
def t2(spark, d):
    ms = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    # unix_millis reads the clock in the session's zone; the offset is taken out so that ms is UTC
    zone = F.unix_millis(F.lit("1970-01-01").cast("timestamp_ntz").cast("timestamp"))
    out = temporal.epoch_ms_to_utc(ms.withColumn("ms", F.col("ms") - zone), "ms")
    return out.select("event_id", "date", F.col("hour").cast("long").alias("hour"), F.minute("datetime_utc").cast("long").alias("minute"))


@query("t3_hour_window", f"WITH {C_HOURLY} SELECT station, event_id, value FROM h WHERE hour(ts) IN (10, 11, 12, 13)")
def t3(spark, d):
    return temporal.hour_window(hourly(spark, d), "ts", range(10, 14)).select("station", "event_id", "value")


@query("t4_with_season", f"WITH {C_DATED} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {SEASON_SQL.format('ts')} AS season FROM d")
def t4(spark, d):
    return temporal.with_season(dated(spark, d), "ts").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "season")


@query("t5_season_span", f"""WITH {C_DATED}, s AS (SELECT *, {SEASON_SQL.format('ts')} AS season FROM d WHERE month(ts) <> 10 AND month(ts) <> 11),
    names AS (SELECT * FROM (VALUES (0, 'summer'), (1, 'monsoon'), (2, 'post_monsoon'), (3, 'winter')) AS t(season_order, season))
    SELECT CAST(names.season_order AS BIGINT) AS season_order, names.season, count(s.ts) AS n_rows, min(s.ts) AS first_ts, max(s.ts) AS last_ts, count(DISTINCT s.station) AS n_keys FROM names LEFT JOIN s USING (season) GROUP BY 1, 2""")
def t5(spark, d):
    s = temporal.with_season(dated(spark, d).filter("month(ts) not in (10, 11)"), "ts")
    out = temporal.season_span(s, "ts", "station")
    return out.withColumn("season_order", F.col("season_order").cast("long"))


_PIVOT = ", ".join(f"count(*) FILTER (season = '{s}'{{0}}) AS {s}" for s in ("summer", "monsoon", "post_monsoon", "winter"))


@query("t6_season_pivot_values", f"WITH {C_DATED}, s AS (SELECT *, {SEASON_SQL.format('ts')} AS season FROM d) SELECT station, {_PIVOT.format(' AND value IS NOT NULL')}, count(value) AS total FROM s GROUP BY station")
def t6_values(spark, d):
    return temporal.season_pivot(temporal.with_season(dated(spark, d), "ts"), "station", "value")


@query("t6_season_pivot_rows", f"WITH {C_DATED}, s AS (SELECT *, {SEASON_SQL.format('ts')} AS season FROM d) SELECT station, {_PIVOT.format('')}, count(*) AS total FROM s GROUP BY station")
def t6_rows(spark, d):
    return temporal.season_pivot(temporal.with_season(dated(spark, d), "ts"), "station")


@query("t7_exclude_keys", f"WITH {C_HOURLY}, k AS (SELECT CASE WHEN station % 10 = 0 THEN NULL ELSE station END AS station, event_id FROM h) SELECT station, event_id FROM k WHERE station IS NULL OR station NOT IN (3, 5, 8)")
def t7(spark, d):
    k = hourly(spark, d).selectExpr("case when station % 10 = 0 then null else station end as station", "event_id")
    return temporal.exclude_keys(k, "station", [3, 5, 8])


@query("t7_exclusion_report", f"WITH {C_HOURLY} SELECT count(*) AS rows_before, count(*) FILTER (station NOT IN (3, 5, 8)) AS rows_after, count(DISTINCT station) AS keys_before, count(DISTINCT station) FILTER (station NOT IN (3, 5, 8)) AS keys_after FROM h")
def t7_report(spark, d):
    return temporal.exclusion_report(hourly(spark, d), "station", [3, 5, 8])


@query("t7_exclude_table", f"WITH {C_DATED} SELECT station, l_orderkey, price FROM d WHERE station NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal <= 0)")
def t7_table(spark, d):
    bad = table(spark, d, "supplier").filter("s_acctbal <= 0").select("s_suppkey")
    return temporal.exclude_keys(dated(spark, d), "station", bad).select("station", "l_orderkey", "price")


@query("t8_daily_mean", f"WITH {C_HOURLY} SELECT station, CAST(ts AS DATE) AS date, round(avg(value), 6) AS daily_mean, count(value) AS n_used, {SEASON_SQL.format('CAST(ts AS DATE)')} AS season FROM h WHERE hour(ts) BETWEEN 4 AND 20 GROUP BY station, CAST(ts AS DATE) HAVING count(value) >= 2")
def t8(spark, d):
    daily = temporal.daily_mean(temporal.hour_window(hourly(spark, d), "ts", range(4, 21)), ["station"], "ts", "value", 2)
    return temporal.with_season(daily, "date").select("station", "date", r6("daily_mean"), "n_used", "season")


_DAILY = "g AS (SELECT station, CAST(ts AS DATE) AS date, count(value) AS n FROM h GROUP BY 1, 2)"


@query("t9_threshold_sensitivity", f"WITH {C_HOURLY}, {_DAILY} SELECT CAST(threshold AS BIGINT) AS threshold, n_groups, n_lost FROM (SELECT 1 AS threshold, count(*) FILTER (n >= 1) AS n_groups, 0 AS n_lost FROM g UNION ALL SELECT 2, count(*) FILTER (n >= 2), count(*) FILTER (n >= 1) - count(*) FILTER (n >= 2) FROM g UNION ALL SELECT 3, count(*) FILTER (n >= 3), count(*) FILTER (n >= 2) - count(*) FILTER (n >= 3) FROM g)")
def t9(spark, d):
    daily = temporal.daily_mean(hourly(spark, d), ["station"], "ts", "value", 0)
    return temporal.threshold_sensitivity(daily, "n_used", (1, 2, 3)).withColumn("threshold", F.col("threshold").cast("long"))


@query("t9_single_count_days", f"WITH {C_HOURLY}, {_DAILY} SELECT station, count(*) AS n_days FROM g WHERE n = 1 GROUP BY station")
def t9_single(spark, d):
    return temporal.single_count_days(temporal.daily_mean(hourly(spark, d), ["station"], "ts", "value", 0), "station", "n_used")


_SCALED = "s AS (SELECT *, CASE WHEN aod_055 <> -28672 THEN aod_055 * 0.001::DOUBLE END AS a55, CASE WHEN aod_047 <> -28672 THEN aod_047 * 0.001::DOUBLE END AS a47 FROM o)"
SCALES = {"aod_055": 0.001, "aod_047": 0.001}


@query("t10_overpass_daily", f"WITH {C_OVER}, {_SCALED} SELECT location_id, date, round(avg(a55), 6) AS aod_055, round(avg(a47), 6) AS aod_047, count(a55) AS n_overpasses FROM s GROUP BY location_id, date")
def t10(spark, d):
    out = temporal.overpass_daily(qc.fill_to_null_and_scale(overpass(spark, d), SCALES), ["location_id", "date"], ["aod_055", "aod_047"], "aod_055")
    return out.select("location_id", "date", r6("aod_055"), r6("aod_047"), "n_overpasses")


@query("t11_count_histogram", f"WITH {C_OVER}, {_SCALED}, g AS (SELECT count(a55) AS n_overpasses FROM s GROUP BY location_id, date) SELECT n_overpasses, count(*) AS n_station_days FROM g GROUP BY 1")
def t11(spark, d):
    daily = temporal.overpass_daily(qc.fill_to_null_and_scale(overpass(spark, d), SCALES), ["location_id", "date"], ["aod_055"], "aod_055")
    return temporal.count_histogram(daily, "n_overpasses", "n_station_days")


@query("t12_completeness", f"WITH {C_DATED}, g AS (SELECT station, CAST(ts AS DATE) AS date FROM d WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY 1, 2), c AS (SELECT s_suppkey AS station, count(g.date) AS actual_days, 731 AS possible_days FROM supplier LEFT JOIN g ON g.station = s_suppkey GROUP BY 1) SELECT station, actual_days, CAST(possible_days AS BIGINT) AS possible_days, round_even(CAST(actual_days AS DOUBLE) / possible_days * 100 * 10, 0) / 10 AS pct_complete, round_even(CAST(actual_days AS DOUBLE) / possible_days * 100 * 10, 0) / 10 >= 25 AS passes FROM c")
def t12(spark, d):
    daily = temporal.trim_window(dated(spark, d), "ts", "1996-01-01", "1997-12-31").select("station", F.to_date("ts").alias("date")).distinct()
    registry = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"))
    out = temporal.completeness(daily, "station", "1996-01-01", "1997-12-31", 25.0, registry)
    return out.withColumn("possible_days", F.col("possible_days").cast("long"))


_SLOTS = "slots AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-08 23:00:00', INTERVAL 1 HOUR)) AS slot), have AS (SELECT DISTINCT station, date_trunc('hour', ts) AS slot FROM h), miss AS (SELECT k.station, slots.slot FROM (SELECT DISTINCT station FROM h) k CROSS JOIN slots LEFT JOIN have ON have.station = k.station AND have.slot = slots.slot WHERE have.slot IS NULL)"


def _missing(spark, d):
    h = hourly(spark, d).withColumn("slot_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return temporal.missing_slots(h, "station", "slot_ts", "2024-01-02", "2024-01-08")


@query("t13_missing_slots", f"WITH {C_HOURLY}, {_SLOTS} SELECT station, slot FROM miss")
def t13(spark, d):
    return _missing(spark, d)


@query("t13_missing_days", f"WITH {C_HOURLY}, {_SLOTS} SELECT station, CAST(slot AS DATE) AS date FROM miss GROUP BY 1, 2 HAVING count(*) >= 24")
def t13_days(spark, d):
    return temporal.missing_days(_missing(spark, d), "station", 24)


# stations report nothing on these days of the month; the period is longer than the data
_OUT = "CASE WHEN day(ts) IN (6, 7, 19) OR day(ts) = 12 AND hour(ts) >= 15 THEN NULL ELSE ts END"
_HAVE = f"""have AS (SELECT DISTINCT station, date_trunc('hour', t) AS slot FROM (SELECT station, {_OUT} AS t FROM h) WHERE t IS NOT NULL),
    slots AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02 23:00:00', INTERVAL 1 HOUR)) AS slot),
    miss AS (SELECT k.station, slots.slot FROM (SELECT DISTINCT station FROM h) k JOIN slots ON true ANTI JOIN have ON have.station = k.station AND have.slot = slots.slot)"""


def _gaps(spark, d):
    h = hourly(spark, d).withColumn("ts", F.expr(_OUT))
    return temporal.missing_intervals(h, "station", "ts", "2023-12-30", "2024-02-02")


@query("t13_missing_intervals", f"""WITH {C_HOURLY}, {_HAVE}, r AS (SELECT *, slot - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY station ORDER BY slot) AS run FROM miss)
    SELECT station, min(slot) AS gap_start, max(slot) AS gap_end, count(*) AS n_slots FROM r GROUP BY station, run""")
def t13_intervals(spark, d):
    return _gaps(spark, d).select("station", "gap_start", "gap_end", "n_slots")


_ALL_MISS = f"WITH {C_HOURLY}, {_HAVE}, everywhere AS (SELECT slot FROM slots ANTI JOIN have USING (slot))"


@query("t13_missing_everywhere", f"{_ALL_MISS}, r AS (SELECT *, slot - INTERVAL 1 HOUR * row_number() OVER (ORDER BY slot) AS run FROM everywhere) SELECT min(slot) AS gap_start, max(slot) AS gap_end FROM r GROUP BY run")
def t13_everywhere(spark, d):
    return temporal.missing_everywhere(_gaps(spark, d), hourly(spark, d).select("station").distinct().count())


@query("t13_days_missing_everywhere", f"{_ALL_MISS} SELECT CAST(slot AS DATE) AS date FROM everywhere GROUP BY 1 HAVING count(*) = 24")
def t13_days_everywhere(spark, d):
    return temporal.whole_days(temporal.missing_everywhere(_gaps(spark, d), hourly(spark, d).select("station").distinct().count()))


# ---- quality control

@query("q1_duplicates", "SELECT * FROM (SELECT l_orderkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n_in_group FROM lineitem) WHERE n_in_group > 1")
def q1(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.to_date("l_shipdate").alias("day"))
    return qc.duplicates(df, ["l_suppkey", "day"]).drop("day")


@query("q1_excess", "SELECT CAST(sum(n - 1) AS BIGINT) AS n_excess, count(*) FILTER (n > 1) AS n_groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))")
def q1_excess(spark, d):
    return qc.excess_duplicates(table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate")), ["l_suppkey", "day"])


@query("q2_keep_first", "SELECT l_suppkey, day, l_orderkey, l_quantity FROM (SELECT *, CAST(l_shipdate AS DATE) AS day, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def q2(spark, d):
    df = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return qc.dedup_keep_first(df, ["l_suppkey", "day"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "day", "l_orderkey", "l_quantity")


@query("q3_range_report", "SELECT event_id, value, CASE WHEN value < 5 THEN 'below' ELSE 'above' END AS violation FROM events WHERE value < 5 OR value > 200")
def q3(spark, d):
    return qc.range_report(table(spark, d, "events"), "value", 5.0, 200.0).select("event_id", "value", "violation")


@query("q3_range_counts", f"WITH {C_OVER}, {_SCALED} SELECT count(*) FILTER (a55 < 0.1 OR a55 > 0.9 OR a47 < 0.1 OR a47 > 0.9) AS aod_out_of_range, count(*) FILTER (a47 < 0.2 OR a47 > 1.0) AS narrow_out_of_range, count(*) AS n_rows FROM s")
def q3_counts(spark, d):
    s = qc.fill_to_null_and_scale(overpass(spark, d), SCALES)
    return qc.range_counts(s, {"aod": (["aod_055", "aod_047"], 0.1, 0.9), "narrow": (["aod_047"], 0.2, 1.0)})


@query("q4_range_filter", f"WITH {C_HOURLY} SELECT event_id, value FROM h WHERE value BETWEEN 1 AND 100")
def q4(spark, d):
    return qc.range_filter(hourly(spark, d), "value", 1.0, 100.0).select("event_id", "value")


@query("q4_range_filter_report", f"WITH {C_HOURLY} SELECT count(*) AS rows_before, count(*) FILTER (value BETWEEN 1 AND 100) AS rows_after, count(*) FILTER (value NOT BETWEEN 1 AND 100) AS n_out_of_range FROM h")
def q4_report(spark, d):
    return qc.range_filter_report(hourly(spark, d), "value", 1.0, 100.0)


_RUNS = """a AS (SELECT *, lag(value) OVER w AS before FROM h WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN value = before THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM a),
    r AS (SELECT station, CAST(run_id AS BIGINT) AS run_id, min(ts) AS run_start, max(ts) AS run_end, any_value(value) AS run_value, count(*) AS run_length FROM b GROUP BY station, run_id)"""
_STUCK = f"WITH {C_STUCK}, {_RUNS} SELECT station, count(*) AS n_runs, CAST(sum(run_length) AS BIGINT) AS rows_in_runs, max(run_length) AS longest_run FROM r WHERE run_length >= 3 GROUP BY station"


@query("q5_stuck_runs", _STUCK)
def q5(spark, d):
    return qc.stuck_runs(table(spark, d, "events", STUCK).withColumn("value", F.col("value").cast("double")), "station", ["ts", "event_id"], "value", 3)


@query("q5_stuck_runs_bucketed", _STUCK)
def q5_bucketed(spark, d):
    df = table(spark, d, "events", STUCK).withColumn("value", F.col("value").cast("double"))
    return qc.stuck_runs_bucketed(df, "station", ["ts", "event_id"], "value", F.to_date("ts"), 3)


@query("q5_runs", f"WITH {C_STUCK}, {_RUNS} SELECT station, run_id, run_start, run_end, run_value, run_length FROM r WHERE run_length >= 2")
def q5_runs(spark, d):
    df = table(spark, d, "events", STUCK).withColumn("value", F.col("value").cast("double"))
    return qc.runs(df, "station", ["ts", "event_id"], "value").filter("run_length >= 2")


@query("q6_zero_profile", f"WITH {C_HOURLY} SELECT station, count(*) FILTER (value = 0) AS n_zero, count(*) AS n_rows, round_even(CAST(count(*) FILTER (value = 0) AS DOUBLE) / count(*) * 100 * 10, 0) / 10 AS pct_zero FROM h GROUP BY station")
def q6(spark, d):
    return qc.zero_profile(hourly(spark, d), "station", "value")


@query("q7_fill_and_scale", f"WITH {C_OVER}, {_SCALED} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(a55, 6) AS aod_055, round(a47, 6) AS aod_047 FROM s")
def q7(spark, d):
    return qc.fill_to_null_and_scale(overpass(spark, d), SCALES).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), r6("aod_055"), r6("aod_047"))


@query("q7_fill_counts", f"WITH {C_OVER} SELECT count(*) FILTER (aod_055 = -28672) AS aod_055_fill, count(*) FILTER (aod_047 = -28672) AS aod_047_fill FROM o")
def q7_counts(spark, d):
    return qc.fill_counts(overpass(spark, d), ["aod_055", "aod_047"])


_BITS = "b AS (SELECT *, aod_qa & 7 AS cloud_mask, (aod_qa >> 5) & 7 AS adjacency_mask, (aod_qa >> 8) & 15 AS qa_aod, (aod_qa >> 12) & 1 AS glint_mask, (aod_qa >> 13) & 3 AS aerosol_model FROM o)"


@query("q8_decode_bits", f"WITH {C_OVER}, {_BITS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in qc.BIT_LAYOUT) + " FROM b")
def q8(spark, d):
    return qc.decode_bits(overpass(spark, d), "aod_qa").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *[F.col(c).cast("long").alias(c) for c in qc.BIT_LAYOUT])


def _case(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in qc.LABELS[c].items()) + f" END AS {c}_label"


_LABELLED = "n AS (SELECT *, " + ", ".join(_case(c) for c in qc.LABELS) + " FROM b)"


@query("q9_label_codes", f"WITH {C_OVER}, {_BITS}, {_LABELLED} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(f"{c}_label" for c in qc.LABELS) + " FROM n")
def q9(spark, d):
    return qc.label_codes(qc.decode_bits(overpass(spark, d), "aod_qa")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *[f"{c}_label" for c in qc.LABELS])


@query("q10_category_summary", f"WITH {C_OVER}, {_BITS}, {_LABELLED} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS field_order, '{c}_label' AS field, {c}_label AS category, count(*) AS n FROM n WHERE {c}_label IS NOT NULL GROUP BY {c}_label" for i, c in enumerate(("qa_aod", "cloud_mask", "adjacency_mask"))))
def q10(spark, d):
    out = qc.category_summary(qc.label_codes(qc.decode_bits(overpass(spark, d), "aod_qa")), ["qa_aod_label", "cloud_mask_label", "adjacency_mask_label"])
    return out.withColumn("field_order", F.col("field_order").cast("long"))


@query("q11_strictness_filter", f"WITH {C_OVER}, {_BITS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(qa_aod AS BIGINT) AS qa_aod FROM b WHERE qa_aod IN (0, 3)")
def q11(spark, d):
    kept, _ = qc.strictness_filter(qc.decode_bits(overpass(spark, d), "aod_qa"), "qa_aod", "moderate")
    return kept.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("qa_aod").cast("long").alias("qa_aod"))


@query("q11_strictness_report", f"WITH {C_OVER}, {_BITS} SELECT count(*) AS n_rows, count(*) FILTER (qa_aod IN (0, 1, 3, 4, 7, 10)) AS n_kept, count(*) FILTER (qa_aod NOT IN (0, 1, 3, 4, 7, 10)) AS n_dropped, round_even(CAST(count(*) FILTER (qa_aod IN (0, 1, 3, 4, 7, 10)) AS DOUBLE) / count(*) * 100 * 10, 0) / 10 AS pct_kept FROM b")
def q11_report(spark, d):
    return qc.strictness_report(qc.decode_bits(overpass(spark, d), "aod_qa"), "qa_aod", "lenient")


@query("q12_keys_lost", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)")
def q12(spark, d):
    e = table(spark, d, "events")
    return qc.keys_lost(e, e.filter("value > 150"), "user_id")


_CELLS = "c AS (SELECT *, 0.0 + (floor((lat - 0.0) / 0.5) + 0.5) * 0.5 AS cell_lat, 0.125 + (floor((lon - 0.125) / 0.625) + 0.5) * 0.625 AS cell_lon FROM p)"
_NUMBERED = "f AS (SELECT cell_lat, cell_lon, min(id) AS k, count(*) AS n_in_cell FROM c GROUP BY 1, 2), g AS (SELECT cell_lat, cell_lon, n_in_cell, row_number() OVER (ORDER BY k, cell_lat, cell_lon) AS cell_id FROM f), m AS (SELECT c.*, g.cell_id, g.n_in_cell FROM c JOIN g USING (cell_lat, cell_lon))"


def mapping(spark, d):
    return geo.assign_cell_id(geo.snap_to_grid(points(spark, d), "lat", "lon", 0.5, 0.625, 0.0, 0.125), "id")


# distances in decimals: points have four, and at the tolerance the last bit of a double would decide
@query("q13_coordinate_violations", f"WITH {C_POINTS}, {_CELLS}, {_NUMBERED} SELECT id, CAST(cell_id AS BIGINT) AS cell_id FROM m WHERE round(abs(lat - cell_lat), 6) > 0.2 OR round(abs(lon - cell_lon), 6) > 0.25")
def q13(spark, d):
    m = mapping(spark, d)
    bad = qc.coordinate_violations(m.select("id", "lat", "lon", "cell_id"), m, "cell_id", "lat", "lon", "cell_lat", "cell_lon", 0.2, 0.25, digits=6)
    return bad.select("id", F.col("cell_id").cast("long").alias("cell_id"))


@query("q13_unmapped_cells", f"WITH {C_POINTS}, {_CELLS}, {_NUMBERED} SELECT DISTINCT CAST(user_id % 12 AS BIGINT) AS cell_id FROM events WHERE user_id % 12 NOT IN (SELECT cell_id FROM m)")
def q13_unmapped(spark, d):
    cells = table(spark, d, "events").select((F.col("user_id") % 12).cast("long").alias("cell_id"))
    return qc.unmapped_cells(cells, mapping(spark, d).select(F.col("cell_id").cast("long").alias("cell_id")), "cell_id")


@query("q14_keep_registered", f"WITH {C_DATED}, {C_POINTS} SELECT station, l_orderkey, price FROM d WHERE station IN (SELECT id FROM p WHERE status = 'KEEP')")
def q14(spark, d):
    return qc.keep_registered(dated(spark, d), points(spark, d).withColumnRenamed("id", "station"), "station").select("station", "l_orderkey", "price")


@query("q14_dropped_keys", f"WITH {C_DATED}, {C_POINTS} SELECT station, count(*) AS n_rows FROM d WHERE station NOT IN (SELECT id FROM p WHERE status = 'KEEP') GROUP BY station")
def q14_dropped(spark, d):
    return qc.dropped_keys(dated(spark, d), points(spark, d).withColumnRenamed("id", "station"), "station")


@query("q15_review", f"WITH {C_POINTS}, z AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT l_suppkey AS id, avg(l_quantity) AS q FROM lineitem GROUP BY 1), r AS (SELECT p.id, p.status, coalesce(z.n > 620, false) AS fails_rows, coalesce(a.q < 25.4, false) AS fails_mean FROM p LEFT JOIN z USING (id) LEFT JOIN a USING (id)) SELECT id, status, fails_rows, fails_mean, (fails_rows OR fails_mean) AS should_drop FROM r WHERE (status = 'KEEP') = (fails_rows OR fails_mean) AND id % 9 <> 0")
def q15(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "id")
    checks = {"rows": (l.groupBy("id").agg(F.count("*").alias("n")), F.col("n") > 620), "mean": (l.groupBy("id").agg(F.avg("l_quantity").alias("q")), F.col("q") < 25.4)}
    allowed = points(spark, d).filter("id % 9 = 0").select("id")
    return qc.review(points(spark, d), "id", checks, allowed).select("id", "status", "fails_rows", "fails_mean", "should_drop")


# an urgent order excuses its customer's large orders from its date on, until the next urgent one
_EXCUSE = "x AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS exception_date, max('order ' || o_orderkey) AS exception_reason FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2), bad AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 200000)"


def _exceptions(spark, d):
    o = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    x = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("date").alias("exception_date"), F.concat(F.lit("order "), "o_orderkey").alias("exception_reason"))
    return o.filter("o_totalprice > 200000").select("o_custkey", "o_orderkey", "date"), x


@query("q15_dated_exceptions", f"WITH {_EXCUSE} SELECT bad.o_custkey, bad.o_orderkey, bad.date, x.exception_reason, x.exception_date FROM bad ASOF LEFT JOIN x ON x.o_custkey = bad.o_custkey AND x.exception_date <= bad.date")
def q15_dated(spark, d):
    bad, x = _exceptions(spark, d)
    return qc.excused(bad, x, "o_custkey", "date")


@query("q15_unexcused", f"WITH {_EXCUSE} SELECT o_custkey, o_orderkey, date FROM bad WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.o_custkey = bad.o_custkey AND x.exception_date <= bad.date)")
def q15_unexcused(spark, d):
    bad, x = _exceptions(spark, d)
    return qc.unexcused(bad, x, "o_custkey", "date")


# ---- geography, pairs, fusion

@query("g1_snap_to_grid", f"WITH {C_POINTS}, {_CELLS} SELECT id, round(cell_lat, 6) AS cell_lat, round(cell_lon, 6) AS cell_lon FROM c")
def g1(spark, d):
    return geo.snap_to_grid(points(spark, d), "lat", "lon", 0.5, 0.625, 0.0, 0.125).select("id", r6("cell_lat"), r6("cell_lon"))


@query("g2_assign_cell_id", f"WITH {C_POINTS}, {_CELLS}, {_NUMBERED} SELECT id, CAST(cell_id AS BIGINT) AS cell_id, n_in_cell FROM m")
def g2(spark, d):
    return mapping(spark, d).select("id", F.col("cell_id").cast("long").alias("cell_id"), "n_in_cell")


@query("g3_haversine", f"WITH {C_POINTS} SELECT a.id, round({HAVERSINE_SQL.replace('b.lat', '28.6').replace('b.lon', '77.2')}, 6) AS km FROM p a")
def g3(spark, d):
    return points(spark, d).select("id", F.round(haversine_km("lat", "lon", F.lit(28.6), F.lit(77.2)), 6).alias("km"))


_PAIRS = f"pairs AS (SELECT a.id AS id_a, b.id AS id_b, round_even({HAVERSINE_SQL} * 1000, 0) / 1000 AS distance_km FROM p a JOIN p b ON a.id < b.id WHERE {HAVERSINE_SQL} < {{0}})"


@query("g4_close_pairs", f"WITH {C_POINTS}, {_PAIRS.format(3.0)} SELECT * FROM pairs")
def g4(spark, d):
    return geo.close_pairs(points(spark, d), "id", "lat", "lon", 3.0)


_GREEDY = f"""WITH RECURSIVE {C_POINTS}, {_PAIRS.format(3.0)}, e AS (SELECT *, row_number() OVER (ORDER BY distance_km, id_a, id_b) AS e FROM pairs),
    ends AS (SELECT id_a AS node, id_b AS other, e FROM e UNION ALL SELECT id_b, id_a, e FROM e),
    f AS (SELECT node, min(e) AS e, arg_min(other, e) AS other FROM ends GROUP BY node),
    walk AS (SELECT f.node, f.other AS cur, CASE WHEN g.e = f.e THEN f.e END AS root FROM f JOIN f g ON g.node = f.other
        UNION ALL SELECT w.node, f.other, CASE WHEN g.e = f.e THEN f.e END FROM walk w JOIN f ON f.node = w.cur JOIN f g ON g.node = f.other WHERE w.root IS NULL),
    roots AS (SELECT node, max(root) AS root FROM walk GROUP BY node), num AS (SELECT node, dense_rank() OVER (ORDER BY root) AS c FROM roots)
    SELECT id_a, id_b, distance_km, x.c AS cluster_id, x.c <> y.c AS is_bridge FROM e JOIN num x ON x.node = id_a JOIN num y ON y.node = id_b"""


@query("g5_cluster_greedy", _GREEDY)
def g5(spark, d):
    out = geo.cluster_points(points(spark, d), "id", "lat", "lon", 3.0, "greedy")
    return out.select("id_a", "id_b", "distance_km", F.col("cluster_id").cast("long").alias("cluster_id"), "is_bridge")


_COMPONENTS = f"""WITH RECURSIVE {C_POINTS}, {_PAIRS.format(3.0)}, ends AS (SELECT id_a AS node, id_b AS other FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
    reach AS (SELECT node, node AS top FROM ends UNION SELECT ends.other, reach.top FROM reach JOIN ends ON ends.node = reach.node),
    low AS (SELECT node, min(top) AS root FROM reach GROUP BY node),
    rank AS (SELECT root, row_number() OVER (ORDER BY distance_km, id_a, id_b) AS r FROM (SELECT low.root, pairs.*, row_number() OVER (PARTITION BY low.root ORDER BY distance_km, id_a, id_b) AS k FROM pairs JOIN low ON low.node = id_a) WHERE k = 1)
    SELECT id_a, id_b, distance_km, rank.r AS cluster_id, false AS is_bridge FROM pairs JOIN low ON low.node = id_a JOIN rank USING (root)"""


@query("g5_cluster_components", _COMPONENTS)
def g5_components(spark, d):
    out = geo.cluster_points(points(spark, d), "id", "lat", "lon", 3.0, "components")
    return out.select("id_a", "id_b", "distance_km", F.col("cluster_id").cast("long").alias("cluster_id"), "is_bridge")


_SUPPLIER_DAILY = "daily AS (SELECT l_suppkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@query("g6_pair_correlation", f"WITH {C_POINTS}, {_PAIRS.format(3.0)}, {_SUPPLIER_DAILY}, j AS (SELECT id_a, id_b, x.v AS x, y.v AS y FROM pairs JOIN daily x ON x.id = id_a JOIN daily y ON y.id = id_b AND y.date = x.date) SELECT id_a, id_b, count(*) AS matched_days, round_even(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) * 1000, 0) / 1000 AS correlation FROM j GROUP BY id_a, id_b HAVING count(*) >= 2")
def g6(spark, d):
    daily = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.avg("l_quantity").alias("v"))
    return geo.near_correlation(points(spark, d), "id", "lat", "lon", 3.0, daily, "id", "date", "v").select("id_a", "id_b", "matched_days", "correlation")


@query("g7_nearest_neighbour", f"WITH {C_POINTS}, n AS (SELECT a.id, b.id AS neighbour, round_even({HAVERSINE_SQL} * 1000, 0) / 1000 AS nn_km FROM p a JOIN p b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nn_km, neighbour) AS rank FROM n) SELECT id, CAST(rank AS BIGINT) AS rank, neighbour, nn_km, CASE WHEN nn_km < 1 THEN 'YES' WHEN nn_km < 1.5 THEN 'BORDERLINE' END AS pixel_risk FROM r WHERE rank <= 2")
def g7(spark, d):
    return geo.nearest_neighbour(points(spark, d), "id", "lat", "lon", k=2).withColumn("rank", F.col("rank").cast("long"))


_CELL_DAILY = "cd AS (SELECT CAST(l_suppkey % 3 AS BIGINT) + 1 AS cell_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2)"


@query("g8_cells_to_stations", f"WITH {C_POINTS}, {_CELLS}, {_NUMBERED}, {_CELL_DAILY} SELECT m.id, m.cell_id, cd.date, cd.v FROM m JOIN cd ON cd.cell_id = m.cell_id")
def g8(spark, d):
    daily = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3 + 1).alias("cell_id"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    m = mapping(spark, d).select("id", F.col("cell_id").cast("long").alias("cell_id"))
    return geo.broadcast_cells_to_stations(m, daily, "cell_id").select("id", "cell_id", "date", "v")


_BASE = "base AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice), 6) AS pm, min(l_returnflag) AS airshed FROM lineitem GROUP BY 1, 2), aod AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS aod FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2), model AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity + l_discount * 50), 6) AS tau FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1, 2)"


def _fusion(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "station").withColumn("date", F.to_date("l_shipdate"))
    k = ["station", "date"]
    mean = lambda df, e, name: df.groupBy(*k).agg(F.round(F.avg(F.expr(e)), 6).alias(name))
    base = l.groupBy(*k).agg(F.round(F.avg("l_extendedprice"), 6).alias("pm"), F.min("l_returnflag").alias("airshed"))
    return base, mean(l.filter("l_orderkey % 3 = 0"), "l_quantity", "aod"), mean(l.filter("l_orderkey % 5 <> 0"), "l_quantity + l_discount * 50", "tau")


@query("f1_align", f"WITH {_BASE} SELECT station, date, pm, aod, CASE WHEN aod IS NOT NULL THEN 'maiac' END AS aod_source FROM base LEFT JOIN aod USING (station, date)")
def f1(spark, d):
    base, aod, _ = _fusion(spark, d)
    return fusion.align(base, aod, ["station", "date"], "aod", "maiac").select("station", "date", "pm", "aod", "aod_source")


_FIT = "fit AS (SELECT airshed, regr_count(aod, tau) AS n, regr_slope(aod, tau) AS slope, regr_intercept(aod, tau) AS intercept, regr_r2(aod, tau) AS r2 FROM base JOIN aod USING (station, date) JOIN model USING (station, date) GROUP BY airshed)"


@query("f2_calibrate", f"WITH {_BASE}, {_FIT} SELECT airshed, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM fit WHERE n >= 2")
def f2(spark, d):
    base, aod, model = _fusion(spark, d)
    both = base.join(aod, ["station", "date"]).join(model, ["station", "date"])
    return fusion.calibrate(both, "airshed", "aod", "tau").select("airshed", "n", r6("slope"), r6("intercept"), r6("r2"))


@query("f3_gap_fill", f"WITH {_BASE}, {_FIT} SELECT station, date, round(coalesce(aod, intercept + slope * tau), 4) AS filled, CASE WHEN aod IS NOT NULL THEN 'maiac' WHEN intercept + slope * tau IS NOT NULL THEN 'merra2_gapfilled' END AS source FROM base LEFT JOIN aod USING (station, date) LEFT JOIN model USING (station, date) LEFT JOIN fit USING (airshed)")
def f3(spark, d):
    base, aod, model = _fusion(spark, d)
    k = ["station", "date"]
    coefficients = fusion.calibrate(base.join(aod, k).join(model, k), "airshed", "aod", "tau")
    out = fusion.gap_fill(base.join(aod, k, "left").join(model, k, "left"), coefficients, "airshed", "aod", "tau")
    return out.select("station", "date", F.round("filled", 4).alias("filled"), "source")


_FOLDS = "p AS (SELECT airshed, CAST(year(date) AS BIGINT) AS fold, aod AS y, tau AS x FROM base JOIN aod USING (station, date) JOIN model USING (station, date)), k AS (SELECT DISTINCT airshed, fold FROM p), c AS (SELECT k.airshed, k.fold, regr_count(y, x) AS n_fit, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM k LEFT JOIN p ON p.airshed = k.airshed AND p.fold <> k.fold GROUP BY ALL), h AS (SELECT airshed, fold, count(*) AS n, any_value(CAST(n_fit AS BIGINT)) AS n_fit, any_value(slope) AS slope, any_value(intercept) AS intercept, sqrt(avg(pow(intercept + slope * x - y, 2))) AS rmse, avg(intercept + slope * x - y) AS bias FROM p JOIN c USING (airshed, fold) GROUP BY ALL)"


def _held_out(spark, d):
    base, aod, model = _fusion(spark, d)
    both = base.join(aod, ["station", "date"]).join(model, ["station", "date"]).withColumn("fold", F.year("date").cast("long"))
    return fusion.held_out_error(both, "airshed", "fold", "aod", "tau")


@query("f2_held_out_error", f"WITH {_BASE}, {_FOLDS} SELECT airshed, fold, n, n_fit, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(rmse, 6) AS rmse, round(bias, 6) AS bias FROM h")
def f2_held_out(spark, d):
    return _held_out(spark, d).select("airshed", "fold", "n", "n_fit", r6("slope"), r6("intercept"), r6("rmse"), r6("bias"))


@query("f3_calibration_error", f"WITH {_BASE}, {_FOLDS} SELECT airshed, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_folds, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) AS rmse, round(sum(n * bias) / sum(n), 6) AS bias FROM h WHERE rmse IS NOT NULL GROUP BY airshed")
def f3_error(spark, d):
    return fusion.calibration_error(_held_out(spark, d), "airshed").select("airshed", "n", "n_folds", r6("rmse"), r6("bias"))


# ---- landing and merging

PAGE_ROWS = 1_000  # entries of a landed page, about


@query("i1_registry", f"WITH {C_POINTS} SELECT id AS location_id, round(lat, 6) AS latitude, 'Station, no. ' || id || ' \"main\"' AS name FROM p WHERE status = 'KEEP'")
def i1(spark, d):
    empty = {f.name for f in spark.createDataFrame([], schemas.REGISTRY).schema} - {"location_id", "name", "latitude", "longitude", "status"}
    reg = points(spark, d).select(F.col("id").alias("location_id"), F.concat(F.lit("Station, no. "), "id", F.lit(' "main"')).alias("name"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "status")
    reg = reg.withColumns({c: F.lit(None).cast("string") for c in empty}).select([f.name for f in spark.createDataFrame([], schemas.REGISTRY).schema])
    path = scratch_path(spark, "registry")
    reg.write.csv(path, header=True, quote='"', escape='"')
    return ingest.read_registry(spark, path, keep="KEEP").select("location_id", F.round("latitude", 6).alias("latitude"), "name")


def _pages(spark, d):
    """Orders with their lines, packed as landed JSON pages and parsed back."""
    l = table(spark, d, "lineitem")
    entry = """named_struct('value', l_quantity, 'parameter', named_struct('id', l_partkey, 'name', l_returnflag, 'units', 'ug'),
        'period', if(l_linenumber = 3, null, named_struct('label', 'hour', 'datetimeFrom', named_struct('utc', date_format(l_shipdate, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'local', date_format(l_shipdate, "yyyy-MM-dd'T'HH:mm:ss'+05:30'")))),
        'coverage', named_struct('expectedCount', l_linenumber))"""
    pages = l.groupBy("l_suppkey", "l_orderkey").agg(F.to_json(F.struct(F.first("l_suppkey").alias("location_id"), F.first("l_orderkey").alias("sensor_id"), F.collect_list(F.expr(entry)).alias("results"))).alias("j"))
    return pages.select(F.from_json("j", schemas.MEASUREMENTS_JSON).alias("p")).select("p.*")


_FLAT = "CASE WHEN l_linenumber <> 3 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '{0}' END"


@query("i6_measurements_narrow", f"SELECT l_suppkey AS location_id, l_orderkey AS sensor_id, l_returnflag AS parameter_name, 'ug' AS units, l_quantity AS value, {_FLAT.format('Z')} AS datetime_from_utc, {_FLAT.format('+05:30')} AS datetime_from_local, CAST(l_linenumber AS BIGINT) AS coverage_expected FROM lineitem")
def i6(spark, d):
    out = ingest.flatten_measurements(_pages(spark, d))
    return out.select("location_id", "sensor_id", "parameter_name", "units", "value", "datetime_from_utc", "datetime_from_local", F.col("coverage_expected").cast("long").alias("coverage_expected"))


@query("i6_measurements_wide", f"SELECT l_suppkey AS location_id, l_partkey AS parameter_id, CASE WHEN l_linenumber <> 3 THEN 'hour' END AS period_label, {_FLAT.format('Z')} AS period_from_utc, CAST(NULL AS VARCHAR) AS period_to_utc, l_quantity AS value FROM lineitem")
def i6_wide(spark, d):
    return ingest.flatten_measurements(_pages(spark, d), "wide").select("location_id", "parameter_id", "period_label", "period_from_utc", "period_to_utc", "value")


# a page for each order: of open orders ('P') the line is cut off, as by a broken download
_BROKEN = "lineitem JOIN orders ON o_orderkey = l_orderkey"


def _landed(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    entry = F.expr("named_struct('value', l_quantity, 'parameter', named_struct('id', l_partkey, 'name', l_returnflag))")
    page = F.to_json(F.struct(F.min("l_suppkey").alias("location_id"), F.col("o_orderkey").alias("sensor_id"), F.collect_list(entry).alias("results")))
    lines = l.groupBy("o_orderkey", "o_orderstatus").agg(page.alias("j"))  # an order has few lines
    lines = lines.select(F.expr("CASE WHEN o_orderstatus = 'P' THEN left(j, length(j) - 3) ELSE j END").alias("value"))
    pages = scratch_path(spark, "pages")
    lines.write.text(pages)
    return ingest.land(spark, pages, schemas.MEASUREMENTS_JSON, scratch_path(spark, "landed"))


@query("i6_quarantine_good", f"SELECT l_orderkey AS sensor_id, l_quantity AS value, l_returnflag AS parameter_name FROM {_BROKEN} WHERE o_orderstatus <> 'P'")
def i6_good(spark, d):
    return ingest.flatten_measurements(_landed(spark, d)[0]).select("sensor_id", "value", "parameter_name")


@query("i6_quarantine_bad", "SELECT DISTINCT o_orderkey AS sensor_id, true AS has_file FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def i6_bad(spark, d):
    _, bad = _landed(spark, d)
    return bad.select(F.regexp_extract("record", '"sensor_id":([0-9]+)', 1).cast("long").alias("sensor_id"), F.col("file").like("part-%").alias("has_file"))


_CSV = "location_id bigint, name string, latitude double, longitude double, status string"


def _landed_csv(spark, d):
    """The registry as CSV, in which customers in debt have a latitude that is no number."""
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("location_id"), F.concat(F.lit('Station, "'), "c_name", F.lit('"')).alias("name"),
        F.expr("CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END").alias("latitude"), F.lit("77.5").alias("longitude"), F.lit("KEEP").alias("status"))
    path = scratch_path(spark, "csv")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return ingest.land(spark, path, _CSV, scratch_path(spark, "landed"), "csv", multiLine=True)


@query("i1_quarantine_good", "SELECT c_custkey AS location_id, 'Station, \"' || c_name || '\"' AS name, CAST(c_nationkey AS DOUBLE) AS latitude FROM customer WHERE c_acctbal >= 0")
def i1_good(spark, d):
    return _landed_csv(spark, d)[0].select("location_id", "name", "latitude")


@query("i1_quarantine_bad", "SELECT c_custkey AS location_id, CAST(4 AS BIGINT) AS n_read FROM customer WHERE c_acctbal < 0")
def i1_bad(spark, d):
    _, bad = _landed_csv(spark, d)
    return bad.select(F.regexp_extract("record", "^([0-9]+),", 1).cast("long").alias("location_id"), F.col("n_read").cast("long").alias("n_read"))


@query("i2_locations", "SELECT o_custkey AS location_id, 'c' || o_custkey AS name, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (l_returnflag <> 'N'))), ','), '') AS parameters, count(*) AS sensor_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 3 = 0 GROUP BY o_custkey")
def i2(spark, d):
    l = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_returnflag")
    sensors = F.collect_list(F.expr("named_struct('id', l_orderkey, 'parameter', if(l_returnflag = 'N', null, named_struct('name', l_returnflag)))"))
    # a customer with very many lines fills several pages
    loc = ingest.with_chunks(l, ["o_custkey"], PAGE_ROWS).groupBy("o_custkey", "_chunk").agg(sensors.alias("s")).select("o_custkey", F.expr("array(named_struct('id', o_custkey, 'name', concat('c', o_custkey), 'provider', named_struct('id', if(o_custkey % 3 = 0, 168, 1), 'name', 'CPCB'), 'sensors', s))").alias("results"))
    pages = loc.select(F.from_json(F.to_json(F.struct("results")), schemas.LOCATIONS_JSON).alias("p")).select("p.*")
    return ingest.join_location_pages(ingest.flatten_locations(pages)).select("location_id", "name", "parameters", F.col("sensor_count").cast("long").alias("sensor_count"))


@query("i3_in_bbox", f"WITH {C_POINTS} SELECT id FROM p WHERE lon BETWEEN 76.9895 AND 77.1731 AND lat BETWEEN 28.3194 AND 28.5135")
def i3(spark, d):
    return ingest.in_bbox(points(spark, d), "lat", "lon", "gurugram").select("id")


@query("i4_reports_parameter", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%' || lower('St') || '%'")
def i4(spark, d):
    return ingest.reports_parameter(table(spark, d, "part"), "p_type", "St").select("p_partkey")


@query("i5_latest_sensor_ids", "SELECT DISTINCT l_partkey % 50 AS sensor_id FROM lineitem WHERE l_partkey % 50 <> 0")
def i5(spark, d):
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("named_struct('sensorsId', if(l_linenumber = 9, null, l_partkey % 50), 'value', l_tax)")).alias("results"))
    return ingest.latest_sensor_ids(pages)


@query("i7_sensors_overlapping", "WITH s AS (SELECT l_suppkey, l_partkey, min(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')) AS a, max(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')) AS b, CASE WHEN l_partkey % 2 = 0 THEN 'PM25' ELSE 'no2' END AS p FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_partkey, substr(a, 1, 10) AS first_date, substr(b, 1, 10) AS last_date FROM s WHERE p = 'PM25' AND substr(b, 1, 10) >= '1997-01-01' AND substr(a, 1, 10) <= '1997-06-30'")
def i7(spark, d):
    iso = "date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\")"
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.expr(iso)).alias("datetime_first"), F.max(F.expr(iso)).alias("datetime_last"))
    s = s.withColumn("parameter_name", F.expr("if(l_partkey % 2 = 0, 'PM25', 'no2')"))
    return ingest.sensors_overlapping(s, "1997-01-01", "1997-06-30").select("l_suppkey", "l_partkey", "first_date", "last_date")


@query("i7_sensors_in_windows", """WITH s AS (SELECT l_suppkey, l_partkey, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2),
    w AS (SELECT o_orderpriority, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month, min(CAST(o_orderdate AS DATE)) AS window_start, max(CAST(o_orderdate AS DATE)) AS window_end FROM orders GROUP BY 1, 2)
    SELECT l_suppkey, l_partkey, first_date, last_date, o_orderpriority, month, window_start, window_end FROM s JOIN w ON first_date <= window_end AND window_start <= last_date""")
def i7_windows(spark, d):
    iso = "date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\")"
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.expr(iso)).alias("datetime_first"), F.max(F.expr(iso)).alias("datetime_last"))
    s = s.withColumn("parameter_name", F.expr("if(l_partkey % 2 = 0, 'PM25', 'no2')"))
    day = F.to_date("o_orderdate")
    w = table(spark, d, "orders").groupBy("o_orderpriority", (F.year(day) * 100 + F.month(day)).cast("long").alias("month")).agg(F.min(day).alias("window_start"), F.max(day).alias("window_end"))
    out = ingest.sensors_in_windows(s, w)
    return out.select("l_suppkey", "l_partkey", "first_date", "last_date", "o_orderpriority", "month", "window_start", "window_end")


def _local(spark, d):
    return table(spark, d, "events").withColumn("local", F.expr("if(event_id % 19 = 0, 'bad', concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+05:30'))"))


@query("i8_guard_dates", "SELECT event_id FROM events WHERE event_id % 19 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-09'")
def i8(spark, d):
    return ingest.guard_window(_local(spark, d), "local", "2024-01-04", "2024-01-09").select("event_id")


@query("i8_guard_half_open", "SELECT event_id FROM events WHERE event_id % 19 <> 0 AND ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-09' AND lower(event_type) = 'click'")
def i8_half(spark, d):
    return ingest.guard_window(_local(spark, d), "local", "2024-01-04", "2024-01-09", "half_open", "click", "event_type").select("event_id")


@query("i9_stitch_sensors", "WITH s AS (SELECT l_suppkey, l_partkey, min(CAST(l_shipdate AS DATE)) AS f FROM lineitem GROUP BY 1, 2) SELECT location, day, sensor, l_orderkey, l_linenumber FROM (SELECT l.l_suppkey AS location, CAST(l.l_shipdate AS DATE) AS day, l.l_partkey * 10000000 + l.l_orderkey AS sensor, l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (PARTITION BY l.l_suppkey, CAST(l.l_shipdate AS DATE) ORDER BY s.f, l.l_partkey * 10000000 + l.l_orderkey, l.l_linenumber) AS r FROM lineitem l JOIN s ON s.l_suppkey = l.l_suppkey AND s.l_partkey = l.l_partkey) WHERE r = 1")
def i9(spark, d):
    l = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    first = l.groupBy("l_suppkey", "l_partkey").agg(F.min("day").alias("first_date"))
    rows = l.join(first, ["l_suppkey", "l_partkey"]).withColumn("sensor", F.col("l_partkey") * 10000000 + F.col("l_orderkey")).withColumn("order_key", F.struct("sensor", "l_linenumber"))
    out = ingest.stitch_sensors(rows, "l_suppkey", "day", "first_date", "order_key")
    return out.select(F.col("l_suppkey").alias("location"), "day", "sensor", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


_BATCHES = "old AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_quantity AS v FROM lineitem WHERE l_orderkey % 3 <> 2), new AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_quantity + 1000 AS v FROM lineitem WHERE l_orderkey % 3 <> 0), u AS (SELECT *, 0 AS b FROM old UNION ALL SELECT *, 1 AS b FROM new), merged AS (SELECT k, day, l_orderkey, v FROM (SELECT *, row_number() OVER (PARTITION BY k, day ORDER BY b, l_orderkey, l_linenumber) AS r FROM u) WHERE r = 1)"


def _batches(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))
    return l.filter("l_orderkey % 3 <> 2"), l.filter("l_orderkey % 3 <> 0").withColumn("v", F.col("v") + 1000)


@query("i10_merge_batches", f"WITH {_BATCHES} SELECT k, day, l_orderkey, v FROM merged")
def i10(spark, d):
    return ingest.merge_batches(*_batches(spark, d), ["k", "day"], ["l_orderkey", "l_linenumber"]).select("k", "day", "l_orderkey", "v")


@query("i10_incremental_merge", f"WITH {_BATCHES} SELECT k, day, l_orderkey, v FROM merged")
def i10_incremental(spark, d):
    """Both pulls go into a table by year, the newer one first and the older one twice."""
    old, new = (df.withColumns({"pull": F.lit(i), "year": F.year("day")}) for i, df in enumerate(_batches(spark, d)))
    base = scratch_path(spark, "merged")
    for batch, rows in (("new", new), ("old", old), ("old", old)):
        tables.merge_batch(rows, base, ["k", "day"], ["pull", "l_orderkey", "l_linenumber", "v"], ["year"], batch)
    return tables.read_table(spark, base, old.schema).select("k", "day", "l_orderkey", "v")


@query("i11_merge_summary", f"WITH {_BATCHES}, b AS (SELECT k, count(*) AS rows_before FROM u GROUP BY k) SELECT k, count(*) AS n_rows, min(strftime(day, '%Y-%m-%d')) AS first_local, max(strftime(day, '%Y-%m-%d')) AS last_local, any_value(rows_before) AS rows_before FROM merged JOIN b USING (k) GROUP BY k")
def i11(spark, d):
    old, new = _batches(spark, d)
    merged = ingest.merge_batches(old, new, ["k", "day"], ["l_orderkey", "l_linenumber"]).withColumn("local", F.col("day").cast("string"))
    return ingest.merge_summary(merged, "k", "local", old.unionByName(new))


@query("i12_fetch_outcome", "WITH s AS (SELECT s_suppkey AS k, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1), r AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1) SELECT s_suppkey AS k, coalesce(s.n, 0) AS n_sensors, coalesce(r.n, 0) AS n_rows, CASE WHEN s.n IS NULL THEN 'failed' WHEN r.n IS NULL THEN 'empty' ELSE 'done' END AS outcome FROM supplier LEFT JOIN s ON s.k = s_suppkey LEFT JOIN r ON r.k = s_suppkey")
def i12(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).filter("k % 7 <> 0")
    return ingest.fetch_outcome(s, s.filter("k % 5 <> 0"), rows, "k")


@query("i13_partitioned_round_trip", "SELECT user_id, event_id, value, CAST(year(ts) * 100 + month(ts) AS BIGINT) AS month FROM events")
def i13(spark, d):
    path = scratch_path(spark, "partitioned")
    ingest.write_partitioned(table(spark, d, "events").select("user_id", "event_id", "value", (F.year("ts") * 100 + F.month("ts")).alias("month")), path, ["month"])
    return ingest.read_combined(spark, path).select("user_id", "event_id", "value", F.col("month").cast("long").alias("month"))


@query("i13_station_csvs", "SELECT CAST(c_nationkey AS BIGINT) AS location_id, c_custkey, round(c_acctbal, 2) AS value FROM customer")
def i13_csvs(spark, d):
    """A folder for each station (nation), with its rows as CSV."""
    path = scratch_path(spark, "csvs")
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("value"))
    ingest.with_chunks(rows, ["c_nationkey"], ingest.FILE_ROWS).repartition("c_nationkey", "_chunk").drop("_chunk").write.partitionBy("c_nationkey").csv(path, header=True)
    return ingest.read_station_csvs(spark, path, "c_custkey bigint, value double", r"c_nationkey=(\d+)/").select("location_id", "c_custkey", F.round("value", 2).alias("value"))


@query("i14_sample_raster", f"WITH {C_POINTS}, {_CELLS}, px AS (SELECT o_orderkey AS image_id, (o_orderkey % 3) * 0.5 + 28.25 AS cell_lat, 76.6875 + (o_custkey % 3) * 0.625 AS cell_lon, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS aod FROM orders) SELECT c.id, px.image_id, px.aod FROM c JOIN px ON px.cell_lat = c.cell_lat AND px.cell_lon = c.cell_lon WHERE px.aod IS NOT NULL")
def i14(spark, d):
    px = table(spark, d, "orders").selectExpr("o_orderkey AS image_id", "cast((o_orderkey % 3) * 0.5 + 28.25 as double) AS cell_lat", "cast(76.6875 + (o_custkey % 3) * 0.625 as double) AS cell_lon", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS aod")
    stations = geo.snap_to_grid(points(spark, d), "lat", "lon", 0.5, 0.625, 0.0, 0.125).select("id", "cell_lat", "cell_lon")
    return ingest.sample_raster_at_points(stations, px, ["cell_lat", "cell_lon"], "aod").select("id", "image_id", "aod")


@query("i14_sample_raster_whole", f"WITH {C_POINTS}, {_CELLS}, px AS (SELECT o_orderkey AS image_id, (o_orderkey % 3) * 0.5 + 28.25 AS cell_lat, 76.6875 + (o_custkey % 3) * 0.625 AS cell_lon, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS aod FROM orders) SELECT c.id, px.image_id, px.aod FROM c JOIN px ON px.cell_lat = c.cell_lat AND px.cell_lon = c.cell_lon WHERE px.aod IS NOT NULL")
def i14_whole(spark, d):
    """The name under which i14_sample_raster first ran over every pixel."""
    px = table(spark, d, "orders").selectExpr("o_orderkey AS image_id", "cast((o_orderkey % 3) * 0.5 + 28.25 as double) AS cell_lat", "cast(76.6875 + (o_custkey % 3) * 0.625 as double) AS cell_lon", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS aod")
    stations = geo.snap_to_grid(points(spark, d), "lat", "lon", 0.5, 0.625, 0.0, 0.125).select("id", "cell_lat", "cell_lon")
    return ingest.sample_raster_at_points(stations, px, ["cell_lat", "cell_lon"], "aod").select("id", "image_id", "aod")


@query("i14_tiled_pixels", f"WITH {C_POINTS}, {_CELLS}, px AS (SELECT o_orderkey AS image_id, 20.25 + 0.5 * (o_orderkey % 40) AS cell_lat, 70.4375 + 0.625 * (o_custkey % 24) AS cell_lon, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS aod FROM orders) SELECT c.id, px.image_id, px.aod FROM c JOIN px ON px.cell_lat = c.cell_lat AND px.cell_lon = c.cell_lon WHERE px.aod IS NOT NULL")
def i14_tiled(spark, d):
    """Pixels of a region far larger than the stations' are stored by tiles of 2 degrees."""
    px = table(spark, d, "orders").selectExpr("o_orderkey AS image_id", "cast(20.25 + 0.5 * (o_orderkey % 40) as double) AS cell_lat", "cast(70.4375 + 0.625 * (o_custkey % 24) as double) AS cell_lon", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS aod")
    path = scratch_path(spark, "tiles")
    ingest.write_tiles(px, path, ["cell_lat", "cell_lon"], 2.0, ["image_id"])
    stations = geo.snap_to_grid(points(spark, d), "lat", "lon", 0.5, 0.625, 0.0, 0.125).select("id", "cell_lat", "cell_lon")
    return ingest.sample_tiles(stations, spark, path, ["cell_lat", "cell_lon"], "aod", 2.0).select("id", "image_id", "aod")


@query("i15_cell_series", f"WITH {C_POINTS}, {_CELLS}, {_NUMBERED}, grid AS (SELECT event_id, (event_id % 3) * 0.5 + 28.25 AS cell_lat, 76.6875 + (user_id % 3) * 0.625 AS cell_lon, value FROM events) SELECT grid.event_id, k.cell_id, grid.value FROM grid JOIN (SELECT DISTINCT cell_lat, cell_lon, cell_id FROM m) k ON k.cell_lat = grid.cell_lat AND k.cell_lon = grid.cell_lon")
def i15(spark, d):
    grid = table(spark, d, "events").selectExpr("event_id", "cast((event_id % 3) * 0.5 + 28.25 as double) AS cell_lat", "cast(76.6875 + (user_id % 3) * 0.625 as double) AS cell_lon", "value")
    return ingest.cell_series(mapping(spark, d), grid, ["cell_lat", "cell_lon"]).select("event_id", F.col("cell_id").cast("long").alias("cell_id"), "value")


# ---- streaming


# a pull that repeats hours already there has the same values, so whichever arrives first is the one
@query("s1_ingest_stream", "SELECT user_id AS location_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS datetime_from_utc, max(value) AS value FROM events GROUP BY ALL")
def s1(spark, d):
    entry = F.expr("named_struct('value', value, 'period', named_struct('datetimeFrom', named_struct('utc', date_format(ts, \"yyyy-MM-dd'T'HH:00:00'Z'\"))))")
    hours = table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("value"))
    pulls = hours.withColumn("pull", F.explode(F.array(F.lit(1), F.lit(2))))
    dealt = ingest.with_chunks(pulls, ["user_id", "pull"], PAGE_ROWS)
    pages = dealt.groupBy(F.col("user_id").alias("location_id"), "pull", "_chunk").agg(F.min("user_id").alias("sensor_id"), F.collect_list(entry).alias("results")).drop("pull", "_chunk")
    landed, out, state = (scratch_path(spark, x) for x in ("landed", "ingested", "state"))
    pages.write.json(landed)
    streams.ingest_stream(spark, landed, out, state, watermark="90 days").awaitTermination()
    return spark.read.parquet(out).select("location_id", "datetime_from_utc", "value")


@query("s2_daily_stream", "WITH g AS (SELECT user_id AS station, CAST(ts AS DATE) AS date, round(avg(value), 6) AS daily_mean, count(value) AS n_used FROM events GROUP BY 1, 2) SELECT * FROM g WHERE n_used >= 2 AND date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def s2(spark, d):
    source = table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    daily = streams.daily_stream(rows.select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "value"), ["station"], "ts", "value", 2)
    out, state = (scratch_path(spark, x) for x in ("daily", "state"))
    daily.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(daily.schema).parquet(out).select("station", "date", r6("daily_mean"), "n_used")


# the older pull has the hours before 21 January with the largest value of each, the newer one those from 10 January with the smallest
_PULLS = """o AS (SELECT user_id AS location_id, date_trunc('hour', ts) AS h, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY ALL),
    n AS (SELECT user_id AS location_id, date_trunc('hour', ts) AS h, min(value) - 1000 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)"""


@query("s1_old_pull_wins", f"WITH {_PULLS} SELECT location_id, strftime(h, '%Y-%m-%dT%H:%M:%SZ') AS datetime_from_utc, coalesce(o.value, n.value) AS value, CAST(CASE WHEN o.h IS NULL THEN 2 ELSE 1 END AS BIGINT) AS pull FROM o FULL JOIN n USING (location_id, h)")
def s1_old_pull(spark, d):
    """The newer pull lands first."""
    entry = F.expr("named_struct('value', value, 'period', named_struct('datetimeFrom', named_struct('utc', date_format(hour, \"yyyy-MM-dd'T'HH:00:00'Z'\"))))")
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    pulls = {2: e.filter("ts >= timestamp_ntz'2024-01-10'").groupBy("user_id", "hour").agg((F.min("value") - 1000).alias("value")),
             1: e.filter("ts < timestamp_ntz'2024-01-21'").groupBy("user_id", "hour").agg(F.max("value").alias("value"))}
    landed, base, state = (scratch_path(spark, x) for x in ("landed", "merged", "state"))
    for number, hours in pulls.items():
        dealt = ingest.with_chunks(hours, ["user_id"], PAGE_ROWS)
        pages = dealt.groupBy(F.col("user_id").alias("location_id"), "_chunk").agg(F.min("user_id").alias("sensor_id"), F.collect_list(entry).alias("results")).drop("_chunk")
        pages.write.json(f"{landed}/pull={number}")
        streams.merge_stream(spark, landed, base, state).awaitTermination()
    return streams.merged_measurements(spark, base).select("location_id", "datetime_from_utc", "value", F.col("pull").cast("long").alias("pull"))


def _revised(spark, d):
    """Purchases land after all other events."""
    e = table(spark, d, "events").select(F.col("user_id").alias("station"), "ts", "value", "event_type")
    landed, base, state = (scratch_path(spark, x) for x in ("landed", "revised", "state"))
    for late in (False, True):
        e.filter(f"(event_type = 'purchase') = {late}").write.mode("append").parquet(landed)
        rows = spark.readStream.schema(e.schema).parquet(landed)
        streams.revise_stream(rows, base, state, ["station"], "ts", "value").awaitTermination()
    return rows, base


@query("s2_revised_daily", "SELECT user_id AS station, CAST(ts AS DATE) AS date, round(avg(value), 6) AS daily_mean, count(value) AS n_used FROM events GROUP BY 1, 2 HAVING count(value) >= 2")
def s2_revised(spark, d):
    rows, base = _revised(spark, d)
    return streams.revised_daily(spark, base, rows, ["station"], "ts", "value", 2).select("station", "date", r6("daily_mean"), "n_used")


@query("s2_late_rows", "SELECT user_id AS station, CAST(ts AS DATE) AS date, count(*) AS n_late FROM events WHERE event_type = 'purchase' AND ts < (SELECT max(ts) FROM events WHERE event_type <> 'purchase') - INTERVAL 2 DAY GROUP BY 1, 2")
def s2_late(spark, d):
    rows, base = _revised(spark, d)
    return streams.late_counts(spark, base, rows, ["station"], "ts")


# ---- chains

@query("chain_ground", f"WITH {C_HOURLY}, {C_POINTS} SELECT station AS location_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS pm25_daily, count(value) AS hours_used, {SEASON_SQL.format('CAST(ts AS DATE)')} AS season FROM h WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND hour(ts) BETWEEN 4 AND 20 AND station <> 3 AND station IN (SELECT id FROM p WHERE status = 'KEEP') GROUP BY station, CAST(ts AS DATE) HAVING count(value) >= 1")
def chain_ground(spark, d):
    hours = hourly(spark, d).select(F.col("station").alias("location_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'").alias("datetime_from_local"), "value")
    config = chains.GroundConfig("2024-01-05", "2024-01-25", tuple(range(4, 21)), (3,), 1)
    out = chains.ground_daily(hours, points(spark, d).withColumnRenamed("id", "location_id"), config)
    return out.select("location_id", "date", r6("pm25_daily"), "hours_used", "season")


_AOD = f"b2 AS (SELECT location_id, date, CASE WHEN aod_055 <> -28672 THEN aod_055 * 0.001::DOUBLE END AS a55, CASE WHEN aod_047 <> -28672 THEN aod_047 * 0.001::DOUBLE END AS a47 FROM b WHERE qa_aod IN (0, 3) AND location_id IN (SELECT id FROM p WHERE status = 'KEEP'))"


@query("chain_overpass", f"WITH {C_OVER}, {C_POINTS}, {_BITS}, {_AOD} SELECT location_id, date, round(avg(a55), 6) AS aod_055, round(avg(a47), 6) AS aod_047, count(a55) AS n_overpasses, {SEASON_SQL.format('date')} AS season FROM b2 GROUP BY location_id, date")
def chain_overpass(spark, d):
    out = chains.overpass_daily(overpass(spark, d), points(spark, d).withColumnRenamed("id", "location_id"), chains.OverpassConfig(SCALES))
    return out.select("location_id", "date", r6("aod_055"), r6("aod_047"), "n_overpasses", "season")


_MODEL = """e AS (SELECT m.cell_id, date_trunc('hour', ts) AS h, value AS v FROM events JOIN m ON m.id = user_id),
    hf AS (SELECT cell_id, h, v, row_number() OVER (PARTITION BY cell_id, h ORDER BY v) AS r FROM e WHERE hour(h) BETWEEN 4 AND 20),
    md AS (SELECT cell_id, CAST(h AS DATE) AS date, avg(v) AS tau, count(v) AS n FROM hf WHERE r = 1 AND v BETWEEN 0 AND 200 GROUP BY ALL HAVING count(v) >= 2)"""


def _model(spark, d):
    """Events of a station as the hourly series of its cell; stations of a cell give repeated hours."""
    m = mapping(spark, d).withColumnRenamed("id", "location_id")
    zone = F.unix_millis(F.lit("1970-01-01").cast("timestamp_ntz").cast("timestamp"))
    hour = F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")) - zone
    e = table(spark, d, "events").join(m, F.col("user_id") == F.col("location_id"))
    hourly_cells = e.select("cell_id", F.col("cell_lat").alias("latitude"), F.col("cell_lon").alias("longitude"), hour.alias("time"), F.col("value").alias("TOTEXTTAU"))
    return chains.model_daily(hourly_cells, m, config=chains.ModelConfig(hours=tuple(range(4, 21)), high=200.0))


@query("chain_model", f"WITH {C_POINTS}, {_CELLS}, {_NUMBERED}, {_MODEL} SELECT m.id AS location_id, CAST(m.cell_id AS BIGINT) AS cell_id, md.date, round(md.tau, 6) AS totexttau, md.n AS n_hours_available FROM m JOIN md ON md.cell_id = m.cell_id")
def chain_model(spark, d):
    return _model(spark, d).select("location_id", F.col("cell_id").cast("long").alias("cell_id"), "date", r6("totexttau"), "n_hours_available")


# overpasses of the month of the events
_JANUARY = [x if not x.endswith("AS date") else "DATE '2024-01-01' + CAST(l_orderkey % 31 AS INT) AS date" for x in OVERPASS]
_FUSED = f"""WITH {_cte("o", _JANUARY, "lineitem")}, {C_HOURLY}, {C_POINTS}, {_CELLS}, {_NUMBERED}, {_BITS}, {_AOD}, {_MODEL},
    ground AS (SELECT station AS location_id, CAST(ts AS DATE) AS date, avg(value) AS pm FROM h WHERE hour(ts) BETWEEN 4 AND 20 AND station IN (SELECT id FROM p WHERE status = 'KEEP') GROUP BY 1, 2 HAVING count(value) >= 2),
    aod AS (SELECT location_id, date, avg(a55) AS aod FROM b2 GROUP BY 1, 2),
    model AS (SELECT m.id AS location_id, m.cell_id, md.date, md.tau FROM m JOIN md ON md.cell_id = m.cell_id),
    fit AS (SELECT cell_id, regr_slope(aod, tau) AS slope, regr_intercept(aod, tau) AS intercept FROM aod JOIN model USING (location_id, date) GROUP BY cell_id HAVING regr_count(aod, tau) >= 2)"""


@query("chain_fused", f"""{_FUSED} SELECT location_id, date, round(pm, 6) AS pm25_daily, round(coalesce(aod, intercept + slope * tau), 4) AS filled,
    CASE WHEN aod IS NOT NULL THEN 'maiac' WHEN intercept + slope * tau IS NOT NULL THEN 'merra2_gapfilled' END AS aod_source
    FROM ground LEFT JOIN aod USING (location_id, date) LEFT JOIN model USING (location_id, date) LEFT JOIN fit USING (cell_id)""")
def chain_fused(spark, d):
    registry = points(spark, d).withColumnRenamed("id", "location_id")
    hours = hourly(spark, d).select(F.col("station").alias("location_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'").alias("datetime_from_local"), "value")
    ground = chains.ground_daily(hours, registry, chains.GroundConfig("2024-01-01", "2024-01-31", tuple(range(4, 21)), (), 2))
    aod = chains.overpass_daily(table(spark, d, "lineitem", _JANUARY), registry, chains.OverpassConfig(SCALES))
    out = chains.fused(ground, aod, _model(spark, d), "cell_id")
    return out.select("location_id", "date", r6("pm25_daily"), F.round("filled", 4).alias("filled"), "aod_source")
