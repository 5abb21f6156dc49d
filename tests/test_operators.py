"""Small frames: nulls, ties, limits, empty tables, and properties against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerosieve.functions.exprs import haversine_km, local_clock, round_even, season
from aerosieve.operators import fusion, geo, qc, temporal
from aerosieve.plans import chains
from aerosieve.sources import ingest, schemas
from aerosieve.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_local_clock_keeps_wall_clock(spark):
    for zone in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([("2025-03-01T00:30:00+05:30",), ("bad",), (None,)], "s string")
        assert [r[0] for r in df.select(local_clock("s")).collect()] == [dt.datetime(2025, 3, 1, 0, 30), None, None]
        ms = spark.createDataFrame([(1740805200123,), (None,)], "ms long")
        got = temporal.epoch_ms_to_utc(ms, "ms").collect()
        assert (got[0]["hour"], got[0]["date"]) == (5, dt.date(2025, 3, 1)) and got[1]["hour"] is None
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_round_even_and_season(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(round_even("x", 0)).collect()] == [0.0, 0.0, 2.0, None]
    d = spark.sql("select explode(array(date'2025-03-01', date'2025-09-30', date'2025-10-01', date'2025-12-01', date'2026-02-28', cast(null as date))) as d")
    assert [r[0] for r in d.select(season("d")).collect()] == ["summer", "monsoon", "post_monsoon", "winter", "winter", None]


def test_windows_and_daily(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    data = [(1, t("2025-03-01 09:59:00"), 1.0), (1, t("2025-03-01 10:00:00"), 2.0), (1, t("2025-03-01 13:59:59"), 4.0), (1, t("2025-03-01 14:00:00"), 9.0),
            (2, t("2026-02-28 10:59:59"), None), (2, t("2026-02-28 11:00:00"), 3.0), (2, t("2026-03-01 00:00:00"), 3.0), (None, t("2025-03-01 10:00:00"), 5.0)]
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz, v double")
    inside = temporal.trim_window(df, "ts", "2025-03-01", "2026-02-28")
    assert inside.count() == 7
    assert temporal.trim_report(df, "ts", "2025-03-01", "2026-02-28").collect()[0][:] == (8, 7, 1)
    day = temporal.daily_mean(temporal.hour_window(inside, "ts", range(10, 14)), ["k"], "ts", "v", 2)
    assert rows(day) == [(1, dt.date(2025, 3, 1), 3.0, 2)]
    assert temporal.exclude_keys(df, "k", [1]).count() == 4  # the null key stays
    assert temporal.daily_mean(df.limit(0), ["k"], "ts", "v").count() == 0
    span = temporal.season_span(temporal.with_season(df, "ts"), "ts", "k").orderBy("season_order").collect()
    assert [r["n_rows"] for r in span] == [6, 0, 0, 2]
    pivot = {r["k"]: r["total"] for r in temporal.season_pivot(temporal.with_season(df, "ts"), "k", "v").collect()}
    assert pivot == {1: 4, 2: 2, None: 1}


def test_completeness_and_gaps(spark):
    days = spark.createDataFrame([(1, dt.date(2025, 1, 1) + dt.timedelta(n)) for n in range(219)], "k int, date date")
    reg = spark.createDataFrame([(1,), (2,)], "k int")
    got = rows(temporal.completeness(days, "k", "2025-01-01", "2025-12-31", 60.0, reg).select("k", "actual_days", "possible_days", "pct_complete", "passes"))
    assert got == [(1, 219, 365, 60.0, True), (2, 0, 365, 0.0, False)]
    slots = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, h)) for h in range(23)], "k int, ts timestamp_ntz")
    missing = temporal.missing_slots(slots, "k", "ts", "2025-01-01", "2025-01-02")
    assert missing.count() == 25
    assert rows(temporal.missing_days(missing, "k", 24)) == [(1, dt.date(2025, 1, 2))]


def _stuck(series, least):
    out = {}
    by = {}
    for k, t, v in series:
        by.setdefault(k, []).append((t, v))
    for k, s in by.items():
        s.sort(key=lambda x: x[0])
        found, n = [], 0
        for i, (_, v) in enumerate(s):
            n = n + 1 if i and v is not None and v == s[i - 1][1] else 1
            if i + 1 == len(s) or s[i + 1][1] is None or s[i + 1][1] != v or v is None:
                found.append(n)
        big = [x for x in found if x >= least]
        if big:
            out[k] = (len(big), sum(big), max(big))
    return out


def test_stuck_runs_property(spark):
    rng = random.Random(5)
    series = [(k, t, rng.choice([None, 0.0, 1.0, 1.0])) for k in range(12) for t in range(rng.randrange(0, 60))]
    df = spark.createDataFrame(series, "k int, t int, v double")
    want = _stuck(series, 3)
    got = {r["k"]: (r["n_runs"], r["rows_in_runs"], r["longest_run"]) for r in qc.stuck_runs(df, "k", ["t"], "v").collect()}
    assert got == want
    for width in (1, 2, 7, 100):
        b = qc.stuck_runs_bucketed(df, "k", ["t"], "v", F.floor(F.col("t") / width))
        assert {r["k"]: (r["n_runs"], r["rows_in_runs"], r["longest_run"]) for r in b.collect()} == want


def test_stuck_runs_along_time(spark):
    """Times and dates are cut into buckets; runs across midnights and months stay whole, also where times are NULL or tied."""
    rng = random.Random(6)
    start = dt.datetime(2025, 1, 30)
    series = [(k, t, rng.choice([None, 1.0, 1.0, 2.0])) for k in range(5) for t in range(200)] + [(9, t, 7.0) for t in range(400)]
    want = _stuck(series, 3)
    df = spark.createDataFrame([(k, start + dt.timedelta(hours=5 * t), start.date() + dt.timedelta(days=t), t, v) for k, t, v in series], "k int, ts timestamp_ntz, d date, t int, v double")
    for order in (["ts", "t"], ["d", "t"], ["t"]):
        got = {r["k"]: (r["n_runs"], r["rows_in_runs"], r["longest_run"]) for r in qc.stuck_runs(df, "k", order, "v").collect()}
        assert got == want and got[9] == (1, 400, 400)
    late = df.withColumn("ts", F.when(F.col("t") >= 10, F.col("ts")))  # ten rows without a time come first
    assert {r["k"]: r["n_runs"] for r in qc.stuck_runs(late, "k", ["ts", "t"], "v").collect()} == {k: w[0] for k, w in want.items()}


def test_first_of_a_hot_key_is_found_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("if(id < 900, null, id) AS k", "id AS t")
    for out in (ingest.keep_first(df, ["k"], ["t"]), qc.dedup_keep_first(df, ["k"], ["t"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and out.filter("k is null").collect()[0]["t"] == 0


def test_location_pages(spark):
    df = spark.createDataFrame([(1, "a", "no2,pm25", 2), (1, "a", "o3,pm25", 3), (2, None, "", 0), (2, None, "", 1)], "location_id long, name string, parameters string, sensor_count int")
    assert rows(ingest.join_location_pages(df)) == [(1, "a", "no2,o3,pm25", 5), (2, None, "", 1)]


def test_range_duplicates_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.01), (3, 1000.0), (4, 1000.01), (5, None), (6, math.nan), (None, 5.0), (None, 5.0)], "k int, v double")
    assert rows(qc.range_report(df, "v").select("k", "violation")) == [(2, "below"), (4, "above")]
    assert qc.range_filter(df, "v", 0, 1000).count() == 4
    assert rows(qc.duplicates(df, ["k"]).select("k", "n_in_group")) == [(None, 2), (None, 2)]
    assert qc.excess_duplicates(df, ["k"]).collect()[0][:] == (1, 1)
    assert qc.excess_duplicates(df.limit(0), ["k"]).collect()[0][:] == (0, 0)
    z = {r["k"]: r["pct_zero"] for r in qc.zero_profile(df, "k", "v").collect()}
    assert z[1] == 100.0 and z[2] == 0.0 and z[5] == 0.0


def test_quality_words(spark):
    df = spark.createDataFrame([(0,), (2817,), ((4) | (6 << 5) | (2 << 8) | (3 << 13),), (None,)], "q int")
    got = qc.label_codes(qc.decode_bits(df, "q")).collect()
    assert [r["qa_aod"] for r in got] == [0, 11, 2, None]
    assert got[0]["qa_aod_label"] == "Best quality" and got[1]["cloud_mask_label"] == "Clear"
    assert all(got[2][f"{c}_label"] is None for c in qc.LABELS)
    kept, dropped = qc.strictness_filter(qc.decode_bits(df, "q"), "qa_aod", "strict")
    assert (kept.count(), dropped.count()) == (1, 3)
    with pytest.raises(ValueError):
        qc.strictness_filter(df, "q", "NOT_SET")
    s = qc.fill_to_null_and_scale(spark.createDataFrame([(-28672, 8000), (100, None)], "a int, b int"), {"a": 0.001, "b": 0.001})
    assert rows(s) == [(0.1, None), (None, 8.0)]


def test_gates(spark):
    m = spark.createDataFrame([(1, 28.75, 77.3125)], "cell_id int, cell_lat double, cell_lon double")
    ok = spark.createDataFrame([(1, 28.76, 77.3), (9, 0.0, 0.0)], "cell_id int, latitude double, longitude double")
    args = ("cell_id", "latitude", "longitude", "cell_lat", "cell_lon")
    assert qc.coordinate_gate(ok, m, *args).count() == 2
    assert rows(qc.unmapped_cells(ok, m, "cell_id")) == [(9,)]
    with pytest.raises(ValueError, match="1 "):
        qc.coordinate_gate(ok.withColumn("latitude", F.lit(28.9)), m, *args)
    reg = spark.createDataFrame([(1, "KEEP"), (2, "KEEP"), (3, "DROP_x"), (4, None)], "id int, status string")
    report = spark.createDataFrame([(2, 10), (3, 10)], "id int, n int")
    bad = qc.review(reg, "id", {"runs": (report, F.col("n") > 5)})
    assert rows(bad.select("id")) == [(2,), (4,)]
    with pytest.raises(ValueError):
        qc.review_gate(bad, "id")


def test_coordinates_at_the_tolerance(spark):
    """Id 2 is an ulp above 28.45, which is 0.2 from its cell's centre; 3 and 4 are a ten-thousandth too far, 5 has no coordinates."""
    m = spark.createDataFrame([(1, 28.25, 77.3125)], "cell_id int, cell_lat double, cell_lon double")
    df = spark.createDataFrame([(1, 28.45, 77.0625), (2, 284500 * 0.0001, 77.0625), (3, 28.4501, 77.0625), (4, 28.25, 77.0624), (5, None, None)], "id int, lat double, lon double").withColumn("cell_id", F.lit(1))
    args = (df, m, "cell_id", "lat", "lon", "cell_lat", "cell_lon", 0.2)
    assert rows(qc.coordinate_violations(*args, tol_lon=0.25, digits=6).select("id")) == [(3,), (4,)]
    assert rows(qc.coordinate_violations(*args, tol_lon=0.25).select("id")) == [(2,), (3,), (4,)]
    assert rows(qc.coordinate_violations(*args, digits=6).select("id")) == [(1,), (2,), (3,), (4,)]


def test_close_pairs_property(spark):
    rng = random.Random(3)
    pts = []
    for i in range(400):
        c = rng.choice([(28.6, 77.2), (89.99, 0.0), (-89.99, 10.0), (0.0, 179.995), (0.0, -179.995), (60.0, 0.0)])
        lat, lon = max(-90.0, min(90.0, c[0] + rng.gauss(0, 0.02))), c[1] + rng.gauss(0, 0.02 if abs(c[0]) < 80 else 60)
        pts.append((i, lat, (lon + 180) % 360 - 180))
    pts += [(900, 10.0, 10.0), (901, 10.0, 10.0), (902, None, 1.0)]

    def km(a, b):
        la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    good = [p for p in pts if p[1] is not None]
    for limit in (0.5, 1.5, 40.0):
        want = {(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1:] if km(a, b) < limit}
        assert {(r[0], r[1]) for r in geo.close_pairs(df, "id", "lat", "lon", limit).collect()} == want
    nn = {r["id"]: r["neighbour"] for r in geo.nearest_neighbour(df, "id", "lat", "lon").collect()}
    assert set(nn) == {p[0] for p in good}
    for p in good[:60]:
        best = min((round(km(p, q), 3), q[0]) for q in good if q[0] != p[0])
        assert abs(km(p, next(q for q in good if q[0] == nn[p[0]])) - best[0]) < 1e-3
    assert geo.close_pairs(df.limit(0), "id", "lat", "lon", 1.5).count() == 0


def _greedy(pairs):
    of, n = {}, 0
    for _, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in of and b not in of:
            n += 1
            of[a] = of[b] = n
        elif a in of and b not in of:
            of[b] = of[a]
        elif b in of and a not in of:
            of[a] = of[b]
    return of


def test_cluster_pairs_property(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        pairs = list({(a, b): (a, b, float(rng.randrange(1, 6))) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(22)) if a < b}.values())
        df = spark.createDataFrame(pairs, "id_a int, id_b int, distance_km double")
        want = _greedy(pairs)
        got = geo.cluster_pairs(df).collect()
        assert {(r["id_a"], r["id_b"]): r["cluster_id"] for r in got} == {(a, b): want[a] for a, b, _ in pairs}
        assert all(r["is_bridge"] == (want[r["id_a"]] != want[r["id_b"]]) for r in got)
        assert not any(r["is_bridge"] for r in geo.cluster_pairs(df, "components").collect())
    assert geo.cluster_pairs(df.limit(0)).count() == 0


def test_correlation_and_fit(spark):
    daily = spark.createDataFrame([(k, d, v) for k, s in {1: [1, 2, 3], 2: [2, 4, 6.5], 3: [5, 5, 5]}.items() for d, v in enumerate(map(float, s))] + [(4, 0, 1.0)], "k int, date int, v double")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "id_a int, id_b int")
    got = {r["id_b"]: (r["matched_days"], r["correlation"]) for r in geo.pair_correlation(pairs, daily, "k", "date", "v").collect()}
    assert got[2][1] == 0.998 and got[3] == (3, None) and 4 not in got
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 2.0), ("a", None, 4.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", None, None)], "g string, y double, x double")
    fit = fusion.calibrate(df, "g", "y", "x")
    filled = {(r["g"], r["x"]): (r["filled"], r["source"]) for r in fusion.gap_fill(df, fit, "g", "y", "x").collect()}
    assert filled[("a", 4.0)] == (7.0, "merra2_gapfilled") and filled[("c", None)] == (None, None) and filled[("a", 1.0)] == (1.0, "maiac")


def test_grid_goldens(spark):
    df = spark.createDataFrame([(1, 28.6, 77.2), (2, 28.4, 77.3), (3, 28.6, 76.9)], "id int, lat double, lon double")
    got = {r["id"]: (r["cell_lat"], r["cell_lon"], r["cell_id"]) for r in geo.assign_cell_id(geo.snap_to_grid(df, "lat", "lon", 0.5, 0.625, 0.0, 0.125), "id").collect()}
    assert got == {1: (28.75, 77.3125, 1), 2: (28.25, 77.3125, 2), 3: (28.75, 76.6875, 3)}
    assert df.select(haversine_km("lat", "lon", "lat", "lon").alias("d")).filter("d <> 0").count() == 0


def test_landing(spark, tmp_path):
    line = '{"location_id": 1, "sensor_id": 2, "results": [{"value": 5.5, "parameter": {"name": "pm25"}, "period": {"datetimeFrom": {"utc": "2025-03-01T05:00:00Z", "local": "2025-03-01T10:30:00+05:30"}}}, {"value": 6.0}]}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(line)
    pages = spark.read.schema(schemas.MEASUREMENTS_JSON).json(str(tmp_path / "in"))
    got = ingest.flatten_measurements(pages).orderBy("value").collect()
    assert got[0]["datetime_from_utc"] == "2025-03-01T05:00:00Z" and got[1]["parameter_name"] is None
    assert len(ingest.flatten_measurements(pages, "wide").columns) == 24
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    streams.ingest_stream(*args).awaitTermination()
    (tmp_path / "in" / "b.json").write_text(line)  # lands again: a duplicate hour
    streams.ingest_stream(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "pm25_loc_77.csv").write_text("a\n1\n")
    assert ingest.read_station_csvs(spark, str(tmp_path / "*.csv"), "a int").collect()[0]["location_id"] == 77


def test_merge_keeps_old(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "k int, utc string, v double")
    new = spark.createDataFrame([(1, "a", 9.0), (3, "a", 3.0)], "k int, utc string, v double")
    assert rows(ingest.merge_batches(old, new, ["k", "utc"], ["v"])) == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)]
    loc = spark.createDataFrame([(1, "PM25,no2"), (2, "pm250"), (3, None)], "k int, p string")
    assert ingest.reports_parameter(loc, "p", "pm25").count() == 2 and ingest.reports_parameter(loc, "p", "pm25", exact=True).count() == 1


def test_chains(spark):
    reg = spark.createDataFrame([(1, "KEEP"), (2, "DROP_x")], "location_id int, status string")
    hours = [(k, f"2025-03-0{d}T{h}:00:00+05:30", float(h)) for k in (1, 2) for d in (1, 2) for h in (10, 11, 14)]
    ground = chains.ground_daily(spark.createDataFrame(hours, "location_id int, datetime_from_local string, value double"), reg)
    assert rows(ground) == [(1, dt.date(2025, 3, d), 10.5, 2, "summer") for d in (1, 2)]
    over = spark.createDataFrame([(1, "2025-03-01", 500, 400, 30, 0), (1, "2025-03-01", -28672, 400, 30, 0), (1, "2025-03-02", 700, 1, 1, 5 << 8)], "location_id int, date string, aod_055 int, aod_047 int, aod_uncertainty int, aod_qa int")
    aod = chains.overpass_daily(over, reg)
    assert rows(aod.select("location_id", "date", "aod_055", "n_overpasses")) == [(1, dt.date(2025, 3, 1), 0.5, 1)]
    cells = spark.createDataFrame([(1, 28.75, 77.3125, 1740787200000 + (d * 24 + h) * 3600000, 0.2 * (d + 1)) for d in (0, 1) for h in (5, 6, 7, 7)], "cell_id int, latitude double, longitude double, time long, TOTEXTTAU double")
    mapping = spark.createDataFrame([(1, 1, 28.75, 77.3125)], "location_id int, cell_id int, cell_lat double, cell_lon double")
    model = chains.model_daily(cells, mapping)
    assert {r["n_hours_available"] for r in model.collect()} == {3}
    out = chains.fused(ground, aod, model, "cell_id", min_n=1)
    assert {(r["date"].day, r["aod_source"]) for r in out.collect()} == {(1, "maiac"), (2, None)}


def test_stream_equals_batch(spark, tmp_path):
    data = [(k, dt.datetime(2025, 1, d, h), float(h)) for k in (1, 2) for d in range(1, 9) for h in (1, 5, 9)]
    df = spark.createDataFrame(data, "k int, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.daily_stream(live, ["k"], "ts", "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    batch = rows(temporal.daily_mean(df, ["k"], "ts", "v"))
    assert got and set(got) <= set(batch) and len(got) == sum(1 for r in batch if r[1] <= dt.date(2025, 1, 5))

def test_write_partitioned_spreads_a_hot_month(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2800, 202401).when(F.col("id") < 2900, 202402).alias("month"))
    kept = ingest.with_chunks(df, ["month"], 250).groupBy("month", "_chunk").count().collect()
    assert sum(r["count"] for r in kept) == 3000 and max(r["count"] for r in kept) < 400 and len(kept) == 12 + 2
    ingest.write_partitioned(df, str(tmp_path / "p"), ["month"], rows=250)
    back = ingest.read_combined(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.select("id", "month").collect())) == sorted(map(tuple, df.collect()))
    assert len(list((tmp_path / "p" / "month=202401").glob("*.parquet"))) > 1


def test_landed_pages_are_bounded(spark, monkeypatch):
    from aerosieve.plans import catalog

    monkeypatch.setattr(catalog, "PAGE_ROWS", 20, raising=False)
    paths = {}
    real = catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda s, x: paths.setdefault(x, real(s, x)))
    rows = catalog.QUERIES["s1_ingest_stream"](spark, "/root/testdata/sf0.001").count()
    pages = spark.read.json(paths["landed"]).select(F.size("results").alias("n")).toPandas()["n"]
    assert rows and pages.sum() == 2 * rows and pages.max() < 50  # two pulls of every hour


def _km(a, b):
    la, lo, lb, lp = (np.radians(x) for x in (a[..., 0], a[..., 1], b[..., 0], b[..., 1]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


def _nearest(at, ids, some, k):
    """{id: [(km, id)]} by all distances."""
    out = {}
    for i in some:
        d = np.rint(_km(at[i][None], at) * 1000) / 1000
        d[i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(float(d[j]), int(ids[j])) for j in order if np.isfinite(d[j])]
    return out


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["rank"], r["nn_km"], r["neighbour"]))
    return {i: [x[1:] for x in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_neighbour_property(spark, k):
    rng = np.random.default_rng(k)
    parts = [np.column_stack([rng.normal(28.6, 0.001, 150), rng.normal(77.2, 0.001, 150)]), np.column_stack([rng.uniform(27, 30, 80), rng.uniform(75, 79, 80)]),
             np.column_stack([90 - np.abs(rng.normal(0, 0.01, 30)), rng.uniform(-180, 180, 30)]), np.column_stack([rng.normal(0, 0.01, 30), (rng.normal(180, 0.01, 30) + 180) % 360 - 180]),
             np.repeat([[10.0, 10.0]], 40, axis=0), [[-90.0, 0.0], [-40.0, -60.0], [28.6, 77.2]], np.column_stack([rng.normal(28.6, 1e-7, 40), np.full(40, 77.25)])]
    at = np.concatenate(parts)
    ids = rng.permutation(len(at)) * 3
    odd = [(90_000, None, 1.0), (90_001, float("nan"), 1.0), (None, 28.6, 77.2)]
    rows = [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, at)]
    df = spark.createDataFrame(rows + rows[:20] + odd, "id long, lat double, lon double")
    assert _found(geo.nearest_neighbour(df, "id", "lat", "lon", k=k)) == _nearest(at, ids, range(len(at)), k)
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 90.0)], "id long, lat double, lon double")
    assert {i: [n for _, n in v] for i, v in _found(geo.nearest_neighbour(few, "id", "lat", "lon", k=5)).items()} == {1: [2], 2: [1]}
    assert geo.nearest_neighbour(few.limit(0), "id", "lat", "lon").count() == 0 and geo.nearest_neighbour(few.limit(1), "id", "lat", "lon").count() == 0


def test_nearest_neighbour_in_a_dense_city(spark):
    """100,000 points within 4 km and 300 around them: far fewer candidates than pairs, results exact."""
    rng = np.random.default_rng(8)
    at = np.concatenate([np.column_stack([rng.uniform(28.60, 28.636, 100_000), rng.uniform(77.20, 77.241, 100_000)]), np.column_stack([rng.uniform(28.0, 29.2, 300), rng.uniform(76.6, 77.8, 300)])])
    ids = np.arange(len(at))
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "lat": at[:, 0], "lon": at[:, 1]}))
    p = df.groupBy("id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    near = geo._candidates(geo._cut(geo._places(p, 1)), 1)
    n = near.groupBy("key").count().agg(F.sum("count"), F.max("count")).first()
    assert n[0] < 200 * len(at) and n[1] <= len(at)
    some = [*range(0, 100_000, 997), *range(100_000, 100_300)]
    got = _found(geo.nearest_neighbour(df, "id", "lat", "lon", k=1).filter(F.col("id").isin([int(ids[i]) for i in some])))
    assert got == _nearest(at, ids, some, 1)


def test_clusters_are_numbered_over_all_partitions(spark):
    pairs = [(2 * i, 2 * i + 1, round(5 - i * 0.01, 2)) for i in range(300)]
    got = geo.cluster_pairs(spark.createDataFrame(pairs, "id_a int, id_b int, distance_km double")).collect()
    assert {r["id_a"]: r["cluster_id"] for r in got} == {2 * i: 300 - i for i in range(300)}
