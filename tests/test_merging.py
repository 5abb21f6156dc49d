"""Tables that batches are merged into, and the streams that write them."""

import datetime as dt
import json
import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from aerosieve.operators import temporal
from aerosieve.sources import ingest, tables
from aerosieve.streaming import streams

ROW = "k int, t string, v double, pull int, month int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(base, month):
    return {p.name for p in Path(base, "data", f"month={month}").glob("*.parquet")}


def merge(spark, base, data, batch):
    return tables.merge_batch(spark.createDataFrame(data, ROW), base, ["k", "t"], ["pull", "v"], ["month"], batch)


FIRST = [(1, "a", 1.0, 2, 1), (2, "a", 2.0, 2, 1), (1, "b", 3.0, 2, 2), (3, "c", 4.0, 2, 3)]
SECOND = [(1, "a", 9.0, 1, 1), (4, "a", 5.0, 1, 1), (5, "d", 6.0, 1, 4), (1, "b", 7.0, 3, 2)]
MERGED = [(1, "a", 9.0, 1, 1), (1, "b", 3.0, 2, 2), (2, "a", 2.0, 2, 1), (3, "c", 4.0, 2, 3), (4, "a", 5.0, 1, 1), (5, "d", 6.0, 1, 4)]


def test_merge_touches_its_partitions_only(spark, tmp_path):
    base = str(tmp_path / "t")
    assert merge(spark, base, FIRST, "one")
    before = {m: files(base, m) for m in (1, 2, 3)}
    assert merge(spark, base, SECOND, "two")
    table = tables.read_table(spark, base, spark.createDataFrame([], ROW).schema)
    assert rows(table.select("k", "t", "v", "pull", "month")) == MERGED
    assert files(base, 3) == before[3] and files(base, 1) != before[1]
    assert not merge(spark, base, [(9, "z", 1.0, 0, 3)], "two") and rows(table.select("k", "t", "v", "pull", "month")) == MERGED
    assert rows(tables.batches(spark, base).select("batch", "partitions")) == [("one", ["1", "2", "3"]), ("two", ["1", "2", "4"])]
    assert not tables.exists(spark, f"{base}/staged/two")
    assert merge(spark, base, [], "empty") and tables.batches(spark, base).count() == 3 and table.count() == 6


def test_full_merge_is_the_same(spark, tmp_path):
    rng = random.Random(1)
    pulls = [[(rng.randrange(9), str(rng.randrange(9)), float(rng.randrange(5)), p, m) for _ in range(60) for m in [rng.randrange(1, 5)]] for p in (1, 2, 3)]
    pulls = [[(k, f"{t}-{m}", v, p, m) for k, t, v, p, m in x] for x in pulls]  # a key's rows share their month
    want = rows(ingest.keep_first(spark.createDataFrame(sum(pulls, []), ROW), ["k", "t"], ["pull", "v"]))
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        base = str(tmp_path / "".join(map(str, order)))
        for i in order:
            merge(spark, base, pulls[i], f"pull-{i}")
        assert rows(tables.read_table(spark, base, spark.createDataFrame([], ROW).schema).select("k", "t", "v", "pull", "month")) == want


@pytest.mark.parametrize("broken", ["staging", "replacing", "recording"])
def test_failed_batch_is_repeated(spark, tmp_path, monkeypatch, broken):
    """A batch that adds up, stopped at each of its three writes, counts once in the end."""
    base, add = str(tmp_path / "t"), lambda both: both.groupBy("k", "month").agg(F.sum("v").alias("v"))
    make = lambda data: spark.createDataFrame(data, "k int, v double, month int")
    tables.merge_into(make([(1, 1.0, 1), (2, 1.0, 2)]), base, ["month"], add, "one")
    stage, replace, calls = tables._stage, tables.write_partitioned, []

    def staging(df, path):
        calls.append(path)
        stage(df, path)
        if broken == "staging":
            tables.delete(spark, f"{path}/_SUCCESS")  # a folder without the mark of a finished write
            raise OSError(path)

    def replacing(df, path, *args, **kw):
        calls.append(path)
        replace(df, path, *args, **kw)
        if broken == "replacing":
            tables.delete(spark, f"{base}/data/month=1")  # half of the replacement is lost
            raise OSError(path)

    with monkeypatch.context() as m:
        m.setattr(tables, "_stage", staging)
        m.setattr(tables, "write_partitioned", replacing)
        if broken == "recording":
            m.setattr(tables, "json", SimpleNamespace(dumps=lambda *a, **k: 1 / 0))
        with pytest.raises((OSError, ZeroDivisionError)):
            tables.merge_into(make([(1, 10.0, 1), (1, 5.0, 1)]), base, ["month"], add, "two")
    assert calls
    assert tables.merge_into(make([(1, 10.0, 1), (1, 5.0, 1)]), base, ["month"], add, "two")
    table = tables.read_table(spark, base, make([]).schema)
    assert rows(table.select("k", "v", "month")) == [(1, 16.0, 1), (2, 1.0, 2)]
    assert not tables.merge_into(make([(1, 10.0, 1)]), base, ["month"], add, "two")


def test_null_and_double_partitions(spark, tmp_path):
    base = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, "k int, v int, a string, b int")
    keep = lambda both: ingest.keep_first(both, ["k", "a", "b"], ["v"])
    tables.merge_into(make([(1, 5, "x", None), (1, 5, None, 2), (2, 5, "x", 1)]), base, ["a", "b"], keep, "1")
    tables.merge_into(make([(1, 3, "x", None), (1, 9, None, 2), (3, 3, "x", None)]), base, ["a", "b"], keep, "2")
    got = rows(tables.read_table(spark, base, make([]).schema).select("k", "v", "a", "b"))
    assert got == sorted([(1, 3, "x", None), (1, 5, None, 2), (2, 5, "x", 1), (3, 3, "x", None)], key=repr)


def page(location, hours, value, sensor=1):
    return json.dumps({"location_id": location, "sensor_id": sensor, "results": [{"value": value, "period": {"datetimeFrom": {"utc": h}}} for h in hours]}) + "\n"


H = ["2025-03-01T05:00:00Z", "2025-03-01T06:00:00Z", "2025-04-01T05:00:00Z"]


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
@pytest.mark.parametrize("together", [True, False])
def test_old_pull_wins_in_any_order(spark, tmp_path, order, together):
    pulls = {1: page(1, H[:2], 1.0) + page(1, H[:1], 0.5, sensor=9) + page(2, [None, "bad"], 1.0), 2: page(1, H[1:], 2.0) + page(2, H[:1], 2.0) + page(2, H[:1], 2.0)}
    landed, base, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    for i, number in enumerate(order):
        (tmp_path / "in" / f"pull={number}").mkdir(parents=True)
        (tmp_path / "in" / f"pull={number}" / "x.json").write_text(pulls[number])
        if i or not together:
            streams.merge_stream(spark, landed, base, state, 1).awaitTermination()
    streams.merge_stream(spark, landed, base, state).awaitTermination()
    got = rows(streams.merged_measurements(spark, base).select("location_id", "datetime_from_utc", "value", "pull"))
    assert got == [(1, H[0], 1.0, 1), (1, H[1], 1.0, 1), (1, H[2], 2.0, 2), (2, H[0], 2.0, 2)]
    assert files(base, 202503) and files(base, 202504)
    # a new checkpoint brings the same batches again: they are in already
    streams.merge_stream(spark, landed, base, state + "2", None if together else 1).awaitTermination()
    assert rows(streams.merged_measurements(spark, base).select("location_id", "datetime_from_utc", "value", "pull")) == got


def test_late_rows_revise_their_day(spark, tmp_path):
    t = lambda d, h: dt.datetime(2025, 1, d, h)
    landings = [[(1, t(1, 1), 1.0), (1, t(1, 2), 2.0), (1, t(10, 0), 5.0), (None, t(2, 0), 3.0), (2, None, 1.0)],
                [(1, t(1, 3), 6.0), (1, t(7, 23), 1.0), (1, t(8, 0), 1.0), (None, t(2, 1), None), (2, t(2, 5), 4.0)],
                [(1, t(20, 0), 1.0), (1, t(8, 1), 3.0)]]
    landed, base, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    for part in landings:
        spark.createDataFrame(part, "k int, ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(landed)
        live = spark.readStream.schema("k int, ts timestamp_ntz, v double").parquet(landed)
        streams.revise_stream(live, base, state, ["k"], "ts", "v").awaitTermination()
    whole = spark.createDataFrame(sum(landings, []), "k int, ts timestamp_ntz, v double").filter("ts is not null")
    assert rows(streams.revised_daily(spark, base, live, ["k"], "ts", "v", 1)) == rows(temporal.daily_mean(whole, ["k"], "ts", "v", 1))
    # the second landing's watermark is 8 January 00:00, the third's too
    late = rows(streams.late_counts(spark, base, live, ["k"], "ts"))
    assert late == sorted([(1, dt.date(2025, 1, 1), 1), (1, dt.date(2025, 1, 7), 1), (None, dt.date(2025, 1, 2), 1), (2, dt.date(2025, 1, 2), 1)], key=repr)


def test_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(page(1, H[:1], 1.0) + '{"location_id": 2, "results": [\n' + "not json\n" + '{"location_id": "x", "sensor_id": 5}\n')
    (tmp_path / "in" / "b.json").write_text(page(3, H[:1], 1.0) + "{}\n")
    from aerosieve.sources import schemas

    good, bad = ingest.land(spark, str(tmp_path / "in"), schemas.MEASUREMENTS_JSON, str(tmp_path / "out"))
    assert {r[0] for r in good.select("location_id").collect()} == {1, 3, None} and good.columns == ["location_id", "sensor_id", "results"]
    got = {(r["record"], r["file"], r["n_read"]) for r in bad.collect()}
    assert {g[0] for g in got} == {'{"location_id": 2, "results": [', "not json", '{"location_id": "x", "sensor_id": 5}'} and {g[1] for g in got} == {"a.json"}
    assert "quarantined=true" not in good._jdf.queryExecution().executedPlan().toString() and ingest.flatten_measurements(good).count() == 2
    (tmp_path / "c.csv").write_text('id,name,x\n1,"a, ""b""",2.5\n2,c,no\n3,d\n4,"two\nlines",1\n5,e,1,9\n')
    good, bad = ingest.land(spark, str(tmp_path / "c.csv"), "id int, name string, x double", str(tmp_path / "out2"), "csv", multiLine=True)
    assert rows(good) == [(1, 'a, "b"', 2.5), (4, "two\nlines", 1.0)]
    assert {r["record"].strip() for r in bad.collect()} == {"2,c,no", "3,d", "5,e,1,9"}
    (tmp_path / "d.csv").write_text("id,name,x\n1,a,1\n")
    good, bad = ingest.land(spark, str(tmp_path / "d.csv"), "id int, name string, x double", str(tmp_path / "out3"), "csv")
    assert good.count() == 1 and bad.count() == 0


def test_tiles_are_pruned(spark, tmp_path):
    px = spark.range(4000).selectExpr("id AS image", "0.25 + 0.5 * (id % 40) AS lat", "0.25 + 0.5 * (id div 40 % 30) AS lon", "if(id % 5 = 0, null, id * 1.0) AS aod")
    px = px.selectExpr("image", "double(lat) AS lat", "double(lon) AS lon", "double(aod) AS aod")
    px = px.union(spark.createDataFrame([(9000, None, 1.0, 1.0)], px.schema))
    path = str(tmp_path / "tiles")
    ingest.write_tiles(px, path, ["lat", "lon"], 2.0, ["image"], rows=50)
    at = spark.createDataFrame([(1, 3.25, 4.75), (2, 3.25, 4.75), (3, 0.25, 0.25), (4, None, 1.0), (5, 80.25, 0.25)], "point int, lat double, lon double")
    got = ingest.sample_tiles(at, spark, path, ["lat", "lon"], "aod", 2.0)
    want = ingest.sample_raster_at_points(at, px, ["lat", "lon"], "aod")
    cols = ["point", "image", "aod", "lat", "lon"]
    assert rows(got.select(cols)) == rows(want.select(cols)) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "NestedLoop" not in plan
    assert len(list(Path(path).glob("tile_lat=*/tile_lon=*"))) == 10 * 8
