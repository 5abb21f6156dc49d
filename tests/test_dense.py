"""Points so dense that their pairs are far more than they are: tiles, clusters and correlations against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from aerosieve.operators import geo, joins


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(geo, "PAIR_SIDE", 8)


def _points(spark, seed=1, n=150):
    rng = random.Random(seed)
    at = [(i, round(28.4 + rng.random() * 0.1, 4), round(77 + rng.random() * 0.1, 4)) for i in range(n)]
    at += [(n + i, 28.45, 77.05) for i in range(30)] + [(n + 30, 10.0, 10.0), (n + 31, -10.0, 179.999), (n + 32, -10.0, -179.999), (n + 33, None, 1.0)]
    return spark.createDataFrame(at, "id int, lat double, lon double")


def test_spread_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "k int, a int")
    right = spark.createDataFrame([(0 if i < 90 else 5, i) for i in range(100)], "k int, b int")
    got = joins.spread_join(left, right, ["k"], 10)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # no task gets all rows of the one key
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert got.rdd.getNumPartitions() > 40 and most < want.count() / 4
    assert joins.spread_join(left.limit(0), right, ["k"]).count() == 0


@pytest.mark.parametrize("mode", ["greedy", "components"])
def test_clusters_of_dense_points(spark, small, mode):
    for seed, limit in ((1, 0.4), (2, 3.0)):
        p = _points(spark, seed)
        want = geo.cluster_pairs(geo.close_pairs(p, "id", "lat", "lon", limit), mode)
        got = geo.cluster_points(p, "id", "lat", "lon", limit, mode)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert geo.cluster_points(p.limit(0), "id", "lat", "lon", 1.0, mode).count() == 0


def test_components_of_a_long_chain(spark):
    """Groups used to shift by two labels a round, so that a chain of more than 120 ends came out in pieces."""
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(150)], "id_a int, id_b int, distance_km double")
    assert geo.cluster_pairs(chain, "components").groupBy("cluster_id", "is_bridge").count().collect() == [(1, False, 150)]
    with pytest.raises(RuntimeError, match="not complete"):
        geo.cluster_pairs(chain, "components", max_rounds=2)


def test_correlations_of_dense_points(spark, small):
    p = _points(spark, 3, 40)
    rng = random.Random(5)
    rows = [(i, d, {0: 5.0, 1: None}.get(i % 9, rng.random() if (i * d) % 11 else None)) for i in range(80) for d in range(12) if i % 2 or (i + d) % 5]
    rows += [(100, 1, float("nan")), (None, 1, 2.0), (1, None, 3.0)]
    daily = spark.createDataFrame(rows, "k int, date int, v double")
    want = geo.pair_correlation(geo.close_pairs(p, "id", "lat", "lon", 3.0), daily, "k", "date", "v").select("id_a", "id_b", "matched_days", "correlation")
    got = geo.near_correlation(p, "id", "lat", "lon", 3.0, daily, "k", "date", "v")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    with pytest.raises(Exception, match="several rows"):
        geo.near_correlation(p, "id", "lat", "lon", 3.0, daily.union(daily), "k", "date", "v").collect()


def test_pixels_of_one_cell_go_to_many_tasks(spark, tmp_path):
    """Nearly all rows of a join on cells used to come out of the one task that has the cell."""
    from aerosieve.sources import ingest

    points = spark.range(3_000).selectExpr("id", "28.25D AS cell_lat", "76.6875D AS cell_lon")
    pixels = spark.range(8_300).selectExpr("id AS image_id", "28.25D AS cell_lat", "76.6875D AS cell_lon", "if(id % 83 = 0, null, 1.5D) AS aod")
    ingest.write_tiles(pixels, str(tmp_path / "t"), ["cell_lat", "cell_lon"], 2.0, ["image_id"])
    for got in (ingest.sample_raster_at_points(points, pixels, ["cell_lat", "cell_lon"], "aod"), ingest.sample_tiles(points, spark, str(tmp_path / "t"), ["cell_lat", "cell_lon"], "aod", 2.0)):
        by_task = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(by_task) == 3_000 * 8_200 and max(by_task) <= 0.8 * sum(by_task)


def test_pixels_of_points_take_little_room(spark, tmp_path):
    """Nearly a byte a row before, on disk: too much where a result has billions of rows. Keys are doubles, which a merge would shuffle a second time."""
    from aerosieve.sources import ingest

    points = spark.range(3_000).selectExpr("id", "-0.0D AS cell_lat", "76.6875D AS cell_lon")
    pixels = spark.range(4_000).selectExpr("id * 4 AS image_id", "0.0D AS cell_lat", "76.6875D AS cell_lon", "cast(xxhash64(id) % 100000 AS double) / 100 AS aod")
    got = ingest.sample_raster_at_points(points, pixels, ["cell_lat", "cell_lon"], "aod")
    assert got.columns == ["cell_lat", "cell_lon", "id", "image_id", "aod"]
    got.select("id", "image_id", "aod").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    want = points.select("id").join(pixels.select("image_id", "aod"))
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("id", "image_id", "aod").cast("decimal(38,0)"))).first()
    assert total(out) == total(want)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * 3_000 * 4_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    merge = plan[plan.index("SortMergeJoin [_tile") :]
    assert merge.count("Exchange hashpartitioning(_tile") == 2


def test_keys_of_other_types(spark):
    from aerosieve.sources import ingest

    left = spark.createDataFrame([(0.1, 1), (float("nan"), 2), (-0.0, 3), (None, 4), (2.5, 5)], "k double, a int")
    right = spark.createDataFrame([(0.1, 1), (float("nan"), 2), (0.0, 3), (None, 4), (2.5, 5)], "k float, b int")
    assert sorted((r["a"], r["b"]) for r in joins.spread_join(left, right, ["k"]).collect()) == [(2, 2), (3, 3), (5, 5)]
    whole = right.filter("k = 2.5").withColumn("k", F.lit(2)).union(right.filter("k = 2.5").withColumn("k", F.lit(0)))
    assert [(r["a"], r["b"]) for r in joins.spread_join(left, whole, ["k"]).collect()] == [(3, 5)]
    # points without other columns, and such that have no hash
    assert ingest.sample_raster_at_points(left.select("k"), right, ["k"], "b").count() == 3


def test_correlations_at_the_limit_and_around_the_globe(spark):
    """Products of unit vectors choose the pairs, and Spark those within a metre of the limit; ids need not be numbers."""
    rng = random.Random(8)
    at = [(f"p{i}", 10 + rng.random() / 50, 179.99 + rng.random() / 50) for i in range(20)] + [("far", -10.01, 0.0), ("n", 90.0, 0.0), ("s", -90.0, 5.0)]
    p = spark.createDataFrame([(i, la, lo if lo <= 180 else lo - 360) for i, la, lo in at], "id string, lat double, lon double")
    daily = spark.createDataFrame([(i, d, rng.random()) for i, _, _ in at for d in range(6) if (len(i) + d) % 5], "k string, date int, v double")
    from aerosieve.functions.exprs import haversine_km

    two = p.alias("a").crossJoin(p.alias("b")).filter("a.id < b.id").select(haversine_km("a.lat", "a.lon", "b.lat", "b.lon").alias("d"))
    some = sorted(r[0] for r in two.collect())
    key = lambda r: tuple(map(str, r))
    for limit in (some[40], some[41] + 1e-12, 20_015.0, 25_000.0):
        want = geo.pair_correlation(geo.close_pairs(p, "id", "lat", "lon", limit), daily, "k", "date", "v").select("id_a", "id_b", "matched_days", "correlation")
        got = geo.near_correlation(p, "id", "lat", "lon", limit, daily, "k", "date", "v")
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) != []


def test_a_tile_of_correlations(monkeypatch):
    """All pairs of a tile at once, where they used to be taken one by one and value by value (60 x sf0.1: 1,146 s of tasks, 85 since); small matrices give the same."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)

    def side(end, n):
        rows = [[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=30)] for _ in range(n)]
        rows[:3] = [[2.5] * 30, [1.0] * 29 + [7.0], [None] * 30]
        full = [k > 3 and None not in r for k, r in enumerate(rows)]
        rows = [list((np.array(r) - np.mean(r)) / (np.std(r) * 30**0.5)) if ok else r for r, ok in zip(rows, full)]
        days = [None if ok else [*range(1, 31)] for ok in full]
        return pa.table({f"id_{end}": pa.array(range(n), pa.int64()), f"lat_{end}": 28 + rng.random(n) / 30, f"lon_{end}": 77 + rng.random(n) / 30, f"at_{end}": pa.array(days, pa.list_(pa.int32())),
                         f"series_{end}": pa.array(rows, pa.list_(pa.float64())), f"full_{end}": pa.array(full)})

    left, right = side("a", 300), side("b", 200)
    rows = lambda: sorted((r["id_a"], r["id_b"], r["matched_days"], r["r"] if r["r"] is None else round(r["r"], 9), r["places"]) for r in geo._correlated(3.0, 2)(left, right).to_pylist())
    once = rows()
    for a, b, n, r, _ in once[:: max(1, len(once) // 300)]:
        both = [(x, y) for x, y in zip(left["series_a"][a].as_py(), right["series_b"][b].as_py()) if x is not None and y is not None]
        x, y = np.array(both).T if both else ((), ())
        want = None if not len(x) or np.ptp(x) == 0 or np.ptp(y) == 0 else np.corrcoef(x, y)[0, 1]
        assert n == 30 and (r is None) == (want is None) and (r is None or abs(r - want) < 1e-8)
    assert len(once) > 5_000 and any(r[3] is None for r in once)
    monkeypatch.setattr(geo, "MATRIX", 1_000)
    assert rows() == once
    empty = geo._correlated(3.0, 2)(left.slice(0, 0), right)
    assert empty.num_rows == 0 and empty.column_names == ["id_a", "id_b", "matched_days", "r", "places"]
