"""Overlaps, last values, gaps and held-out errors against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from aerosieve.operators import fusion, intervals, qc, temporal


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("on", [[], ["p"]])
def test_overlaps_property(spark, on):
    for seed in range(3):
        rng = random.Random(seed)

        def span(longest):
            s = rng.randrange(-300, 300)
            return s, s + rng.choice([0, 1, rng.randrange(longest), -1])

        left = [(i, *span(400), rng.choice("ab")) for i in range(80)] + [(900, None, 5, "a"), (901, 1, None, "a"), (902, -10_000, 10_000, "a"), (903, 0, 0, None)]
        right = [(i, *span(60), rng.choice("ab")) for i in range(120)] + [(900, -9_000, -8_990, "a"), (901, 0, 0, "b"), (901, 0, 0, "b"), (903, 0, 0, None)]
        x, y = spark.createDataFrame(left, "i int, s int, e int, p string"), spark.createDataFrame(right, f"j int, s2 int, e2 int, {'p' if on else 'q'} string")
        got = intervals.overlap_join(x, y, ("s", "e"), ("s2", "e2"), on)
        ok = lambda r: r[1] is not None and r[2] is not None and r[1] <= r[2]
        want = [(a[0], b[0]) for a in left for b in right if ok(a) and ok(b) and a[1] <= b[2] and b[1] <= a[2] and (not on or a[3] == b[3] is not None)]
        assert rows(got.select("i", "j")) == sorted(want, key=repr)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlap_join(x.limit(0), y, ("s", "e"), ("s2", "e2"), on).count() == 0


def test_overlaps_copy_little(spark):
    """A span of a million days is copied at most twice a level, not to each day."""
    x = spark.createDataFrame([(1, 0, 1_000_000)], "i int, s int, e int")
    y = spark.range(2000).selectExpr("id AS j", "id * 500 AS s2", "id * 500 + id % 7 AS e2")
    a = intervals._binned(x, ("s", "e"), [])
    assert a.first()["_level"] == 20 and intervals.overlap_join(x, y, ("s", "e"), ("s2", "e2")).count() == 2000


@pytest.mark.parametrize("every", ["year", "month", "day"])
def test_asof_property(spark, every):
    rng = random.Random(4)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(0, 24 * 400))
    right = [(rng.randrange(6), t(), rng.choice(["x", "y", None]), rng.randrange(9)) for _ in range(120)]
    right += [(1, right[0][1], "z", 5), (1, right[0][1], "a", 9), (None, t(), "n", 1), (2, None, "n", 1)]
    left = [(i, rng.randrange(8), rng.choice([t(), rng.choice(right[:40])[1]])) for i in range(300)] + [(900, None, t()), (901, 1, None), (900, 1, right[0][1]), (900, 1, right[0][1])]
    x, y = spark.createDataFrame(left, "i int, k int, t timestamp_ntz"), spark.createDataFrame(right, "k int, since timestamp_ntz, a string, b int")
    got = intervals.asof_join(x, y, ["k"], "t", "since", ["a", "b"], every)
    assert got.columns == ["i", "k", "t", "a", "b"]

    def found(k, at):
        best = [(r[1], r[2] is not None, r[2] or "", r[3], r) for r in right if r[0] == k is not None and r[1] is not None and at is not None and r[1] <= at]
        return max(best)[4][2:] if best else (None, None)

    assert rows(got) == sorted(((*r, *found(r[1], r[2])) for r in left), key=repr)
    assert intervals.asof_join(x, y.limit(0), ["k"], "t", "since", ["a", "b"], every).filter("b is not null").count() == 0


def test_exceptions_count_from_their_date(spark):
    d = dt.date
    e = spark.createDataFrame([(1, "dust", d(2025, 3, 5)), (1, "fire", d(2025, 4, 1)), (2, "no date", None)], "id int, exception_reason string, exception_date date")
    bad = spark.createDataFrame([(1, d(2025, 3, 4)), (1, d(2025, 3, 5)), (1, d(2025, 5, 1)), (2, d(2025, 5, 1)), (3, d(2025, 5, 1))], "id int, date date")
    got = {(r["id"], r["date"]): r["exception_reason"] for r in qc.excused(bad, e, "id", "date").collect()}
    assert got == {(1, d(2025, 3, 4)): None, (1, d(2025, 3, 5)): "dust", (1, d(2025, 5, 1)): "fire", (2, d(2025, 5, 1)): None, (3, d(2025, 5, 1)): None}
    left = qc.unexcused(bad, e, "id", "date")
    assert rows(left) == [(1, d(2025, 3, 4)), (2, d(2025, 5, 1)), (3, d(2025, 5, 1))]
    with pytest.raises(ValueError):
        qc.review_gate(left, "id")


@pytest.mark.parametrize("step", [dt.timedelta(hours=1), dt.timedelta(hours=6), dt.timedelta(days=1)])
def test_gaps_equal_missing_slots(spark, step):
    rng = random.Random(9)
    start, end = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 9)
    data = [(k, start + dt.timedelta(hours=rng.randrange(-30, 24 * 9))) for k in (1, 2, 3) for _ in range(60)] + [(4, dt.datetime(2026, 1, 1)), (None, start), (5, None)]
    data = [(k, t) for k, t in data if t is None or t.day not in (4, 5)]
    df, registry = spark.createDataFrame(data, "k int, ts timestamp_ntz"), spark.createDataFrame([(1,), (3,), (7,), (None,)], "k int")
    slots = [start + i * step for i in range(int((end - start) / step))]
    for keys, reg in (([1, 2, 3, 4, 5], None), ([1, 3, 7], registry)):
        gaps = temporal.missing_intervals(df, "k", "ts", "2025-01-01", "2025-01-08", step, reg)
        have = {(k, (t - start) // step) for k, t in data if t is not None}
        missing = {k: [i for i in range(len(slots)) if (k, i) not in have] for k in keys}
        got = {k: [] for k in keys}
        for r in gaps.collect():
            a, b = (r[c] - start for c in ("gap_start", "gap_end"))
            assert r["n_slots"] == (b - a) // step + 1
            got[r["k"]].append((a // step, b // step))
        for k in keys:
            spans = sorted(got[k])
            assert [i for a, b in spans for i in range(a, b + 1)] == missing[k] and all(p[1] + 1 < q[0] for p, q in zip(spans, spans[1:]))
        everywhere = set.intersection(*(set(m) for m in missing.values()))
        both = temporal.missing_everywhere(gaps, len(keys), step)
        found = {i for r in both.collect() for i in range((r["gap_start"] - start) // step, (r["gap_end"] - start) // step + 1)}
        assert found == everywhere
        per = dt.timedelta(days=1) // step
        days = {start.date() + dt.timedelta(days=n) for n in range(8) if all(n * per + j in everywhere for j in range(per))}
        assert {r["date"] for r in temporal.whole_days(both, step).collect()} == days and len(days) >= 2
    assert temporal.missing_intervals(df.limit(0), "k", "ts", "2025-01-01", "2025-01-08", step).count() == 0
    with pytest.raises(ValueError):
        temporal.missing_intervals(df, "k", "ts", "2025-01-01", "2025-01-08", dt.timedelta(hours=7))


def test_gaps_hold_across_time_zones(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 3, 30, h)) for h in (0, 4)], "k int, ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "Europe/Berlin"):  # a clock that skips 02:00 on that day
        spark.conf.set("spark.sql.session.timeZone", z)
        got = rows(temporal.missing_intervals(df, "k", "ts", "2025-03-30", "2025-03-30").select("n_slots"))
        assert got == [(19,), (3,)]
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_held_out_error_against_least_squares(spark):
    rng = np.random.default_rng(2)
    data = []
    for g, size in (("a", 200), ("b", 40), ("c", 3), ("d", 6)):
        x = 1e6 + rng.standard_normal(size) * (0 if g == "d" else 3)  # large means, a group with constant x
        data += [(g, int(f), float(y), float(v)) for f, v, y in zip(rng.integers(0, 4, size), x, 2 * x + rng.standard_normal(size))]
    data += [("a", 1, None, 5.0), ("a", 2, 5.0, None), ("e", 0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, f int, y double, x double")
    got = {(r["g"], r["f"]): r for r in fusion.held_out_error(df, "g", "f", "y", "x").collect()}
    good = [r for r in data if None not in r]
    assert set(got) == {r[:2] for r in good}
    sse = {}
    for (g, f), r in got.items():
        fit = np.array([(v, y) for gg, ff, y, v in good if gg == g and ff != f]).reshape(-1, 2)
        own = np.array([(v, y) for gg, ff, y, v in good if gg == g and ff == f])
        assert (r["n"], r["n_fit"]) == (len(own), len(fit))
        if len(fit) < 2 or np.ptp(fit[:, 0]) == 0:
            assert r["rmse"] is None and r["slope"] is None
            continue
        m = fit.mean(axis=0)
        slope = ((fit[:, 0] - m[0]) * (fit[:, 1] - m[1])).sum() / ((fit[:, 0] - m[0]) ** 2).sum()
        err = m[1] + slope * (own[:, 0] - m[0]) - own[:, 1]
        assert math.isclose(r["slope"], slope, rel_tol=1e-6) and math.isclose(r["rmse"], np.sqrt((err**2).mean()), rel_tol=1e-5) and math.isclose(r["bias"], err.mean(), rel_tol=1e-4, abs_tol=1e-6)
        sse.setdefault(g, []).append((len(own), (err**2).sum()))
    total = {r["g"]: (r["n"], r["n_folds"], r["rmse"]) for r in fusion.calibration_error(fusion.held_out_error(df, "g", "f", "y", "x"), "g").collect()}
    assert set(total) == set(sse)
    for g, parts in sse.items():
        assert total[g][:2] == (sum(n for n, _ in parts), len(parts)) and math.isclose(total[g][2], math.sqrt(sum(s for _, s in parts) / sum(n for n, _ in parts)), rel_tol=1e-5)
    assert fusion.held_out_error(df.limit(0), "g", "f", "y", "x").count() == 0
