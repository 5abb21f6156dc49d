"""Operator 12 against numpy's eigenvectors of the full covariance."""

import math

import numpy as np
import pytest

from aerosieve.llm import queries, whitening

COLS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(vectors, k):
    """{row: {component: (n, deviation, whitened, explained)}} by exact integers and eigh."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [s / n - 1_000_000 for s in sums]
    centred = np.array([[a - 1_000_000 - m for a, m in zip(r, mean)] for r in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:k] > 1e-10 * e[0]).sum())
    out = []
    for r in x:
        d = sum((n * a - s) ** 2 for a, s in zip(r, sums))
        y = (np.array(r, float) - 1_000_000 - mean) @ u[:, :k] / np.sqrt(e[:k])
        out.append((n, d, y, e[:k] / e.sum()))
    return out


def check(got, vectors, k, ids=None, close=1e-7):
    want = brute(vectors, k)
    ids = list(range(len(vectors))) if ids is None else ids
    by = {}
    for r in got:
        by.setdefault(r[0], {})[r[1]] = r
    assert set(by) == set(ids)
    width = len(want[0][2])
    y = np.array([[by[i][c + 1][4] for c in range(width)] for i in ids])
    z = np.array([w[2] for w in want])
    sign = np.sign((y * z).sum(axis=0))
    assert np.abs(y * sign - z).max() < close
    for i, w in zip(ids, want):
        assert len(by[i]) == width and all(r[2] == w[0] and r[3] == w[1] and r[6] <= 1e-4 for r in by[i].values())
        assert np.allclose([by[i][c + 1][5] for c in range(width)], w[3], rtol=1e-9)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, component int, x string")


def test_whitening_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    got = queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.01").collect()
    check(got, [r[1] for r in rows], 16, [r[0] for r in rows])


@pytest.mark.parametrize("dims", [90, 5, 1])
def test_whitening_with_and_without_filter(spark, dims):
    rng = np.random.default_rng(dims)
    v = (rng.standard_normal((400, dims)) * np.linspace(3, 1, dims)).astype(np.float32)
    v = np.concatenate([v, v[:50]])  # copies count once in the fit
    out = whitening.whiten(frame(spark, list(enumerate(v))))
    assert out.columns == COLS
    check(out.collect(), v, 16)


def test_filter_damps_the_unwanted_spectrum():
    rng = np.random.default_rng(1)
    u = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    e = np.sort(np.concatenate([np.linspace(1.02, 1.2, 20), rng.uniform(0.1, 1, 180)]))[::-1]
    a = (u * e) @ u.T
    calls = []
    got, q, residual = whitening.leading(lambda x: calls.append(1) or a @ x, 200, 16)
    assert np.allclose(got, e[:16], rtol=1e-12) and residual < 1e-11
    assert np.abs(np.abs((q * u[:, :16]).sum(axis=0)) - 1).max() < 1e-10 and len(calls) < 120
    y = whitening.chebyshev(lambda x: a @ x, u, 0.99, e[0])
    gain = np.abs((u * y).sum(axis=0))
    assert gain[0] > 0.99 and gain[e < 0.99].max() < 0.1


def test_odd_vectors(spark):
    bad = [(1, None), (2, [1, None]), (3, [float("nan"), 1]), (4, [float("inf"), 1]), (5, []), (6, [1, 2, 3]), (7, [2.0**41, 0])]
    good = [(10, [0, 0]), (10, [0, 0]), (None, [1, 2]), (12, [-1.5, 0.25]), (13, [4, 4])]
    got = whitening.whiten(frame(spark, bad + good, "double"), k=16).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(i), c) for i, _ in good for c in (1, 2)) and {r[2] for r in got} == {4}
    assert whitening.whiten(frame(spark, bad[:5], "double")).count() == 0 and whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [3, 4])] * 5)).count() == 0  # one distinct vector has no direction
    line = whitening.whiten(frame(spark, [(i, [i, 2 * i, 0]) for i in range(9)])).collect()
    assert {r[1] for r in line} == {1} and all(abs(r[5] - 1) < 1e-12 for r in line)
    wide = whitening.whiten(frame(spark, [(i, [(-1) ** i * 2.0**39, i]) for i in range(4)], "double")).collect()
    assert all(r[3] is None for r in wide)  # the deviation does not fit a long
