"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are put on an integer grid, x = floor(64 c) + 1000000 per entry, so that counts, sums and deviations are exact. The
covariance V of the fit list (each distinct x vector once) is never formed. A block Q of orthonormal columns is
improved instead: one distributed pass computes V Q as the sum of (x - mean) ((x - mean) Q) over the fit list, a three-term recurrence of
passes applies a Chebyshev polynomial that stays small on [0, smallest Ritz value of the block] and grows fast above, then QR and a
Rayleigh-Ritz step give eigenvalues and vectors. The iteration ends when every wanted vector's residual |V q - e q| is
below CERTIFIED times the largest eigenvalue, and raises if it does not in MAX_OUTER steps.

A pass is one job: tasks add up their rows and send one row for each column of V Q, which Spark sums; what reaches the driver is a matrix of
dimensions x block, whatever the number of rows. So does what is broadcast. Every task can be repeated.

Rows whose vector is null, empty, holds a null or a non-finite entry, or an entry of 2**40 and more (it
has no exact grid point) are dropped; so are vectors of another length than most have (of equally frequent lengths the smaller stays). Zero vectors stay. Equal
vectors count once in the fit and are all returned; repeated and null ids are returned as they are. Components are numbered by falling eigenvalue; those under
RANK times the largest have no direction and are left out, so a table of one distinct vector, like an empty
one, gives an empty result. Signs: the entry of largest size is positive. Tied eigenvalues give any orthonormal basis of their
space. ``deviation`` is NULL where it does not fit a long. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_rows, stored
from .vectors import matrix

GRID, SHIFT = 64, 1_000_000
SPARE = 32  # columns of the block beyond the wanted ones
DEGREE = 10
CERTIFIED = 1e-13
#: Rounding stops the residual above CERTIFIED on some tables: below this, a step that no longer halves it ends the iteration.
ENOUGH = 1e-11
MAX_OUTER = 200
RANK = 1e-10
OUT = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def on_grid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    v = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.size("vec") > 0)
    v = v.filter(F.coalesce(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**40))), F.lit(False)))
    length = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    v = v.filter(F.size("vec") == (length["n"] if length else 0))
    return v.select("id", F.transform("vec", lambda c: F.floor(c * GRID).cast("long") + SHIFT).alias("x"))


def _summed(rows: DataFrame, f, dims: int, width: int) -> np.ndarray:
    """Sum over all rows of the (dims, width) matrices that ``f(x)`` gives for blocks of rows: one row a column and task is shuffled."""

    def make():
        total = np.zeros((dims, width))

        def add(batch):
            total[...] += f(matrix(batch.column(0)) - SHIFT)

        def finish():
            yield pa.table([pa.array(range(width), pa.int32()), pa.array(list(total.T), pa.list_(pa.float64()))], names=["col", "part"])

        add.finish = finish
        return add

    parts = map_rows(rows, make, "col int, part array<double>")
    cells = parts.select("col", F.posexplode("part").alias("row", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dims, width))  # dims * width cells
    out[cells["row"].to_numpy(), cells["col"].to_numpy()] = cells["v"].to_numpy()
    return out


class Covariance:
    """V of the fit list (a table with a column x), by products only."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.dims = fit, n, len(sums)
        # means less SHIFT, from exact integers
        self.mean = np.array([(s - SHIFT * n) / n for s in sums])
        self.passes = 0

    def times(self, q: np.ndarray) -> np.ndarray:
        mean = self.mean
        self.passes += 1

        def f(x):
            x = x - mean
            return x.T @ (x @ q)

        return _summed(self.fit, f, self.dims, q.shape[1]) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(_summed(self.fit, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], self.dims, 1).sum()) / self.n

    def of_projection(self, w: np.ndarray) -> np.ndarray:
        """Covariance of (x - mean) w."""
        mean = self.mean

        def f(x):
            y = (x - mean) @ w
            return y.T @ y

        return _summed(self.fit, f, w.shape[1], w.shape[1]) / self.n


def chebyshev(times, q: np.ndarray, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """The scaled Chebyshev polynomial of ``times`` on q: small for eigenvalues in [0, high], 1 near ``top``."""
    half = high / 2
    sigma = first = half / (half - top)
    y = (times(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        q, y = y, (times(y) - half * y) * (2 * new / half) - sigma * new * q
        sigma = new
    return y


def leading(times, dims: int, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest relative residual) of the k largest, fewer if the rank is."""
    block = min(dims, k + SPARE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, block)))[0]
    before = np.inf
    for _ in range(MAX_OUTER):
        vq = times(q)
        e, u = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        if e[0] <= 0:
            return e[:0], q[:, :0], 0.0
        wanted = int((e[:k] > RANK * e[0]).sum())
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max() / e[0])
        if residual <= CERTIFIED or residual <= ENOUGH and residual > before / 2:
            break
        before = residual
        # the filter damps what is below the block; a block that holds nearly all of V has next to nothing below it
        q = np.linalg.qr(chebyshev(times, q, max(e[-1], 1e-6 * e[0]), e[0]))[0]
    else:
        raise RuntimeError(f"eigenvectors not certified after {MAX_OUTER} steps: residual {residual:.1e}")
    q = q[:, :wanted]
    at = np.abs(q).argmax(axis=0)
    return e[:wanted], q * np.sign(q[at, range(wanted)]), residual


def whiten(df: DataFrame, k: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component up to k.

    n: distinct vectors; deviation: sum of (n x - S)**2 over the dimensions; whitened: x - S/n along the component over the root of its
    eigenvalue; explained: the eigenvalue's share of the trace; identity_error: largest entry of |covariance of whitened - identity|."""
    spark = df.sparkSession
    rows = stored(on_grid(df, id_col, vec_col), "grid")
    out_schema = OUT.format(rows.schema["id"].dataType.simpleString()).replace("vec_id", id_col, 1)
    fit = stored(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = [r[1] for r in fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v")).orderBy("at").collect()]  # one row a dimension
    model = Covariance(fit, n, sums) if n else None
    e, q, _ = leading(model.times, model.dims, k) if n > 1 else (np.empty(0), np.empty((0, 0)), 0.0)
    if not len(e):
        return spark.createDataFrame([], out_schema)
    w = q / np.sqrt(e)
    error = float(np.abs(model.of_projection(w) - np.eye(len(e))).max())
    share, mean = e / model.trace(), model.mean
    s = F.array(*[F.lit(x).cast("long") for x in sums])
    off = F.zip_with("x", s, lambda a, b: F.try_subtract(F.try_multiply(a, F.lit(n).cast("long")), b))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda t, a: F.try_add(t, F.try_multiply(a, a)))

    def make():
        def f(batch):
            y = (matrix(batch.column(2)) - SHIFT - mean) @ w
            count, width = y.shape
            each = pa.array(np.repeat(np.arange(count), width))
            cols = [batch.column(0).take(each), np.tile(np.arange(1, width + 1, dtype=np.int32), count), np.full(y.size, n), batch.column(1).take(each),
                    y.ravel(), np.tile(share, count), np.full(y.size, error)]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return f

    out = stored(map_rows(rows.select("id", deviation.alias("deviation"), "x"), make, out_schema, max_bytes=1 << 20), "whitened")
    for t in (rows, fit):
        drop_stored(t)
    return out
