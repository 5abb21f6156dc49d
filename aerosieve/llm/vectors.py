"""Shared parts of the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, flag: Column | None = None) -> DataFrame:
    """(id long, vec array<double>, and flag if given) of rows with an id and a vector that is not null, empty or
    zero, holds no null or non-finite component and is as long as most of them (of equally frequent lengths the smaller)."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *([F.coalesce(flag, F.lit(False)).alias("flag")] if flag is not None else []))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    length = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("vec") == (length["n"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def sample(vectors: DataFrame, most: int, by: str = "id") -> np.ndarray:
    """At most ``most`` vectors, those with the smallest hashes of column ``by``: the same in every run."""
    t = vectors.orderBy(F.xxhash64(by), "id").limit(most).select("vec").toArrow()
    return matrix(t["vec"]) if t.num_rows else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's steps; an empty cluster is moved to the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = distances(x, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        far = np.argsort(-d[np.arange(len(x)), own])
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[far[:k]])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :])
