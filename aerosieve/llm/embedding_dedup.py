"""Operator 2: embedding near-duplicates with an inverted multi-index.

Vectors are scaled to length one; exact copies are collapsed to one with a weight. Each half of a
vector has its own codebook (k-means on a bounded sample); pairs of codewords form the
product grid, and every vector is stored in the one cell of its two nearest codewords.

A vector visits cells by multi-sequence traversal: nearest first by the sum of both halves' squared
distances, until the sum exceeds its own cell's by a margin. The margin is the quantile
TARGET of what pairs at exactly the threshold need, measured on the sample with
random partners, so vectors closer than the threshold are found more surely still. Every pair met in a cell is
verified in double precision.

Links are counted where they are found: a pair whose two ends visit each other's cells counts once from
each side, any other counts for both ends at once. Cells return counts and spanning
forests, never the pairs. A cell with many vectors is cut into chunks and its tiles are dealt to
different tasks, so a hot cell or a large group of near copies does not sit in one.

Vectors that are null, zero, hold null or non-finite components or are of another length than most link with nothing. Cells at
equal distance are visited in order of the halves' ranks; the order changes no link, since all cells within the margin are visited. An
empty table gives an empty one; columns other than id and vector are ignored, whatever their names.
Beyond MAX_CODEWORDS**2 * PER_CELL vectors the grid stays as it is and cells grow with the input.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_rows, stored
from .components import components
from .vectors import distances, kmeans, matrix, sample, usable

SAMPLE = 20_000
TARGET = 0.995
PER_CELL = 100
MAX_CODEWORDS = 512
CHUNK = 2_048


class Grid:
    """Two codebooks and the margin of the traversal."""

    def __init__(self, x: np.ndarray, rows: int, threshold: float):
        self.half = x.shape[1] // 2
        k = int(np.clip((rows / PER_CELL) ** 0.5, 1, MAX_CODEWORDS))
        self.books = [kmeans(part, k) for part in self._parts(x)]
        self.margin = np.inf
        self.margin = self._measure(x[:4_000], threshold)

    def _parts(self, x: np.ndarray):
        return x[:, : self.half], x[:, self.half :]

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(distances(p, b) for p, b in zip(self._parts(x), self.books, strict=True))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.sums(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def _excess(self, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
        i, j = np.divmod(cell, len(self.books[1]))
        r = np.arange(len(cell))
        return a[r, i] + b[r, j] - a.min(axis=1) - b.min(axis=1)

    def _measure(self, x: np.ndarray, threshold: float) -> float:
        """Excess that either end of a pair at the threshold needs to reach the other's cell."""
        rng = np.random.default_rng(2)
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(axis=1)[:, None] * x
        y = threshold * x + (1 - threshold**2) ** 0.5 * side / np.linalg.norm(side, axis=1)[:, None]
        need = np.minimum(self._excess(*self.sums(x), self.cells(y)), self._excess(*self.sums(y), self.cells(x)))
        return float(np.quantile(need, TARGET)) + 1e-9

    def visits(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether row k's traversal reaches cell k."""
        return self._excess(*self.sums(x), cell) <= self.margin

    def traverse(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells of one vector in ascending order of both distances, up to the margin."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, i, j = a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist()
        end, width = a[0] + b[0] + self.margin, len(b)
        heap, out = [(a[0] + b[0], 0, 0)], []
        while heap and heap[0][0] <= end:
            _, p, q = heapq.heappop(heap)
            out.append(i[p] * width + j[q])
            if q + 1 < width:
                heapq.heappush(heap, (a[p] + b[q + 1], p, q + 1))
            if q == 0 and p + 1 < len(a):
                heapq.heappush(heap, (a[p + 1] + b[0], p + 1, 0))
        return out


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that keep the components of a boolean matrix."""
    edges = []
    row_seen, col_seen = np.zeros(hit.shape[0], bool), np.zeros(hit.shape[1], bool)
    for r in range(hit.shape[0]):
        if row_seen[r] or not hit[r].any():
            continue
        row_seen[r] = True
        front = [r]
        while front:
            k = front.pop()
            cols = np.flatnonzero(hit[k] & ~col_seen)
            col_seen[cols] = True
            edges += [(k, int(c)) for c in cols]
            for c in cols:
                rows = np.flatnonzero(hit[:, c] & ~row_seen)
                row_seen[rows] = True
                edges += [(int(q), int(c)) for q in rows]
                front += rows.tolist()
    return edges


def _tile(q: dict, m: dict, grid: Grid, threshold: float, counts: list, edges: list) -> None:
    """Pairs of visitors ``q`` and members ``m`` of a cell (ids, weights, vectors, own cells)."""
    hit = (q["vec"] @ m["vec"].T >= threshold) & (q["id"][:, None] != m["id"][None, :])
    if not hit.any():
        return
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit = hit[np.ix_(rows, cols)]
    mine = hit @ m["w"][cols]
    # does the member's own traversal reach the visitor's cell? if so it counts this pair itself
    home = q["cell"][rows]
    for c in np.unique(home):
        back = grid.visits(m["vec"][cols], np.full(len(cols), c))
        one_way = hit[home == c][:, ~back]
        if one_way.any():
            other = q["w"][rows][home == c] @ one_way
            got = other > 0
            counts.append((m["id"][cols][~back][got], other[got]))
    counts.append((q["id"][rows], mine))
    edges += [(int(q["id"][rows[i]]), int(m["id"][cols[j]])) for i, j in _forest(hit)]


def _verify(grid, threshold: float):
    """Rows sorted by tile, members (kind 0) before visitors (kind 1). Holds one chunk of members; visitors pass in blocks."""

    def run(batches):
        g = grid.value
        key, members, parts = None, None, []

        def out(counts, edges):
            a = np.concatenate([c[0] for c in counts]) if counts else np.empty(0, np.int64)
            n = np.concatenate([c[1] for c in counts]).astype(np.int64) if counts else np.empty(0, np.int64)
            e = np.array(edges, np.int64).reshape(-1, 2)
            return pa.table({"a": pa.array(np.concatenate([a, e[:, 0]])), "b": pa.array(np.concatenate([np.full(len(a), -1), e[:, 1]])), "n": pa.array(np.concatenate([n, np.zeros(len(e), np.int64)])), "edge": pa.array(np.concatenate([np.zeros(len(a), bool), np.ones(len(e), bool)]))}).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            data = {"kind": b.column(3).to_numpy(zero_copy_only=False), "id": b.column(4).to_numpy(), "w": b.column(5).to_numpy(), "cell": b.column(6).to_numpy(), "vec": matrix(b.column(7))}
            new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in at], axis=0)]))
            counts, edges = [], []
            for lo, hi in zip(new, np.append(new[1:], b.num_rows), strict=True):
                k = tuple(int(x[lo]) for x in at)
                if k != key:
                    key, members, parts = k, None, []
                part = {c: x[lo:hi] for c, x in data.items()}
                own = part["kind"] == 0
                if own.any():
                    parts.append({c: x[own] for c, x in part.items()})
                if (~own).any() and parts:
                    if members is None:
                        members = {c: np.concatenate([p[c] for p in parts]) for c in ("id", "w", "cell", "vec")}
                    for i in range(0, int((~own).sum()), 1_024):
                        _tile({c: x[~own][i : i + 1_024] for c, x in part.items()}, members, g, threshold, counts, edges)
            yield from out(counts, edges)

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every id of ``df``; rows with a null id are left out, other columns ignored.
    Rows that repeat an id count as one vector if equal and else as several vectors of one id: these share
    its component, and n_links counts the links of each. An empty table gives an empty one."""
    spark = df.sparkSession
    v = usable(df, id_col, vec_col)
    # by the largest component first, so that squares neither vanish nor overflow
    v = v.withColumn("vec", F.transform("vec", lambda x: x / F.array_max(F.transform("vec", F.abs))))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    v = v.select("id", F.transform("vec", lambda x: x / norm).alias("vec"))
    # exact copies (same direction) are one representative, numbered apart from the ids
    ids = stored(v.distinct().withColumn("copy", F.xxhash64("vec")), "unit")
    alike = ids.groupBy("copy", "vec").agg(F.count("*").cast("double").alias("w")).withColumn("rep", F.monotonically_increasing_id())
    reps = stored(alike, "reps")
    rows = reps.count()
    everyone = df.select(F.col(id_col).cast("long").alias("doc")).filter("doc is not null").distinct()
    if rows == 0:
        return everyone.select(F.col("doc").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("component_id"), F.lit(True).alias("kept"))
    grid = spark.sparkContext.broadcast(Grid(sample(reps.select(F.col("rep").alias("id"), "vec"), SAMPLE, "vec"), rows, threshold))  # two codebooks of at most MAX_CODEWORDS

    def place():
        g = grid.value

        def f(batch):
            x = matrix(batch.column(2))
            own = g.cells(x)
            to = [g.traverse(a, b) for a, b in zip(*g.sums(x), strict=True)]
            return pa.table([*batch.columns, pa.array(own, pa.int64()), pa.array(to, pa.list_(pa.int64()))], names=["id", "w", "vec", "cell", "visits"])

        return f

    placed = stored(map_rows(reps.select(F.col("rep").alias("id"), "w", "vec"), place, "id long, w double, vec array<double>, cell long, visits array<long>", max_bytes=2 << 20), "placed")
    chunks = placed.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    m = placed.join(chunks, "cell").select("cell", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.lit(0).cast("byte").alias("kind"), "id", "w", F.col("cell").alias("home"), "vec")
    # a member meets every slice of visitors: as many slices as the visitors of a cell need
    q = placed.select("id", "w", F.col("cell").alias("home"), "vec", F.explode("visits").alias("cell")).join(chunks, "cell")
    seen = q.groupBy("cell").agg(F.ceil(F.count("*") / (16 * CHUNK)).cast("int").alias("slices"))
    m = m.join(seen, "cell").select("cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "kind", "id", "w", "home", "vec")
    q = q.join(seen, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), F.lit(1).cast("byte").alias("kind"), "id", "w", "home", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = m.unionByName(q).repartition(parts, "cell", "chunk", "slice").sortWithinPartitions("cell", "chunk", "slice", "kind")
    found = stored(tiles.mapInArrow(_verify(grid, threshold), "a long, b long, n long, edge boolean"), "found")
    links = found.filter("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    of = stored(ids.join(reps, ["copy", "vec"]).select("id", "rep", "w"), "of")
    # the different vectors of one id hang together through it
    same = of.join(of.groupBy("id").agg(F.min("rep").alias("b")), "id").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    label = components(found.filter("edge").select("a", "b").unionByName(same))
    named = of.join(links, "rep", "left").join(label, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    low = named.groupBy("c").agg(F.min("id").alias("low"))
    per = named.groupBy("id").agg(F.sum("n").cast("long").alias("n_links"), F.min("c").alias("c")).join(low, "c")
    out = stored(everyone.join(per, F.col("doc") == F.col("id"), "left").select(
        F.col("doc").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "doc").alias("component_id")), "classes")
    for t in (ids, reps, placed, found, of):
        drop_stored(t)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
