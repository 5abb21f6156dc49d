"""Operator 3: approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample: clusters are split, level by level, until all
are near PER_LIST rows of the table (lists are numbered along the splits, so neighbours are alike). A vector is
stored in the list of its nearest centroid and, if it lies near a boundary, replicated to up to REPLICAS lists
whose centroid is within 1 + CLOSURE of the nearest distance, leaving out lists whose centroid is much nearer to
one chosen before than to the vector (APART): those are opened with it anyway. Lists are found through a graph over
the centroids (each tied to its nearest ones) that every task holds in memory and searches best first with a heap,
from lists found by a tree of means of neighbouring lists.
A query opens the lists whose distance is within a ratio of its nearest ones' (BASE); the ratio is the smallest that
reaches TARGET recall for sample queries against the sample. Where those lists hold too few ids (isolated
vectors, small groups of copies), it opens further ones in ascending distance.

For inner products, vectors get one more component that makes all equally long, so that the nearest by
distance is the largest by product; scores are products of the original vectors, summed in order in
double precision.

Queries meet lists in Spark: lists next to each other make groups of at most CHUNK vectors, a longer list is cut
over several groups, and a query goes once to each group where it opens a list. A group gives each query's best k; a window
ranks what the groups found.

Ids may repeat: a query takes the best row of each. The query rows are told by a condition on any column.
Vectors of another length than most rows have are left out like null ones. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, map_rows, stored
from .vectors import distances, kmeans, matrix, sample, usable

SAMPLE = 40_000
SAMPLE_QUERIES = 256
TARGET = 0.97
PER_LIST = 64
MAX_LISTS = 8_192
REPLICAS = 4
CLOSURE = 0.05
APART = 0.7
ENTRIES = 16
#: Ratios are taken to the distance of this nearest list: the very nearest of a row that the fit has seen is too near.
BASE = 4
NEIGHBOURS = 16
FAN = 8
BEAM = 8
CHUNK = 4_096
#: Opened lists hold SPARE * k ids at least, besides the query's own: for isolated vectors and small groups of copies, whose nearest lists hold few.
SPARE = 2


def balanced_centroids(x: np.ndarray, most: int, seed: int = 1) -> np.ndarray:
    """Centroids of clusters with at most ``most`` rows of x each (unless copies), by repeated splits; siblings are next to each other."""
    if len(x) <= most or (x == x[0]).all():
        return x.mean(axis=0, keepdims=True)
    c = kmeans(x, min(FAN, -(-len(x) // most)), rounds=8, seed=seed)
    own = distances(x, c).argmin(axis=1)
    parts = [x[own == k] for k in range(len(c))]
    if max(len(p) for p in parts) == len(x):
        return x.mean(axis=0, keepdims=True)
    return np.concatenate([balanced_centroids(p, most, seed + 1) for p in parts if len(p)])


def refined(x: np.ndarray, c: np.ndarray, rounds: int = 4, step: int = 4_096) -> np.ndarray:
    """Centroids after further Lloyd's steps over all of them, in blocks of rows; order kept, an empty one stays."""
    for _ in range(rounds):
        own = np.concatenate([distances(x[i : i + step], c).argmin(axis=1) for i in range(0, len(x), step)])
        n, order = np.bincount(own, minlength=len(c)), np.argsort(own, kind="stable")
        full = np.flatnonzero(n)
        c = c.copy()
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
    return c


class Lists:
    def __init__(self, x: np.ndarray, rows: int, longest: float, k: int):
        self.longest = longest
        x = self.stretch(x)
        # rows that the centroids were fitted on lie nearer to them than others: the ratio is measured on the rest
        x, apart = np.split(x, [-(-3 * len(x) // 4)])
        lists = int(np.clip(rows / PER_LIST, 1, min(MAX_LISTS, max(1, len(x) // 4))))
        self.centroids = refined(x, balanced_centroids(x, -(-len(x) // lists)))
        d = distances(self.centroids, self.centroids)
        self.graph = np.argsort(d, axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        # means of FAN neighbours each, level upon level: where the graph search starts
        self.levels = [self.centroids]
        while len(self.levels[-1]) > ENTRIES:
            at = np.arange(0, len(self.levels[-1]), FAN)
            self.levels.append(np.add.reduceat(self.levels[-1], at, axis=0) / np.diff(np.append(at, len(self.levels[-1])))[:, None])
        self.ratio = self._measure(apart, rows, k) if len(apart) > 1 else 1.0

    def stretch(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    @staticmethod
    def query(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1)[:, None]  # squares of very small components would vanish
        return np.column_stack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x))])

    def entries(self, q: np.ndarray) -> np.ndarray:
        """Lists below the nearest means, ENTRIES of each level followed down."""
        at = np.arange(len(self.levels[-1]))
        for level, below in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            diff = level[at] - q
            best = at[np.argsort((diff * diff).sum(axis=1), kind="stable")[:ENTRIES]]
            at = (best[:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < len(below)]
        return at

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search over the centroid graph for one row: (lists, squared distances), all within the ratio
        of the BASE-th nearest that the walk meets. It goes on while its next centroids are within the ratio, plus a slack for detours."""
        seen = np.zeros(len(self.centroids), bool)
        fresh, ids, ds, heap, first = self.entries(q), [], [], [], np.empty(0)
        while True:
            seen[fresh] = True
            diff = self.centroids[fresh] - q
            d = (diff * diff).sum(axis=1)
            ids.append(fresh)
            ds.append(d)
            first = np.sort(np.concatenate([first, d]))[:BASE]
            near = first[-1]
            for item in zip(d.tolist(), fresh.tolist()):
                heapq.heappush(heap, item)
            end = near * max(1.02, self.ratio * 1.02) ** 2
            front = []
            while heap and len(front) < BEAM and heap[0][0] <= end:
                front.append(heapq.heappop(heap)[1])
            if not front:
                break
            fresh = np.unique(self.graph[front])
            fresh = fresh[~seen[fresh]]
        ids, ds = np.concatenate(ids), np.concatenate(ds)
        inside = ds <= near * self.ratio**2
        return ids[inside], ds[inside]

    def open(self, q: np.ndarray, held: np.ndarray, need: int) -> np.ndarray:
        """Lists that one query row opens: those of the search and, until they hold ``need`` ids (``held`` by list) or all are open, further ones, nearest first."""
        found, _ = self.search(q)
        if held[found].sum() >= need:
            return found
        d = distances(q[None, :], self.centroids)[0]
        d[found] = -1.0
        order = np.argsort(d, kind="stable")
        return order[: max(len(found), int(np.searchsorted(np.cumsum(held[order]), need)) + 1)]

    def _measure(self, x: np.ndarray, rows: int, k: int) -> float:
        q = self.query(x[:SAMPLE_QUERIES, :-1] + 1e-300)
        # the k nearest of all rows are about as near as this many of the sample
        most = min(len(x) - 1, max(1, round(k * len(x) / rows)))
        top = np.argsort(distances(q, x), axis=1, kind="stable")[:, 1 : most + 1]
        d = np.sqrt(distances(q, self.centroids))
        stored_in = self.closure(x[top.ravel()]).reshape(*top.shape, -1)
        # the nearest list that has the neighbour
        need = np.where(stored_in, d[:, None, :], np.inf).min(axis=2)
        # a query at its centroids has no ratio; what it opens is left to open()
        near = np.sort(d, axis=1)[:, min(BASE, d.shape[1]) - 1]
        need = need[near > 0] / near[near > 0][:, None]
        ratio = float(np.quantile(need, TARGET)) + 1e-9 if len(need) else 1.0
        if not np.isfinite(ratio):
            raise ValueError("the probe ratio is not finite")
        return ratio

    def closure(self, x: np.ndarray) -> np.ndarray:
        """Which lists keep each row."""
        d = np.sqrt(distances(x, self.centroids))
        rows = np.arange(len(x))
        order = np.argpartition(d, min(REPLICAS, d.shape[1]) - 1, axis=1)[:, :REPLICAS]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1)
        keep = np.zeros(d.shape, bool)
        keep[rows, order[:, 0]] = True
        for j in range(1, order.shape[1]):
            c = order[:, j]
            ok = d[rows, c] <= d[rows, order[:, 0]] * (1 + CLOSURE)
            for i in range(j):
                between = self.centroids[c] - self.centroids[order[:, i]]
                ok &= ~keep[rows, order[:, i]] | ((between * between).sum(axis=1) >= APART**2 * d[rows, c] ** 2)
            keep[rows[ok], c[ok]] = True
        return keep


def _to_lists(vectors: DataFrame, lists) -> DataFrame:
    """(id, vec, list): one row for each list that keeps a vector."""

    def make():
        m = lists.value

        def f(batch):
            r, c = np.nonzero(m.closure(m.stretch(matrix(batch.column(1)))))
            return pa.table([batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(c, pa.int32())], names=["id", "vec", "list"])

        return f

    return map_rows(vectors, make, "id long, vec array<double>, list int", max_bytes=256 << 10)


def _to_groups(queries: DataFrame, lists, held, groups, need: int) -> DataFrame:
    """(id, vec, grp, open): one row for each group in which a query opens lists, with those."""

    def make():
        m, first, parts = lists.value, *groups.value

        def f(batch):
            x = matrix(batch.column(1))
            rows, grp, opened = [], [], []
            for i, q in enumerate(m.query(x)):
                found = np.sort(m.open(q, held.value, need))
                where: dict[int, list[int]] = {}
                for c in found.tolist():  # a list's groups: one, or several if it is long
                    for g in range(first[c], first[c] + parts[c]):
                        where.setdefault(g, []).append(c)
                rows += [i] * len(where)
                grp += where.keys()
                opened += where.values()
            at = pa.array(rows, pa.int64())
            return pa.table([batch.column(0).take(at), batch.column(1).take(at), pa.array(grp, pa.int32()), pa.array(opened, pa.list_(pa.int32()))], names=["id", "vec", "grp", "open"])

        return f

    return map_rows(queries, make, "id long, vec array<double>, grp int, open array<int>", max_bytes=256 << 10)


def group_lists(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first group, how many groups) of each list: neighbours share a group of at most CHUNK vectors, longer lists have several of their own."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    g, used = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if used and used + n > CHUNK:
            g, used = g + 1, 0
        first[i], parts[i] = g, max(1, -(-n // CHUNK))
        if parts[i] > 1:
            g, used = g + parts[i], 0
        else:
            used += n
    return first, parts


def _best_of(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) for a query among rows with rough scores (-inf: not opened). Scores are summed again in order,
    so equal vectors have equal ones; what is within rounding of the k-th stays in until then."""
    score = np.where(ids == own, -np.inf, score)
    most = 4 * k
    while True:
        cut = np.partition(score, len(score) - most)[len(score) - most] if len(score) > most else -np.inf
        pick = np.flatnonzero((score >= cut - 1e-9 * max(1.0, abs(cut))) & (score > -np.inf)) if np.isfinite(cut) else np.flatnonzero(score > -np.inf)
        exact = np.cumsum(x[pick] * q, axis=1)[:, -1] if len(pick) else np.empty(0)
        order = np.lexsort((ids[pick], -exact))
        _, first = np.unique(ids[pick][order], return_index=True)  # a repeated id counts once, with its best row
        if len(first) >= k or not np.isfinite(cut):
            order = order[np.sort(first)[:k]]
            return ids[pick][order], exact[order]
        most *= 4


def _best(k: int):
    """Rows sorted by group, stored vectors (kind 0, with their list) before queries (kind 1, with the lists they open)
    -> the best k of each query in the group, and one row without vec_id that has how many vectors it met."""

    def score_block(ids, q, opened, have, lists, x):
        out = []
        score, met = np.full((len(ids), len(have)), -np.inf), np.zeros(len(ids), np.int64)
        who: dict[int, list[int]] = {}
        for i, cs in enumerate(opened):
            for c in cs:
                who.setdefault(c, []).append(i)
        for c, rows in who.items():
            lo, hi = np.searchsorted(lists, [c, c + 1])
            if hi > lo:
                score[rows, lo:hi] = q[rows] @ x[lo:hi].T
                met[rows] += hi - lo
        for i, own in enumerate(ids.tolist()):
            best, s = _best_of(q[i], own, have, x, score[i], k)
            out.append((np.full(len(best), own), best, s))
        n = [len(o[1]) for o in out]
        vec = pa.concat_arrays([pa.array(np.concatenate([o[1] for o in out]), pa.int64()), pa.nulls(len(ids), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(ids, n), ids])), vec, pa.array(np.concatenate([*(o[2] for o in out), met.astype(float)]))], ["query_id", "vec_id", "score"])

    def run(batches):
        key, parts, here = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            grp, kind, ids, vec = (b.column(i).to_numpy(zero_copy_only=False) if i < 3 else matrix(b.column(i)) for i in range(4))
            new = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            for lo, hi in zip(new, np.append(new[1:], b.num_rows), strict=True):
                if grp[lo] != key:
                    key, parts, here = grp[lo], [], None
                own = np.flatnonzero(kind[lo:hi] == 0) + lo
                if len(own):
                    parts.append((ids[own], np.array([c[0] for c in b.column(4).take(pa.array(own)).to_pylist()]), vec[own]))
                ask = np.flatnonzero(kind[lo:hi] == 1) + lo
                if not len(ask) or not parts:
                    continue
                if here is None:
                    have, lists, x = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(lists, kind="stable")
                    here = have[order], lists[order], x[order]
                for i in range(0, len(ask), 256):
                    at = ask[i : i + 256]
                    yield score_block(ids[at], vec[at], b.column(4).take(pa.array(at)).to_pylist(), *here)

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, scanned): the k nearest found for each query (all candidates, if fewer), ties to the smaller
    id; scanned: how many stored vectors, replicas included, the query was compared with."""
    spark = df.sparkSession
    v = usable(df, id_col, vec_col, is_query)
    v = stored(v.groupBy("id", "vec").agg(F.max("flag").alias("flag")), "usable")
    first = v.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")).first()
    if not first["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scanned long")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / first["top"]) * (x / first["top"])))
    longest = first["top"] * v.agg(F.max(length)).first()[0]
    model = Lists(sample(v, SAMPLE), first["n"], longest, k)
    lists, count = spark.sparkContext.broadcast(model), len(model.centroids)  # at most 2 * MAX_LISTS centroids
    placed = stored(_to_lists(v.select("id", "vec"), lists), "placed")

    def by_list(rows: DataFrame) -> np.ndarray:  # one row for each list at most
        t, out = rows.toArrow(), np.zeros(count, np.int64)
        out[t["list"].to_numpy()] = t["count"].to_numpy()
        return out

    # an id counts in one of its lists only, so the sum over opened lists never exceeds the ids in them
    held = by_list(placed.groupBy("id").agg(F.min(F.struct(F.xxhash64("id", "list"), "list")).alias("home")).groupBy("home.list").count())
    groups = group_lists(by_list(placed.groupBy("list").count()))
    where = spark.createDataFrame([(c, int(groups[0][c]), int(groups[1][c])) for c in range(count)], "list int, first int, parts int")
    held, groups = spark.sparkContext.broadcast(held), spark.sparkContext.broadcast(groups)
    m = placed.join(F.broadcast(where), "list").select((F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("parts"))).cast("int").alias("grp"), F.lit(0).cast("byte").alias("kind"), "id", "vec", F.array("list").alias("open"))
    q = _to_groups(v.filter("flag").select("id", "vec"), lists, held, groups, SPARE * k + 1).select("grp", F.lit(1).cast("byte").alias("kind"), "id", "vec", "open")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = m.unionByName(q).repartition(parts, "grp").sortWithinPartitions("grp", "kind")
    found = stored(met.mapInArrow(_best(k), "query_id long, vec_id long, score double"), "found")
    scanned = found.filter("vec_id is null").groupBy("query_id").agg(F.sum("score").cast("long").alias("scanned"))
    best = found.filter("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = stored(best.withColumn("rank", rank).filter(F.col("rank") <= k).join(scanned, "query_id").select("query_id", "rank", "vec_id", "score", "scanned"), "nearest")
    for t in (v, placed, found):
        drop_stored(t)
    return out
