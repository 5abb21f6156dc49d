"""Operator 9: conflict-constrained best-fit packing.

Documents go into bins of ``capacity`` tokens. A bin takes at most
``per_source`` documents of a source and one of a duplicate cluster. Lengths
are words plus one end mark, unless a column gives them; a longer document is cut
into full bins of its own and a remainder that is packed like the rest.

Documents are dealt to shards by hash, as many shards as the total length and count ask
for, so a hot source or cluster spreads over all of them and no shard grows with the input. In a
shard, longest first, a document goes to the tightest compatible bin: bins are kept
in order of residual, each with bitmaps of its sources (one per allowed repeat)
and clusters, and the successor search walks up from the smallest sufficient residual until the bitmaps
allow the document; else a new bin is opened.

Null or empty texts have length 1. A null source is a source of its own. Null ids are kept beside others of any size; repeated ids are separate
documents, equal rows too: these are dealt over all shards. An empty table gives an empty one; other columns are ignored. Equal texts are one cluster unless ``cluster_col`` is given, and a null cluster conflicts with none.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_stored, map_rows, stored

#: A shard holds about so many bins, and about so many documents at most.
SHARD_BINS, SHARD_DOCS = 512, 4_096
BLOCK = 65_536


def best_fit(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items are (length <= capacity, source, cluster), placed in the given order."""
    shared = {}
    for _, _, c in items:
        if c is not None:
            shared[c] = shared.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in shared.items() if n > 1)}
    source_bit: dict = {}
    residuals: list[tuple[int, int]] = []  # (room left, bin), ascending
    sources: list[list[int]] = []  # bitmaps of a bin: plane k has the sources with more than k documents
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        s = source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.get(cluster, 0)
        at = bisect_left(residuals, (length, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not (sources[b][-1] & s or clusters[b] & c):
                break
            at += 1
        if at < len(residuals):
            room, b = residuals.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append([0] * per_source)
            clusters.append(0)
        placed.append((b, capacity - room))
        for k, plane in enumerate(sources[b]):
            if not plane & s:
                sources[b][k] = plane | s
                break
        clusters[b] |= c
        if room > length:
            insort(residuals, (room - length, b))
    return placed


def word_lengths(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, cluster, length): words + 1, cluster by hash of the text. Whole texts, counted in Arrow."""

    def make():
        def f(batch):
            text = pc.fill_null(batch.column(3), "")
            n = pc.add(pc.cast(pc.count_substring_regex(text, r"[^ \t\n\x0b\f\r]+"), pa.int64()), 1)
            return pa.table([*(batch.column(k) for k in range(3)), n], names=["id", "source", "cluster", "length"])

        return f

    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("cluster"), F.col(text_col).alias("text"))
    return map_rows(d, make, f"id {d.schema[0].dataType.simpleString()}, source string, cluster long, length long")


def pack(docs: DataFrame, capacity: int = 4096, per_source: int = 4, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", length_col: str | None = None, cluster_col: str | None = None) -> DataFrame:
    """(id_col, piece int, bin_id long, bin_offset int, length int): one row per piece of a document."""
    if length_col:
        cluster = F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col)) if cluster_col else F.xxhash64(text_col)
        d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.greatest(F.col(length_col).cast("long"), F.lit(1)).alias("length"))
    elif cluster_col:
        raise ValueError("cluster_col needs length_col")
    else:
        d = word_lengths(docs, id_col, text_col, source_col)
    d = stored(d, "lengths")
    total, count = d.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // (capacity * SHARD_BINS)), -(-count // SHARD_DOCS))
    id_type = d.schema["id"].dataType.simpleString()
    # equal rows may be very many: they are counted, numbered in blocks, and their number takes part in the deal
    row = ["id", "source", "cluster", "length"]
    blocks = d.groupBy(*row).agg(F.count("*").alias("n")).select(*row, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(BLOCK))).alias("first"))
    each = blocks.select(*row, F.explode(F.sequence("first", F.least("n", F.col("first") + BLOCK) - 1)).alias("copy"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "length", "copy"), F.lit(shards)).cast("long")).drop("copy")

    id_arrow = to_arrow_type(d.schema["id"].dataType)

    def group(table):
        # in Arrow, so that ids and clusters beside a null stay what they are; nulls come first
        keys = [("length", "descending"), *((c, "ascending") for c in ("id", "source", "cluster"))]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        length, source, cluster = (table[c].to_pylist() for c in ("length", "source", "cluster"))
        whole, rest = [n // capacity for n in length], [n % capacity for n in length]
        order = sorted((k for k in range(len(length)) if rest[k]), key=lambda k: -rest[k])
        placed = best_fit([(rest[k], source[k], cluster[k]) for k in order], capacity, per_source)
        first = table["shard"][0].as_py() << 32
        rows = [(k, whole[k], first + b, at, rest[k]) for k, (b, at) in zip(order, placed, strict=True)]
        free = max((b for b, _ in placed), default=-1) + 1
        for k, n in enumerate(whole):
            for piece in range(n):
                rows.append((k, piece, first + free, 0, capacity))
                free += 1
        at, piece, bins, offset, size = zip(*rows, strict=True)
        columns = [table["id"].take(pa.array(at)).cast(id_arrow), *(pa.array(v, t) for v, t in ((piece, pa.int32()), (bins, pa.int64()), (offset, pa.int32()), (size, pa.int32())))]
        return pa.table(columns, names=["id", "piece", "bin_id", "bin_offset", "length"])

    out = stored(dealt.groupBy("shard").applyInArrow(group, f"id {id_type}, piece int, bin_id long, bin_offset int, length int"), "packed")
    drop_stored(d)
    return out.withColumnRenamed("id", id_col)
