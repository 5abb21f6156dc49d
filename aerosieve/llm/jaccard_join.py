"""Operator 5: n-gram Jaccard join with signature trees.

Two texts link when the Jaccard similarity of their sets of word n-grams reaches
``percent``/100 (integer arithmetic on 64-bit hashes of the n-grams).

1. A count sketch of fixed size (2**20 counters, 4 MB at any input size) gives every n-gram
   a global rank: rare first, ties by hash. Any fixed rank keeps the next step exact.
2. Prefix rule: of a set of n, the first ``n - ceil(t n) + 1`` n-grams by rank
   must meet those of any set it links with; how often is known from both sizes. A sketch that is full for a large input
   ranks poorly, so prefixes are taken twice: n-grams counted (exactly, by a shuffle of prefixes only) in the prefixes of more than
   SHORT_RUN texts are marked in a bitmap of fixed size and moved behind all others, and texts that had any get new prefixes. Texts that
   meet often enough form blocks (components). An n-gram that is still in the prefixes of
   many texts ties them to one of them, so no group is expanded into its pairs. Exact
   copies in a task are collapsed before anything is shuffled.
3. Only members of blocks are read again. A block is cut into chunks of bounded
   weight, and tiles of two chunks go to tasks; one hot block thus spreads over many.
4. A tile builds a signature tree on each chunk: nodes hold the OR of
   token bitmaps below them and the range of set sizes. Dual traversal drops a pair
   of nodes when their largest possible overlap is below what the sizes
   ask for, or when all below them is connected already; leaf pairs are
   verified on the whole sets. A tile returns a spanning forest of its links.
5. Components of the forest edges give the classes.

Texts that are null, empty or only white space have the empty set and link with nothing.
With fewer words than ``n`` the whole sequence is the one n-gram. Rows with a null
id are left out of the result. Very long texts are hashed whole, and a chunk is larger by what one of them exceeds its share. N-grams of equal counts are ranked by
hash, so ties change candidates, never links. An empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, drop_stored, map_rows, mix, ngram_hashes, stored, texts
from .components import components

SKETCH_BITS = 20
SLICES = 64
#: n-grams in a chunk of a block: bounds the memory of a tile (8 bytes each, and bitmaps).
CHUNK_NGRAMS = 1_500_000
CHUNK_SETS = 2_048
#: Bitmaps of documents (2 MB) and of common n-grams (16 MB).
FILTER_BITS, COMMON_BITS = 24, 27
#: Up to so many documents with one n-gram in their prefixes, their pairs are counted.
SHORT_RUN = 16


def ngram_set(words: list[bytes], n: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    if not words:
        return np.empty(0, np.uint64)
    h = hasher.hashes(words)
    return np.unique(ngram_hashes(h, min(n, len(h))))


def least_overlap(a, b, percent: int):
    """Smallest intersection with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """n-grams of a set of n of which at least one is in every set it links with."""
    return n - (-(-percent * n // 100)) + 1


def _sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    size = 1 << SKETCH_BITS

    def make():
        hasher, counts = WordHasher(), np.zeros(size, np.int64)

        def f(batch):
            words = [hasher.hashes(w) for t in texts(batch.column(0)) if (w := t.lower().split())]
            if words:  # a repeated n-gram counts more than once here: a rank needs no better
                h = np.concatenate([ngram_hashes(w, min(n, len(w))) for w in words])
                counts[:] += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
            hasher.trim()

        def finish():
            step = size // SLICES
            yield pa.table({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([counts[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary())})

        f.finish = finish
        return f

    def add(pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        pdf = pdf.iloc[:1].copy()
        pdf["counts"] = [total.tobytes()]
        return pdf

    parts = map_rows(docs.select(text), make, "slice int, counts binary")
    rows = parts.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()  # SLICES rows, 8 MB in all
    out = np.zeros(size, np.int64)
    for r in rows:
        step = size // SLICES
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return out


def _bits_of(column: pa.Array, marked: np.ndarray) -> np.ndarray:
    """Which positions of a column are set in a bitmap."""
    k = column.to_numpy(zero_copy_only=False).astype(np.int64)
    return ((marked[k >> 3] >> (k & 7)) & 1).astype(bool)


def _bitmap_by_spark(rows: DataFrame, position: Column, bits: int) -> np.ndarray:
    """Bitmap of 2**bits positions of a column, built page by page in Spark: at most 2**bits / 32768 rows of 4 KB reach the driver."""
    h = rows.select((position + 1).alias("h")).select("h", F.bitmap_bucket_number("h").alias("page")).repartition("page")
    pages = h.groupBy("page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in pages:
        table[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["bits"], np.uint8)[: len(table)]
    return table


def _doc_bit(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(1 << FILTER_BITS))


def _with_bit(rows: DataFrame, position: Column, marked, want: bool) -> DataFrame:
    """Rows whose position is set (or not) in a broadcast bitmap."""

    def make():
        m = marked.value

        def f(batch):
            return batch.filter(pa.array(_bits_of(batch.column(batch.num_columns - 1), m) == want))

        return f

    d = rows.withColumn("_bit_", position)
    return map_rows(d, make, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in d.schema.fields)).drop("_bit_")


def _prefixes(docs: DataFrame, id_: str, text: str, n: int, percent: int, sketch, common=None, again=None) -> DataFrame:
    """By rank in the sketch, those in the bitmap ``common`` behind all others; only of documents in the bitmap ``again``, if given
    (chosen here, since a second map in the stage would be a second Python process beside each task). kind 0: (doc, n of its set); kind 1: exact copy ``doc`` of ``key``; kind 2: n-gram ``key`` in the prefix of ``doc``."""

    def make():
        hasher, seen, counts, late = WordHasher(), {}, sketch.value, common and common.value
        chosen = again and again.value

        def f(batch):
            if chosen is not None:
                batch = batch.filter(pa.array(_bits_of(batch.column(2), chosen)))
            ids = batch.column(0).to_pylist()
            doc, key, kind, size = [], [], [], []
            for i, t in zip(ids, texts(batch.column(1)), strict=True):
                s = ngram_set(t.lower().split(), n, hasher)
                doc.append(np.array([i]))
                key.append(np.zeros(1, np.int64))
                kind.append(np.zeros(1, np.int8))
                size.append(np.array([len(s)], np.int32))
                if not len(s):
                    continue
                mark = s.tobytes() if len(s) < 4 else (len(s), s[0], s[-1], mix(s * s).sum(), mix(s ^ (s << np.uint64(1))).sum())
                first = seen.setdefault(mark, i)
                if first != i:
                    doc.append(np.array([i]))
                    key.append(np.array([first]))
                    kind.append(np.ones(1, np.int8))
                    size.append(np.array([len(s)], np.int32))
                    continue
                whole = len(s)
                rank = counts[s >> np.uint64(64 - SKETCH_BITS)]
                if late is not None:
                    k = s >> np.uint64(64 - COMMON_BITS)
                    rank = rank + (((late[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1).astype(np.int64) << 40)
                p = prefix_length(len(s), percent)
                if p < len(s):
                    cut = np.partition(rank, p - 1)[p - 1]
                    sure, edge = s[rank < cut], s[rank == cut]
                    s = np.concatenate([sure, edge[: p - len(sure)]])  # s is sorted: ties by hash
                doc.append(np.full(len(s), i))
                key.append(s.view(np.int64))
                kind.append(np.full(len(s), 2, np.int8))
                size.append(np.full(len(s), whole, np.int32))
            hasher.trim()
            if not doc:
                return None
            return pa.table({"doc": pa.array(np.concatenate(doc), pa.int64()), "key": pa.array(np.concatenate(key), pa.int64()),
                             "kind": pa.array(np.concatenate(kind), pa.int8()), "size": pa.array(np.concatenate(size), pa.int32())})

        return f

    return map_rows(docs.select(F.col(id_).cast("long"), F.col(text), _doc_bit(F.col(id_).cast("long"))), make, "doc long, key long, kind byte, size int")


def least_shared(a, b, percent: int):
    """How many n-grams the prefixes of two linked sets of sizes a and b share at least."""
    most = np.maximum(a, b)
    return least_overlap(a, b, percent) + 1 - -(-percent * most // 100)


def _meetings(percent: int):
    """Rows (key, size, doc), sorted -> (a, b, need). Few documents with an n-gram: their pairs whose
    sizes fit, with the number of such meetings a link asks for. Many: each is tied to the first, need 0.
    Holds the rows of a short run, or the first row of a long one."""

    def emit(key, size, doc, long_key):
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(new, len(key)))
        run = np.repeat(length, length)
        if long_key is not None:
            run = np.where(key == long_key, SHORT_RUN + 1, run)
        out = []
        for d in range(1, min(SHORT_RUN, len(key))):
            x = np.flatnonzero((key[d:] == key[:-d]) & (run[d:] <= SHORT_RUN) & (size[d:] * percent <= size[:-d] * 100) & (doc[d:] != doc[:-d]))
            if len(x):
                i, j = doc[x], doc[x + d]
                out.append((np.maximum(i, j), np.minimum(i, j), least_shared(size[x], size[x + d], percent)))
        first = np.repeat(doc[new], length)
        x = (run > SHORT_RUN) & (first != doc)
        if x.any():
            pairs = np.unique(np.stack([doc[x], first[x]]), axis=1)
            out.append((pairs[0], pairs[1], np.zeros(pairs.shape[1], np.int64)))
        if out:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "need"])

    def run(batches):
        held, long_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            key = cols[0]
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > SHORT_RUN or key[-1] == long_key:  # long already: give it out, keep its first row
                yield from emit(*cols, key[-1] if len(key) - last <= SHORT_RUN else long_key)
                long_key, held = key[-1], [c[last : last + 1] for c in cols]
            else:
                if last:
                    yield from emit(*(c[:last] for c in cols), long_key)
                held = [c[last:] for c in cols]
        if held is not None:
            yield from emit(*held, long_key)

    return run


def _bitmap(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in enumerate(sets):
        one = np.zeros(bits, np.uint8)
        one[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
        out[row] = np.packbits(one).view(np.uint64)
    return out


class SignatureTree:
    """A node has the OR of the token bitmaps below it, the range of set sizes,
    and the most elements a set below it has beyond its own bits. Level 0 is the sets."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        size = np.array([len(s) for s in sets])
        leaf = _bitmap(sets, bits)
        self.bits, self.low, self.high = [leaf], [size], [size]
        self.over = [size - np.bitwise_count(leaf).sum(axis=1, dtype=np.int64)]
        while len(self.low[-1]) > 1:
            cut = np.arange(0, len(self.low[-1]), self.FAN)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cut, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.over.append(np.maximum.reduceat(self.over[-1], cut))

    def spread(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest class below each node, level by level."""
        out = [(label, label)]
        while len(out[-1][0]) > 1:
            cut = np.arange(0, len(out[-1][0]), self.FAN)
            out.append((np.minimum.reduceat(out[-1][0], cut), np.maximum.reduceat(out[-1][1], cut)))
        return out

    def below(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * self.FAN, min((node + 1) * self.FAN, len(self.low[level - 1])))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``left`` (``right`` None) or between both lists, as
    pairs of positions, by dual traversal of signature trees. Sets are sorted arrays; lists in which
    neighbours are alike prune best."""
    if not left or right is not None and not right:
        return []
    most = max(len(s) for s in [*left, *(right or [])])
    bits = 64
    while bits < 8 * most and bits < 1 << 15:
        bits *= 2
    a = SignatureTree(left, bits)
    b = a if right is None else SignatureTree(right, bits)
    shift = 0 if right is None else len(left)
    union, found = _Union(shift + len(b.sets)), []

    def verify(i: int, j: int) -> None:
        x, y = a.sets[i], b.sets[j]
        need = least_overlap(len(x), len(y), percent)
        if min(len(x), len(y)) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need:
            union.join(i, j + shift)
            found.append((i, j))

    if right is None:  # neighbours first: classes known early prune most
        for i in range(len(left) - 1):
            verify(i, i + 1)
    fresh, known = -1, None
    stack = [(len(a.low) - 1, 0, len(b.low) - 1, 0)]
    while stack:
        la, na, lb, nb = stack.pop()
        if la == 0 and lb == 0:
            if (right is not None or na < nb) and union.find(na) != union.find(nb + shift):
                verify(na, nb)
            continue
        if known is None or len(found) - fresh > 16 + len(union.up) // 16:
            label = np.array([union.find(x) for x in range(len(union.up))])
            known, fresh = (a.spread(label[: len(left)]), b.spread(label[shift:])), len(found)
        # the higher side's children, or both sides', meet in one vector step
        down_a, down_b = la > 0 and la >= lb, lb > 0 and lb >= la
        ca = a.below(la, na) if down_a else np.array([na])
        cb = b.below(lb, nb) if down_b else np.array([nb])
        la, lb = la - down_a, lb - down_b
        xb, yb = a.bits[la][ca], b.bits[lb][cb]
        common = np.bitwise_count(xb[:, None, :] & yb[None, :, :]).sum(axis=2, dtype=np.int64)
        xl, xh, yl, yh = a.low[la][ca][:, None], a.high[la][ca][:, None], b.low[lb][cb][None, :], b.high[lb][cb][None, :]
        # at most the common bits, plus the elements that share a bit with others of their own set
        room = common + np.minimum(a.over[la][ca][:, None], b.over[lb][cb][None, :])
        room = np.minimum(room, np.minimum(xh, yh))
        ok = (room >= least_overlap(xl, yl, percent)) & (100 * xh >= percent * yl) & (100 * yh >= percent * xl)
        (mina, maxa), (minb, maxb) = known[0][la], known[1][lb]
        one = (mina[ca] == maxa[ca])[:, None] & (minb[cb] == maxb[cb])[None, :] & (mina[ca][:, None] == minb[cb][None, :])
        ok &= ~one
        if right is None and la == lb:
            ok &= ca[:, None] <= cb[None, :]
        for i, j in zip(*np.nonzero(ok)):
            stack.append((la, int(ca[i]), lb, int(cb[j])))
    return found


def _tile(rows: list[tuple[int, int, bytes]], n: int, percent: int, hasher: WordHasher) -> list[tuple[int, int]]:
    """Links of one tile; rows are (side, doc, text)."""
    sides = []
    for side in (0, 1):
        part = [(ngram_set(t.lower().split(), n, hasher), doc) for k, doc, t in rows if k == side]
        sides.append(sorted((x for x in part if len(x[0])), key=lambda x: (*x[0][:2].tolist(), len(x[0]), x[1])))
    left, right = sides
    if not right and any(k for k, *_ in rows):
        return []
    links = tree_links([s for s, _ in left], [s for s, _ in right] if right else None, percent)
    return [(left[i][1], (right or left)[j][1]) for i, j in links]


def _tiles(n: int, percent: int):
    """Batches sorted by tile -> links; holds the rows of one tile."""

    def run(batches):
        hasher, key, rows, out = WordHasher(), None, [], []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for *k, side, doc, t in zip(*cols, texts(b.column(5)), strict=True):
                if k != key:
                    out += _tile(rows, n, percent, hasher)
                    key, rows = k, []
                rows.append((side, doc, t))
            hasher.trim()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
                out = []
        out = _tile(rows, n, percent, hasher)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def find_blocks(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> dict[str, DataFrame]:
    """Stored tables: rows and anew (sizes and copies, see :func:`_prefixes`), meet (a, b) and block (node, component)."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, text_col, n))
    rows = stored(_prefixes(docs, id_col, text_col, n, percent, sketch), "prefix")
    prefix = rows.filter("kind = 2").select("key", "size", "doc")
    # n-grams common in prefixes go behind all others; texts that had one get new prefixes, those of the rest stay as they are
    often = prefix.groupBy("key").count().filter(F.col("count") > SHORT_RUN).select("key")
    at = F.shiftrightunsigned("key", 64 - COMMON_BITS)
    common = spark.sparkContext.broadcast(_bitmap_by_spark(often, at, COMMON_BITS))
    touched = _with_bit(prefix.select("key", "doc"), at, common, True).select("doc").distinct()
    again = spark.sparkContext.broadcast(_bitmap_by_spark(touched, _doc_bit(F.col("doc")), FILTER_BITS))
    anew = stored(_prefixes(docs, id_col, text_col, n, percent, sketch, common, again), "anew")
    prefix = _with_bit(prefix, _doc_bit(F.col("doc")), again, False).unionByName(anew.filter("kind = 2").select("key", "size", "doc"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = prefix.repartition(parts, "key").sortWithinPartitions("key", "size", "doc")
    meet = shared.mapInArrow(_meetings(percent), "a long, b long, need int").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    meet = stored(meet.filter("n >= need").select("a", "b"), "meet")
    return {"rows": rows, "anew": anew, "meet": meet, "block": stored(components(meet), "block")}


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) for every id of ``docs``.

    Repeated ids: all rows of an id count as one document, the widest set's
    size is given and their links are pooled. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).filter(F.col(id_col).isNotNull())
    found = find_blocks(docs, id_col, text_col, n, percent)
    rows, block = found["rows"], found["block"]
    sizes = rows.filter("kind = 0").select("doc", "size")
    copies = rows.unionByName(found["anew"]).filter("kind = 1").select(F.col("doc").alias("a"), F.col("key").alias("b"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")

    # chunks of bounded weight in every block; the hash spreads sizes evenly over the chunks
    members = block.join(sizes.groupBy("doc").agg(F.max("size").alias("size")).withColumnRenamed("doc", "node"), "node")
    weight = members.groupBy("component").agg(F.sum("size").alias("w"), F.count("*").alias("c"))
    weight = weight.withColumn("chunks", F.greatest(F.ceil(F.col("w") / CHUNK_NGRAMS), F.ceil(F.col("c") / CHUNK_SETS)).cast("int"))
    placed = members.join(weight, "component").select(
        F.col("node"), "component", "chunks", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"))
    tiles = placed.select("node", "component", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(
            F.least("chunk", k).alias("x"), F.greatest("chunk", k).alias("y"),
            F.when(F.col("chunk") <= k, 0).otherwise(1).alias("side")))).alias("t")).select("node", "component", "t.*")

    # only texts of block members are shuffled: a bitmap of fixed size drops nearly all others at the scan
    members = spark.sparkContext.broadcast(_bitmap_by_spark(block, _doc_bit(F.col("node")), FILTER_BITS))
    texts_in = _with_bit(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), _doc_bit(F.col("doc")), members, True)
    todo = texts_in.join(tiles, texts_in["doc"] == tiles["node"]).select("component", "x", "y", "side", "doc", "text")
    todo = todo.repartition(int(parts), "component", "x", "y").sortWithinPartitions("component", "x", "y", "side")
    links = todo.mapInArrow(_tiles(n, percent), "a long, b long")
    edges = stored(links.unionByName(copies), "links")
    label = components(edges)
    out = (sizes.groupBy("doc").agg(F.max("size").cast("long").alias("n_shingles"))
           .join(label, F.col("doc") == F.col("node"), "left")
           .select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id")))
    out = stored(out, "classes")
    for t in (*found.values(), edges):
        drop_stored(t)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest id, and of several rows with that id the one with the smallest
    hash over all columns. Rows with a null id stay."""
    drop = jaccard_classes(docs, id_col, text_col, n, percent).filter(F.col("component_id") != F.col(id_col)).select(id_col)
    kept = docs.join(drop, id_col, "left_anti").select(docs.columns)
    many = stored(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "repeated")
    if many.isEmpty():
        drop_stored(many)
        return kept
    # equal rows are reduced before the shuffle; a minimum keeps one row at a time
    row, mark = F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*[F.col(c) for c in docs.columns])
    one = kept.join(many, id_col, "left_semi").select(F.col(id_col).alias("_id"), row.alias("_row"), mark.alias("_mark")).groupBy("_id").agg(F.min_by("_row", "_mark").alias("_row"))
    return kept.join(many, id_col, "left_anti").select(docs.columns).unionByName(one.select("_row.*"))
