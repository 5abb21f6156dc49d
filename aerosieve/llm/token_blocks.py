"""Operator 8: token ids in patched frame-of-reference blocks.

File format, version 1. A store is a Parquet folder of segments, which Spark can write to and read
from any shared store. A segment has whole documents in ascending id order and

    shard, segment, first   its place: shards in order, segments in order, ids before it in the shard
    n                       ids in it
    doc_ids, lengths        its documents and their ids' counts (end id included)
    starts                  byte offset of each block: block k holds ids k * BLOCK up to (k + 1) * BLOCK
    data                    the blocks

and a block, little-endian: uint32 minimum, uint8 width, uint8 0, uint16 exceptions; the differences to
the minimum, packed at ``width`` bits, most significant bit first, padded to a byte (0 for an
exception); then the exceptions' positions as uint16 and their full differences as uint32.
The width is the PERCENTILE of the widths that the block's differences need.

Texts are encoded with the tokenizers library. A single space or newline between two other
characters always starts a new piece of its pre-tokenizer, so words are encoded apart and a bounded cache keeps them;
texts with runs of white space are encoded whole, very long ones included. Null counts as empty: just the end id. Rows
with equal ids are ordered by a hash of the text, a null id comes first. An empty table gives an empty store;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows

BLOCK = 1024
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
CACHE = 800_000
SCHEMA = "shard int, segment int, first long, n long, doc_ids array<long>, lengths array<long>, starts array<int>, data binary"
#: White space other than space and newline.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_SPACE = [c for c in _OTHER_SPACE if c < "\x80"]


def _whole(t: str) -> bool:
    """Whether a text is encoded whole: runs of white space, white space at the ends, marks that may be special pieces."""
    if not t:
        return False
    if t[0].isspace() or t[-1].isspace() or any(x in t for x in ("  ", "\n\n", " \n", "\n ", "<|")):
        return True
    return any(c in t for c in (_ASCII_SPACE if t.isascii() else _OTHER_SPACE))


def _bits(d: np.ndarray, width: int) -> np.ndarray:
    """(rows, count) differences -> packed rows. Eight differences take ``width`` bytes, each put together by shifts."""
    rows, count = d.shape
    padded = np.zeros((rows, -(-count // 8) * 8), np.uint32)
    padded[:, :count] = d
    v = np.ascontiguousarray(padded.reshape(-1, 8).T)
    out = np.zeros((v.shape[1], width), np.uint8)
    for j in range(width):
        for i in range(8 * j // width, min(7, (8 * j + 7) // width) + 1):
            down = (i + 1) * width - 8 * (j + 1)
            out[:, j] |= (v[i] >> np.uint32(down) if down >= 0 else v[i] << np.uint32(-down)).astype(np.uint8)
    return out.reshape(rows, -1)[:, : -(-count * width // 8)]


def _numbers(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    rows, groups = len(packed), -(-count // 8)
    padded = np.zeros((rows, groups * width), np.uint8)
    padded[:, : packed.shape[1]] = packed
    p = np.ascontiguousarray(padded.reshape(-1, width).T)
    out = np.empty((rows * groups, 8), np.uint32)
    for i in range(8):
        first, last = i * width // 8, ((i + 1) * width - 1) // 8
        x = p[first].astype(np.uint64)
        for j in range(first + 1, last + 1):
            x = (x << np.uint64(8)) | p[j]
        out[:, i] = ((x >> np.uint64(8 * (last + 1) - (i + 1) * width)) & np.uint64((1 << width) - 1)).astype(np.uint32)
    return out.reshape(rows, -1)[:, :count]


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts and the bytes of all blocks of ``ids`` (uint32)."""
    parts: list[bytes] = [b""] * -(-len(ids) // BLOCK)
    full = len(ids) // BLOCK
    groups = [(range(full), ids[: full * BLOCK].reshape(full, BLOCK))] if full else []
    if len(ids) % BLOCK:
        groups.append((range(full, full + 1), ids[full * BLOCK :].reshape(1, -1)))
    for where, x in groups:
        low = x.min(axis=1)
        d = x - low[:, None]
        need = np.frexp(d.astype(np.float64))[1]  # bits of each difference, exact in a double
        at = -(-d.shape[1] * PERCENTILE // 100) - 1
        width = np.partition(need, at, axis=1)[:, at]
        odd = need > width[:, None]
        d_low = np.where(odd, 0, d).astype(np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            packed = _bits(d_low[rows], int(w)) if w else np.zeros((len(rows), 0), np.uint8)
            for r, p in zip(rows, packed, strict=True):
                at = np.flatnonzero(odd[r])
                head = np.array([low[r]], "<u4").tobytes() + bytes([int(w), 0]) + np.array([len(at)], "<u2").tobytes()
                parts[where[r]] = head + p.tobytes() + at.astype("<u2").tobytes() + d[r, at].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    return starts.astype(np.int32), b"".join(parts)


def unpack_blocks(starts: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """All ids of a segment. Blocks of one width are unpacked together."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(n, np.uint32)
    if not n:
        return out
    starts = starts.astype(np.int64)
    heads = raw[starts[:, None] + np.arange(8)]
    low, width, odd = heads[:, :4].copy().view("<u4")[:, 0], heads[:, 4].astype(int), heads[:, 6:8].copy().view("<u2")[:, 0]
    count = np.full(len(starts), BLOCK)
    count[-1] = n - BLOCK * (len(starts) - 1)
    for w, c in sorted(set(zip(width.tolist(), count.tolist(), strict=True))):
        rows = np.flatnonzero((width == w) & (count == c))
        size = -(-c * w // 8)
        d = _numbers(raw[(starts[rows] + 8)[:, None] + np.arange(size)], c, w) if w else np.zeros((len(rows), c), np.uint32)
        for i, r in enumerate(rows):
            if odd[r]:
                at = starts[r] + 8 + size
                d[i, np.frombuffer(data, "<u2", odd[r], at)] = np.frombuffer(data, "<u4", odd[r], at + 2 * odd[r])
        d += low[rows][:, None]
        out[(rows * BLOCK)[:, None] + np.arange(c)] = d
    return out


def block_at(starts: np.ndarray, data: bytes, n: int, position: int) -> np.ndarray:
    """The ids of the one block that holds ``position``: random access by the index of block starts."""
    k = position // BLOCK
    count = min(BLOCK, n - k * BLOCK)
    end = starts[k + 1] if k + 1 < len(starts) else len(data)
    return unpack_blocks(np.zeros(1, np.int32), data[starts[k] : end], count)


class WordEncoder:
    """texts -> ids, the same as the library gives for each whole text.

    A batch is split and its distinct words numbered in Arrow; only distinct words are looked up, and Arrow
    puts their ids together. Words that the cache lacks are encoded joined, many in a string: a piece that
    starts with the joining character starts a word. A word is kept with the space or newline before it."""

    _here: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for all tasks of a worker process."""
        if path not in cls._here:
            cls._here[path] = cls(path)
        return cls._here[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = {lead: np.zeros(max(vocabulary.values()) + 1, bool) for lead in (" ", "\n")}
        for piece, k in vocabulary.items():
            # the byte-level alphabet writes a space and a newline with these letters
            self.starts[" "][k], self.starts["\n"][k] = piece[0] == "\u0120", piece[0] == "\u010a"
        self.first: dict[str, bytes] = {}  # ids, as little-endian uint32, of words with nothing before them
        self.later: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for lead in (" ", "\n"):
            new = [w for w in words if (w[:1] == "\n") == (lead == "\n")]
            groups = [new[i : i + 1_000] for i in range(0, len(new), 1_000)]
            joined = ["".join([" " + w for w in g]) if lead == " " else "".join(g) for g in groups]
            for g, ids in zip(groups, self._encode(joined), strict=True):
                at = np.flatnonzero(self.starts[lead][ids])
                if len(at) == len(g) and at[0] == 0:
                    raw, cut = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
                    self.later.update(zip(g, [raw[x:y] for x, y in zip(cut, cut[1:])], strict=True))
                else:
                    self.later.update(zip(g, [x.tobytes() for x in self._encode([w if lead == "\n" else " " + w for w in g])], strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has) of a string column; null counts as empty."""
        texts = pc.fill_null(texts, "")
        strings = texts.to_pylist()
        odd = np.array([_whole(t) for t in strings], bool)
        plain = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        split = pc.split_pattern(plain, " ")
        lo = split.offsets.to_numpy().astype(np.int64)
        lo -= lo[0]
        words = split.flatten().dictionary_encode()
        names, at = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        heads = [names[k] for k in at[lo[:-1]].tolist()]
        if len(self.later) + len(self.first) + len(names) > CACHE:
            self.first.clear()
            self.later.clear()
        self._learn([w for w in names if w not in self.later])
        new = list({h for h in heads if h not in self.first})
        self.first.update(zip(new, [x.tobytes() for x in self._encode(new)], strict=True))
        at[lo[:-1]] = len(names) + np.arange(len(heads))
        ids = pa.array([*map(self.later.__getitem__, names), *map(self.first.__getitem__, heads)], pa.large_binary()).take(pa.array(at))
        end = np.frombuffer(ids.buffers()[1], np.int64, len(at) + 1) // 4 if len(at) else np.zeros(1, np.int64)
        flat = np.frombuffer(ids.buffers()[2], "<u4", end[-1]) if end[-1] else np.zeros(0, np.uint32)
        counts = np.zeros(len(strings), np.int64)
        counts[~odd] = end[lo[1:]] - end[lo[:-1]]
        whole = np.flatnonzero(odd)
        if not len(whole):
            return flat, counts
        apart = self._encode([strings[k] for k in whole])
        counts[whole] = [len(x) for x in apart]
        out = np.empty(counts.sum(), np.uint32)
        mine = np.repeat(odd, counts)
        out[~mine], out[mine] = flat, np.concatenate(apart)
        return out, counts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes ``docs`` and writes the store at ``path``. tokenizer_path: a file that every executor has (the installed tokenizer).
    Texts are sorted by document before they are encoded: their ids would take as much room in the shuffle."""
    from pyspark import TaskContext

    def run(batches):
        encoder, shard = WordEncoder.of(tokenizer_path), TaskContext.get().partitionId()
        segment = first = held = 0
        docs, sizes, parts = [], [], []
        end = np.array([end_id], np.uint32)

        def close():
            nonlocal segment, first, held, docs, sizes, parts
            flat = np.concatenate(parts)
            starts, data = pack_blocks(flat)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            row = [[shard], [segment], [first], [len(flat)], [docs], [sizes], [starts.tolist()], [data]]
            segment, first, held, docs, sizes, parts = segment + 1, first + len(flat), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            step = max(1, int(batch.num_rows * (12 << 20) / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                cut = batch.slice(i, step)
                ids, counts = encoder.encode(cut.column(1))
                at = 0
                for doc, n in zip(cut.column(0).to_pylist(), counts.tolist(), strict=True):
                    docs.append(doc)
                    sizes.append(n + 1)
                    parts += [ids[at : at + n], end]
                    at, held = at + n, held + n + 1
                    if held >= SEGMENT_IDS:
                        yield close()
        if docs:
            yield close()

    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("h", F.xxhash64("text"))  # an id that very many rows share can be split
    d.repartitionByRange(n, "doc", "h").sortWithinPartitions("doc", "h").select("doc", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the blocks of a store."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one row per shard, so the window runs over a small table
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def make():
        def f(batch):
            t = batch.to_pydict()
            out = []
            for shard, first, n, docs, lengths, starts, data in zip(*(t[c] for c in ("shard", "first", "n", "doc_ids", "lengths", "starts", "data")), strict=True):
                ids = unpack_blocks(np.array(starts), data, n).astype("<u4")
                at = 0
                for doc, k in zip(docs, lengths, strict=True):
                    out.append((shard, doc, first + at, k, zlib.crc32(ids[at : at + k].tobytes())))
                    at += k
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

        return f

    docs = map_rows(rows.drop("segment"), make, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long", max_bytes=8 << 20)
    return docs.join(offsets, "shard").select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<long>) from a store."""

    def make():
        def f(batch):
            t = batch.to_pydict()
            docs, out = [], []
            for ids, lengths, starts, data, n in zip(*(t[c] for c in ("doc_ids", "lengths", "starts", "data", "n")), strict=True):
                flat = unpack_blocks(np.array(starts), data, n)
                docs += ids
                out += np.split(flat.astype(np.int64), np.cumsum(lengths)[:-1])
            return pa.table([pa.array(docs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

        return f

    return map_rows(spark.read.schema(SCHEMA).parquet(path), make, "doc_id long, ids array<long>", max_bytes=8 << 20)
