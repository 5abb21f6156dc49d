"""Operator 11: alignment of two tokenizers' tokens by galloping intersection.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model, which puts a space before the text; both see
space + text. Tokens are byte ranges. The ends that A and B have in common cut a text into groups: the shorter list of
ends drives a search into the longer, in steps that double and then by halves. Within a group the rank of an A token's start and end among B's ends
give the run of B tokens that it overlaps; each such pair of tokens is a link. Links are counted by pair of ids over the whole
corpus, and each text gets the sum of the counts of its links and how many of these are the best of their B id.

A text is cut into units where both tokenizers begin anew whatever stands around: before a space or newline after
something else, and around a newline before something else. (B's vocabulary is checked for it: no piece may hold a
newline beside other characters, or its space mark behind others; else whole texts are units.) Units are aligned once and kept in a bounded cache; new ones are
aligned together, one after the other in two long lists of ends.

Plan. One pass over the texts writes blocks, each a row of some BLOCK_UNITS unit occurrences (or one text, if longer; a text counts as TEXT_UNITS more): its texts'
figures, their units as numbers, and the links of each distinct unit. Spark sums the blocks' counts of links by pair. Pairs that hold more
than one in HOT_PAIRS of all links, fewer than HOT_PAIRS by arithmetic, are broadcast and added up where the blocks are; the
rest of the links, rare by definition, are joined on the pair. Blocks are numbered by task and written, so a lost executor repeats tasks only.
Blocks are read one at a time, and written in row groups of a few: what a task holds does not depend on how much it reads.

Texts that are null or empty, or whose tokens of A or B joined differ from space + text (such as a text with B's space mark in it), have no
tokens: zeros and ''. Special tokens' strings are plain text. Very long texts, runs of white space and words of any length are
aligned whole. Each row has a result, repeated and null ids too; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, drop_stored, map_rows, rows_per_batch, stored

CACHE = 200_000
#: Bytes of all cached units.
CACHE_BYTES = 16 * CACHE
BLOCK_UNITS = 1 << 18
#: What a text, with tokens or without, takes in its block beside its units.
TEXT_UNITS = 16
#: Rows, one for each text, that are read at once with their rare links.
TEXT_ROWS = 256
#: Words that are encoded together.
JOINED = 128
HOT_PAIRS = 1 << 20
MARK = "▁"
UNITS = re.compile(r"\s+(?=\n\S)|\n(?=\S)|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
BLOCK = ("block long, ids array<{0}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, sizes array<int>, "
         "units array<int>, widths array<int>, links array<int>, pairs array<long>, counts array<long>")


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of ``long`` are less than each element of ``short`` (both ascending), at least ``start`` of them: from there in steps that double, then by
    halves, for all elements at once. No element is greater than all of ``long``."""
    low, high, step = start.copy(), start.copy(), 1
    at = np.flatnonzero(long[high] < short)
    while len(at):
        low[at] = high[at] + 1
        high[at] = np.minimum(high[at] + step, len(long) - 1)
        step *= 2
        at = at[long[high[at]] < short[at]]
    at = np.flatnonzero(low < high)
    while len(at):
        middle = (low[at] + high[at]) // 2
        less = long[middle] < short[at]
        low[at] = np.where(less, middle + 1, low[at])
        high[at] = np.where(less, high[at], middle)
        at = at[low[at] < high[at]]
    return low


def intersect(a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of ends up to the same last one, that of fewer tokens driving the search: where they meet (indices of a, indices of b), and for each A token the first and last B token
    that it overlaps. ``starts``: for each token the first one of its unit in the other list, where the search begins."""
    if len(a) <= len(b):
        before = gallop(a, b, starts_a)
        met = b[before] == a
        at_a, at_b = np.flatnonzero(met), before[met]
    else:
        rank = gallop(b, a, starts_b)
        same = a[rank] == b
        at_a, at_b = rank[same], np.flatnonzero(same)
        # B ends below an A end are those with no more A ends up to them than lie before it
        before = np.cumsum(np.bincount(rank + same, minlength=len(a) + 1))[: len(a)]
        met = np.zeros(len(a), bool)
        met[at_a] = True
    first = np.concatenate([[0], (before + met)[:-1]])
    return at_a, at_b, first, before


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the units aligned so far, numbered in order; one for each Python worker."""

    _here: tuple[tuple[str, str], Aligner] | None = None

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if cls._here is None or cls._here[0] != (path_a, path_b):
            cls._here = (path_a, path_b), cls(path_a, path_b)
        return cls._here[1]

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        normal = [p for i, p in enumerate(pieces) if len(p) > 1 and not self.b.is_byte(i) and not self.b.is_control(i)]
        self.before = self.b.encode("\n")
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p in normal) and self.b.encode("\na")[: len(self.before)] == self.before
        self.width_a, self.width_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.name = [str(i) for i in range(max(len(self.bytes_a), self.size_b))]
        self.clear()

    def clear(self) -> None:
        self.at, self.held = _Numbers(), 0
        self.n_a, self.n_b, self.n_groups, self.ok = array("i"), array("i"), array("i"), array("b")
        self.text: list[str] = []
        self.codes, self.ends = array("q"), array("q", [0])

    def units(self, text: str) -> list[str]:
        return UNITS.findall(" " + text) if self.cuts else [" " + text]

    def _encode(self, strings: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """(A ids, B ids) of strings that begin where units begin; None where the tokens joined are not the string."""
        ids_a = [e.ids for e in self.a.encode_batch(strings, add_special_tokens=False)]
        if self.cuts:
            skip = len(self.before)
            ids_b = [x[skip:] for x in self.b.encode(["\n" + s for s in strings], num_threads=1)]
        else:
            ids_b = self.b.encode([s[1:] for s in strings], num_threads=1)
        out = []
        for s, a, b in zip(strings, ids_a, ids_b, strict=True):
            whole = s.encode()
            ok = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a, b) if ok else None)
        return out

    def _tokens(self, units: list[str]) -> list[tuple[list[str], list[int], list[int]] | None]:
        """(units, A ids, B ids) in the units' order, None for a unit that has no tokens. Plain words are encoded joined, as a text would have them."""
        runs: list[list[str]] = []
        grows = False
        for u in units:
            plain = self.cuts and u[0] == " " and u[1:].split() == [u[1:]]
            if plain and grows and len(runs[-1]) < JOINED:
                runs[-1].append(u)
            else:
                runs.append([u])
            grows = plain
        out = []
        for run, found in zip(runs, self._encode(["".join(r) for r in runs]), strict=True):
            if found or len(run) == 1:
                out.append(found and (run, *found))
            else:
                out += [f and ([u], *f) for u, f in zip(run, self._encode(run), strict=True)]
        return out

    def learn(self) -> None:
        """Aligns the units that were numbered since the last call."""
        new, self.at.new = self.at.new, []
        if not new:
            return
        self.held += sum(len(u.encode()) for u in new)
        found = self._tokens(new)
        good = [f for f in found if f]
        ok = np.fromiter((bool(f) for f in found for _ in (f[0] if f else (0,))), bool, len(new))
        flat_a, flat_b = (np.array([i for f in good for i in f[k]], np.int64) for k in (1, 2))
        ends_a, ends_b = (np.cumsum(width[flat]) for width, flat in ((self.width_a, flat_a), (self.width_b, flat_b)))
        unit_ends = np.cumsum([len(u.encode()) for f in good for u in f[0]]).astype(np.int64)
        last_a, last_b = np.searchsorted(ends_a, unit_ends), np.searchsorted(ends_b, unit_ends)
        if not (np.array_equal(ends_a[last_a], unit_ends) and np.array_equal(ends_b[last_b], unit_ends)):
            raise RuntimeError("a token goes across the end of a unit")
        n_a, n_b = (np.diff(last, prepend=-1) for last in (last_a, last_b))
        begin_a, begin_b = last_a - n_a + 1, last_b - n_b + 1
        at_a, at_b, first, last = intersect(ends_a, ends_b, np.repeat(begin_b, n_a), np.repeat(begin_a, n_b)) if len(good) else [np.empty(0, np.int64)] * 4
        width = last - first + 1
        link_b = flat_b[np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())]
        codes = np.repeat(flat_a, width) * self.size_b + link_b
        links_of = np.add.reduceat(width, begin_a) if len(good) else width
        groups_of = np.diff(np.searchsorted(at_a, last_a, side="right"), prepend=0)
        texts = self._group_texts(flat_a.tolist(), flat_b.tolist(), at_a.tolist(), at_b.tolist())
        text_ends = np.cumsum(groups_of)
        joined = iter([";".join(texts[i:j]) for i, j in zip((text_ends - groups_of).tolist(), text_ends.tolist(), strict=True)])
        self.text += [next(joined) if k else "" for k in ok.tolist()]

        def spread(values: np.ndarray) -> np.ndarray:  # 0 for units without tokens
            out = np.zeros(len(new), np.int32)
            out[ok] = values
            return out

        self.n_a.frombytes(spread(n_a).tobytes())
        self.n_b.frombytes(spread(n_b).tobytes())
        self.n_groups.frombytes(spread(groups_of).tobytes())
        self.ok.frombytes(ok.astype(np.int8).tobytes())
        self.ends.frombytes((len(self.codes) + np.cumsum(spread(links_of), dtype=np.int64)).tobytes())
        self.codes.frombytes(codes.astype(np.int64).tobytes())

    def _group_texts(self, a: list[int], b: list[int], at_a: list[int], at_b: list[int]) -> list[str]:
        out, i, j, name = [], 0, 0, self.name
        for p, q in zip(at_a, at_b, strict=True):
            p, q = p + 1, q + 1
            if p == i + 1 and q == j + 1:
                out.append(name[a[i]] + "|" + name[b[j]])
            else:
                out.append(",".join(map(name.__getitem__, a[i:p])) + "|" + ",".join(map(name.__getitem__, b[j:q])))
            i, j = p, q
        return out


class _Numbers(dict):
    """unit -> its number; a new unit gets the next one and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class _Blocks:
    """Collects texts of a task into blocks."""

    def __init__(self, aligner: Aligner, id_type: pa.DataType):
        self.m, self.id_type = aligner, id_type
        self.next = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        self.start()

    def start(self) -> None:
        self.docs: list[tuple] = []
        self.held = 0

    def __call__(self, batch):
        gc.disable()  # nothing here is cyclic, and the collector would visit all cached units again and again
        try:
            return self.take(batch)
        finally:
            gc.enable()

    def take(self, batch):
        m, done = self.m, []
        for lo in range(0, batch.num_rows, 256):
            ids, texts = (batch.column(k).slice(lo, 256) for k in (0, 1))
            found = [np.array(list(map(m.at.__getitem__, m.units(t))) if t else [], np.int64) for t in texts.to_pylist()]
            m.learn()
            ok, n_a, n_b, n_g, ends = (np.frombuffer(x, x.typecode) for x in (m.ok, m.n_a, m.n_b, m.n_groups, m.ends))
            for own, at in zip(ids, found, strict=True):
                self.held += TEXT_UNITS
                if not len(at) or not ok[at].all():
                    self.docs.append((own, 0, 0, 0, 0, "", at[:0]))
                    continue
                text = ";".join(map(m.text.__getitem__, at.tolist()))
                self.docs.append((own, int(n_a[at].sum()), int(n_b[at].sum()), int(n_g[at].sum()), int((ends[at + 1] - ends[at]).sum()), hashlib.sha256(text.encode()).hexdigest(), at))
                self.held += len(at)
            del ok, n_a, n_b, n_g, ends  # arrays with views of them cannot grow
            full = len(m.at) > CACHE or m.held > CACHE_BYTES
            if self.held >= BLOCK_UNITS or full:
                done.append(self.block())
            if full:
                m.clear()
        return pa.concat_tables(done) if done else None

    def block(self) -> pa.Table:
        m = self.m
        at = np.concatenate([d[6] for d in self.docs]) if self.docs else np.empty(0, np.int64)
        count = np.bincount(at, minlength=len(m.at))
        own = np.argsort(-count, kind="stable")[: int((count > 0).sum())]  # commonest first: small numbers pack well
        place = np.zeros(len(count), np.int32)
        place[own] = np.arange(len(own))
        ends, codes = np.frombuffer(m.ends, "q"), np.frombuffer(m.codes, "q") if len(m.codes) else np.empty(0, np.int64)
        width = ends[own + 1] - ends[own]
        all_codes = codes[np.repeat(ends[own] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        pairs, links = np.unique(all_codes, return_inverse=True)
        counts = np.bincount(links, weights=np.repeat(count[own], width), minlength=len(pairs)).astype(np.int64)
        lists = [*([d[k] for d in self.docs] for k in range(1, 6)), [len(d[6]) for d in self.docs], place[at], width, links, pairs, counts]
        kinds = [*[pa.int64()] * 4, pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
        row = [pa.array([self.next], pa.int64()), _one(pa.array([d[0].as_py() for d in self.docs], self.id_type)), *(_one(pa.array(x, k)) for x, k in zip(lists, kinds, strict=True))]
        self.next += 1
        self.start()
        return pa.Table.from_arrays(row, names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "sizes", "units", "widths", "links", "pairs", "counts"])

    def finish(self):
        if self.docs:
            yield self.block()


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _weigh(hot):
    """block -> its texts, with sums over links of broadcast pairs and (pair, links) of the others."""
    codes, counts, best = hot.value
    Aligner._here = None  # a worker that is used again need not keep its units

    def of_block(row):
        col = lambda k: row.column(k).flatten().to_numpy(zero_copy_only=False)
        sizes, units, widths, links, pairs = (col(k).astype(np.int64) for k in range(7, 12))
        place = np.searchsorted(codes, pairs)
        place[place == len(codes)] = 0
        is_hot = codes[place] == pairs if len(codes) else np.zeros(len(pairs), bool)
        value, is_best = np.where(is_hot, counts[place], 0) if len(codes) else np.zeros(len(pairs), np.int64), is_hot & best[place] if len(codes) else is_hot
        sum_of, best_of = (_sums(_sums(v[links].astype(np.int64), widths)[units], sizes) for v in (value, is_best))
        # links of rare pairs: unit by unit, then added up by text and pair
        rare = ~is_hot[links]
        n_rare = _sums(rare.astype(np.int64), widths)
        rare_links, first = links[rare], np.cumsum(n_rare) - n_rare
        doc = np.repeat(np.arange(len(sizes)), sizes)
        some = np.flatnonzero(n_rare[units])
        n = n_rare[units[some]]
        which = rare_links[np.repeat(first[units[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key, times = np.unique(np.repeat(doc[some], n) * max(1, len(pairs)) + which, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, len(pairs)), minlength=len(sizes)))]).astype(np.int32)
        listed = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v, pa.int64()))
        flat = [row.column(k).flatten() for k in range(1, 7)]
        block = pa.array(np.full(len(sizes), row.column(0)[0].as_py()))
        return pa.Table.from_arrays(
            [block, pa.array(np.arange(len(sizes), dtype=np.int32)), *flat, pa.array(best_of), pa.array(sum_of), listed(pairs[key % max(1, len(pairs))]), listed(times)],
            names=["block", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare", "times"])

    def f(batch):
        return pa.concat_tables([of_block(batch.slice(i, 1)) for i in range(batch.num_rows)])

    return f


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of ``docs``. Paths: files
    that the driver and every executor have (the installed tokenizers)."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()

    def make():
        def first(batch):
            if not made:
                made.append(_Blocks(Aligner.of(path_a, path_b), batch.schema.field(0).type))
            return made[0](batch)

        made: list[_Blocks] = []
        first.finish = lambda: made[0].finish() if made else ()
        return first

    blocks = stored(map_rows(d, make, BLOCK.format(kind)), "blocks", **LARGE_ROWS)
    size_b = len_b(path_b)
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    # a B id meets each A id once at most, so a group has no more rows than A's vocabulary
    top = F.max("n").over(Window.partitionBy(F.col("pair") % size_b))
    table = stored(each.withColumn("best", F.col("n") == top), "pairs")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = table.filter(F.col("n") > total // HOT_PAIRS).orderBy("pair").toArrow()  # fewer than HOT_PAIRS rows can have more than this share
    shared = spark.sparkContext.broadcast([hot[c].to_numpy() for c in ("pair", "n", "best")])
    schema = f"block long, place int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, times array<long>"
    with rows_per_batch(spark, 1):  # a row is a block
        half = stored(map_rows(blocks, lambda: _weigh(shared), schema), "weighed")
    rare = half.select("block", "place", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("block", "place", F.col("r.rare").alias("pair"), F.col("r.times").alias("times"))
    rest = rare.join(table, "pair").groupBy("block", "place").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = half.drop("rare", "times").join(rest, ["block", "place"], "left")
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    with rows_per_batch(spark, TEXT_ROWS):
        out = stored(out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256"), "aligned")
    for t in (blocks, table, half):
        drop_stored(t)
    return out


def len_b(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
