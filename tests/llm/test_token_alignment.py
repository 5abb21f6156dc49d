"""Operator 11 against whole-text tokenization and a scan over all pairs of tokens."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerosieve.llm import queries, token_alignment as ta

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    return ta.Aligner(A, B)


def tokens(m, text):
    """(ids, ends) of A and B for a whole text, or None."""
    if not text:
        return None
    a, b = m.a.encode(" " + text, add_special_tokens=False).ids, m.b.encode(text)
    out = []
    for ids, table in ((a, m.bytes_a), (b, m.bytes_b)):
        parts = [table[i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        at, ends = 0, []
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def brute(m, texts):
    rows, count = [], collections.Counter()
    for t in texts:
        found = tokens(m, t)
        if not found:
            rows.append(None)
            continue
        (a, ea), (b, eb) = found
        links, j = [], 0
        for i in range(len(a)):
            s, e = ea[i - 1] if i else 0, ea[i]
            while j and (eb[j - 1] if j else 0) > s:
                j -= 1
            while eb[j] <= s:
                j += 1
            k = j
            while k < len(b) and (eb[k - 1] if k else 0) < e:
                links.append((a[i], b[k]))
                k += 1
        cut = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for c in cut:
            p, q = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_best = sum(count[x] == best[x[1]] for x in r[3])
            out.append((r[0], r[1], len(r[2]), len(r[3]), n_best, sum(count[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()))
    return out


def odd_text(rng):
    return "".join(rng.choice([" ", " ", "\n", "\t", "\r", " ", "　", "\x1c", "᠎", "​", "é", "é", "🙂", "中", "don't", "<|endoftext|>", "<s>", "<0x41>", "foo", "Bar12", "...", ";\r", "▁", "aa", "\x00"][: rng.choice([3, 8, 25])]) for _ in range(rng.randrange(0, 30)))


def test_intersection_property():
    """Random ends of several units in a row, each list driving in turn."""
    rng = random.Random(2)
    for _ in range(800):
        ends, units, at = ([], []), ([], []), 0
        for u in range(rng.randrange(1, 6)):
            size = rng.randrange(1, 40)
            for k in (0, 1):
                own = sorted({*rng.sample(range(1, size + 1), rng.randrange(0, rng.choice([2, size]) )), size})
                units[k].append((len(ends[k]), len(own)))
                ends[k].extend(at + x for x in own)
            at += size
        a, b = (np.array(x) for x in ends)
        start = [np.concatenate([[other[0]] * own[1] for own, other in zip(units[k], units[1 - k])]).astype(np.int64) for k in (0, 1)]
        at_a, at_b, first, last = ta.intersect(a, b, *start)
        both = sorted(set(ends[0]) & set(ends[1]))
        assert [ends[0].index(x) for x in both] == at_a.tolist() and [ends[1].index(x) for x in both] == at_b.tolist()
        for i, e in enumerate(ends[0]):
            s = ends[0][i - 1] if i else 0
            over = [j for j, f in enumerate(ends[1]) if f > s and (ends[1][j - 1] if j else 0) < e]
            assert over == list(range(first[i], last[i] + 1))
        assert ta.gallop(a, b, np.zeros(len(a), np.int64)).tolist() == [sum(y < x for y in ends[1]) for x in ends[0]]


def test_units_change_no_token(libraries):
    m, rng = libraries, random.Random(7)
    assert m.cuts
    for _ in range(4000):
        t = odd_text(rng)
        units = m.units(t)
        assert "".join(units) == " " + t
        if not t:
            continue
        whole = tokens(m, t)
        if whole is None:
            continue
        skip = len(m.before)
        assert [i for u in units for i in m.a.encode(u, add_special_tokens=False).ids] == whole[0][0], repr(t)
        assert [i for u in units for i in m.b.encode("\n" + u)[skip:]] == whole[1][0], repr(t)


def run(spark, rows, schema="doc_id long, text string, id int, block string, pair int"):
    return ta.align_tokens(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], schema), A, B)


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [1 << 20, 20])
def test_alignment_against_all_pairs(spark, libraries, hot, monkeypatch):
    monkeypatch.setattr(ta, "HOT_PAIRS", hot)
    rng = random.Random(3)
    rows = [(i, odd_text(rng)) for i in range(120)]
    rows += [(900, None), (901, ""), (902, " "), (903, "  \n "), (904, "word " * 30_000), (905, "x" * 5_000), (906, "a▁b"), (None, "null id"), (None, None), (907, "same row"), (907, "same row"), (907, "other row")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = ta.align_tokens(df, A, B).collect()
    want = brute(libraries, [t for _, t in rows])
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLS)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_small_blocks_and_cache(libraries, monkeypatch):
    """Blocks and cache may end anywhere: the same texts' figures come out."""
    import pyarrow as pa

    monkeypatch.setattr(ta, "CACHE", 40)
    monkeypatch.setattr(ta, "BLOCK_UNITS", 60)
    rng = random.Random(5)
    texts = [odd_text(rng) for _ in range(1500)]
    m = ta.Aligner(A, B)
    work = ta._Blocks(m, pa.int64())
    blocks = []
    for lo in range(0, len(texts), 500):
        out = work(pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 500)), pa.array(texts[lo : lo + 500])], ["id", "text"]))
        blocks += [out.slice(i, 1) for i in range(out.num_rows)] if out is not None else []
    blocks += list(work.finish())
    assert len(blocks) > 3 and len({b["block"][0].as_py() for b in blocks}) == len(blocks)
    got = [(i, n, s) for b in blocks for i, n, s in zip(b["ids"][0].as_py(), b["n_links"][0].as_py(), b["sha"][0].as_py())]
    want = brute(libraries, texts)
    assert got == [(i, w[3], w[6]) for i, w in enumerate(want)]
    assert sum(sum(b["counts"][0].as_py()) for b in blocks) == sum(w[3] for w in want)


def test_no_rows(spark):
    out = run(spark, [])
    assert out.columns == ["doc_id", *COLS] and out.count() == 0


def test_query_on_the_given_table(spark, libraries):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute(libraries, [t for _, t in rows]))}


def test_texts_without_tokens_fill_blocks(libraries, monkeypatch):
    """Null, empty and short texts used to wait in one block for units of others, however many there were."""
    import pyarrow as pa

    monkeypatch.setattr(ta, "BLOCK_UNITS", 2_000)
    work = ta._Blocks(ta.Aligner(A, B), pa.int64())
    texts = [None, "", "a▁b", "ab"] * 256
    out = work(pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array(texts)], ["id", "text"]))
    blocks = [out.slice(i, 1) for i in range(out.num_rows)] + list(work.finish())
    assert [i for b in blocks for i in b["ids"][0].as_py()] == list(range(1024)) and max(len(b["ids"][0]) for b in blocks) <= 256


def test_cache_is_bounded_in_bytes(monkeypatch):
    """Few units, each of a whole text without spaces, used to stay in the cache up to their number."""
    import pyarrow as pa

    monkeypatch.setattr(ta, "CACHE_BYTES", 100_000)
    m = ta.Aligner(A, B)
    work = ta._Blocks(m, pa.int64())
    for lo in range(0, 1024, 256):
        work(pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array([f"{lo + i}" + "語" * 300 for i in range(256)])], ["id", "text"]))
        assert m.held <= 100_000 and len(m.at) <= 256


def test_rows_of_some_mb_are_written_and_read_few_at_a_time(spark, tmp_path):
    """A row group used to hold 100 rows at least, and the reader decoded all of them at once: an executor of 10 GB ran out of memory on blocks of 0.5 GB of texts."""
    import pyarrow.parquet as pq

    from aerosieve.llm import common

    rows = spark.range(0, 60, 1, 1).select("id", F.expr("transform(sequence(1, 131072), x -> xxhash64(x, id))").alias("v"))
    t = common.stored(rows, "large", **common.LARGE_ROWS)
    meta = pq.ParquetFile(t.inputFiles()[0].removeprefix("file://")).metadata
    assert meta.num_rows == 60 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 20

    def read_at_once():
        q = t.select("id", F.size("v"))._jdf.queryExecution()
        q.toRdd().count()
        node = q.executedPlan()
        while node.nodeName() != "ColumnarToRow":
            node = node.children().head()
        return 60 / node.metrics().apply("numInputBatches").value()

    assert read_at_once() > 1
    with common.rows_per_batch(spark, 1):
        assert read_at_once() == 1
    assert read_at_once() > 1
    common.drop_stored(t)
