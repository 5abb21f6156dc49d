"""Kneser-Ney probabilities against plain counting, and the pipeline's stages on odd tables."""

import collections
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from aerosieve.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_ratio(rows, words):
    """log p(word | before, toxic) - log p(word | before, ordinary) at each word, by dictionaries instead of hashed tables."""
    seen = [collections.Counter(), collections.Counter()]
    for text, y in rows:
        w = ["<s>", *text.lower().split()]
        seen[y].update(set(zip(w, w[1:])))  # a text counts a bigram once
    d2, d1, d0, v = toxicity.BIGRAM_DISCOUNT, toxicity.WORD_DISCOUNT, toxicity.SHARED_DISCOUNT, 1 << toxicity.WORD_BITS
    after = [collections.Counter(w for _, w in seen[y]) for y in (0, 1)]
    shared = after[0] + after[1]
    all_shared = max(1, sum(shared.values()))

    def base(w):
        return max(shared[w] - d0, 0) / all_shared + d0 * len(shared) / all_shared / v + 1e-9

    def p(h, w, y):
        total = max(1, sum(after[y].values()))
        rest = sum(min(n, d1) for n in after[y].values()) / total if after[y] else 1.0
        word = max(after[y][w] - d1, 0) / total + rest * base(w)
        held = {b: n for b, n in seen[y].items() if b[0] == h}
        n = sum(held.values())
        left = sum(min(k, d2) for k in held.values()) / n if n else 1.0
        return max(seen[y][h, w] - d2, 0) / max(1, n) + left * word

    at = ["<s>", *words]
    return [math.log(p(h, w, 1) / p(h, w, 0)) for h, w in zip(at, words)]


def test_kneser_ney_against_plain_counts(spark):
    rng = random.Random(6)
    pool = ["nice", "day", "you", "are", "bad", "awful", "the", "sun", "go", "away"]
    rows = [(" ".join(rng.choice(pool[: 8 if y else 6] if rng.random() < 0.7 else pool) for _ in range(rng.randrange(1, 25))), y) for y in (0, 1) for _ in range(60)]
    rows += [("Nice day", 0), ("nice DAY", 0)]
    m = toxicity.ClassModels.fit(spark.createDataFrame(rows, "text string, toxic int"))
    hasher = toxicity.WordHasher()
    for text in ["you are bad", "the sun", "unseen words go away", "nice nice day day", "awful", *(t for t, _ in rows[::15])]:
        got = m.ratios(hasher.hashes(toxicity.words(text)))
        assert np.allclose(got, brute_ratio(rows, text.lower().split()), rtol=1e-4, atol=1e-5), text


@pytest.fixture
def folder(tmp_path):
    """Tables of sf0.001 in which rows are odd."""
    def make(where="true"):
        d = tmp_path / where.replace(" ", "")
        d.mkdir()
        for t in ("documents", "labels"):
            duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/{t}.parquet' where {where}) to '{d}/{t}.parquet'")
        return str(d)

    return make


ODD = [(None, "null id", "en", "s", 1), (None, None, None, None, None), (900_001, None, "en", None, 0), (900_002, "", None, "s", 0), (900_003, " \n ", "en", "s", 3),
       (900_004, "same text of two rows", "en", "s", 5), (900_004, "same text of two rows", "en", "s", 5), (900_005, "long " * 60_000, "en", "s", 300_000)]


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_stage_with_odd_rows(spark, folder, stage):
    where = folder()
    docs = spark.read.parquet(f"{where}/documents.parquet")
    odd = spark.createDataFrame(ODD, DOCS)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    for c in ("score", "predicted", "weight", "key", "log_weight", "kept", "component_id", "id", "row", "count", "toxic", "quality", "mark"):
        both = both.withColumn(c, F.lit("x"))  # names that the operators use themselves
    out = cp.STAGES[stage][1](spark, both, where)
    assert out.columns == both.columns
    got = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
    clean = {r[0] for r in cp.STAGES[stage][1](spark, docs, where).select("doc_id").collect()}
    if stage == 0:  # no evidence against any odd row; the fit does not see them
        assert got == collections.Counter([*clean, *(r[0] for r in ODD)])
    elif stage == 1:  # how many are drawn is the share of good labels
        assert sum(got.values()) == round(len(clean) / docs.count() * both.count()) or abs(sum(got.values()) - len(clean) / docs.count() * both.count()) <= 1
        assert got[900_004] in (0, 2)
    else:
        assert got == collections.Counter([*clean, None, None, *(r[0] for r in ODD if r[0] and r[0] != 900_004), 900_004])
    assert not set(got) - {*(r[0] for r in docs.select("doc_id").collect()), *(r[0] for r in ODD)}


def test_pipeline_without_rows_and_without_labels(spark, folder):
    empty = folder("doc_id < 0")
    out = cp.run(spark, empty)
    assert out.count() == 0 and {"doc_id", "bin_id"} <= set(out.columns)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in cp.STAGES[:2]:  # no labels: both filters keep everything
        assert stage(spark, docs, empty).count() == docs.count()


def test_scratch_is_cleared(spark, tmp_path):
    from aerosieve.llm import common

    common.clear_scratch(spark)
    one, two = common.stored(spark.range(5), "one"), common.stored(spark.range(7), "two")
    paths = [f.rsplit("/", 1)[0].removeprefix("file://") for t in (one, two) for f in t.inputFiles()[:1]]
    common.drop_stored(one)
    assert not os.path.exists(paths[0]) and two.count() == 7 and len(common._MADE) == 1
    common.clear_scratch(spark)
    assert not os.path.exists(paths[1]) and not common._MADE


def test_user_defined_pieces_raise(tmp_path):
    from aerosieve.llm import sentencepiece_unigram

    def field(number, kind, data):
        return bytes([number << 3 | kind]) + (bytes([len(data)]) + data if kind == 2 else data)

    piece = lambda text, kind: field(1, 2, field(1, 2, text) + field(2, 5, b"\0\0\0\0") + field(3, 0, bytes([kind])))
    rules = field(3, 2, field(4, 0, b"\0") + field(5, 0, b"\1"))
    for kind in (1, 4):
        (tmp_path / "m").write_bytes(piece(b"<unk>", 2) + piece(b"ab", kind) + rules)
        if kind == 4:
            with pytest.raises(ValueError, match="user-defined"):
                sentencepiece_unigram.Pieces.load(str(tmp_path / "m"))
        else:
            assert sentencepiece_unigram.Pieces.load(str(tmp_path / "m")).unknown == 0


def test_token_store_with_repeated_and_null_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from aerosieve.llm import queries, token_blocks

    path = queries.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(5, "one text"), (5, "one text"), (5, "another"), (None, "no id"), (None, None), (2**53 + 1, "large"), (-3, "below zero")] + [(7, "equal rows")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(5)
    token_blocks.write_tokens(df, str(tmp_path / "t"), path, end_id=0)
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in token_blocks.read_tokens(spark, str(tmp_path / "t")).collect()) == want
    at = 0
    index = token_blocks.token_index(spark, str(tmp_path / "t")).collect()
    for r in sorted(index, key=lambda r: r["start"]):  # each starts where the one before ends
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(index, key=lambda r: r["start"])]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:]) and at == sum(len(k[1]) * n for k, n in want.items())
