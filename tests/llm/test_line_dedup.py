"""Operator 13 against a plain Python version and its SQL."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from aerosieve.llm import line_dedup

DOCS = "doc_id long, text string, k1 int, pos string, drop boolean"


def plain(rows, min_docs, min_chars):
    """(kept text, lines, dropped) of each row, in order."""
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    seen = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add((i, t or ""))
    out = []
    for _, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= max(1, min_chars) and len(seen[key(x)]) >= min_docs)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(spark, rows, **args):
    df = spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows], DOCS)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df, **args).collect()), key=repr)


@pytest.mark.parametrize("hot", [2, 4_096])
def test_lines_against_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    rng = random.Random(hot)
    pool = ["Menu", " menu\t", "MENU\r", "Ärger", "ärger", " menu", "", "  ", "x", "a long line of text", "\x0bmenu\x0c", "İ", "i"]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {rng.random()}"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(None, "menu"), (None, None), (70, None), (70, ""), (71, "\n"), (72, "menu\n" * 20_000 + "end"), (73, "x\n\nmenu"), (73, "x\n\nmenu"), (73, "menu"), (74, "menu\n")]
    for least, chars in ((10, 1), (3, 2), (1, 1)):
        want = sorted(((i, *w) for (i, _), w in zip(rows, plain(rows, least, chars))), key=repr)
        assert run(spark, rows, min_docs=least, min_chars=chars) == want


def test_equal_rows_are_one_document(spark):
    rows = [(1, "same\nown")] * 9 + [(2, "same"), (2, "same\n")]
    assert [r[3] for r in run(spark, rows, min_docs=4)] == [0] * 11
    assert sum(r[3] for r in run(spark, rows, min_docs=3)) == 11


def test_no_rows_and_no_python(spark):
    df = spark.createDataFrame([], DOCS)
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"] and out.count() == 0
    plan = line_dedup.line_keys(df.select(F.lit(1).alias("d1"), F.lit(2).alias("d2"), "text"), 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
