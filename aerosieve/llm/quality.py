"""Operator 4: importance resampling with hashed n-gram models.

Two bag-of-n-gram models over BUCKETS hashed features: one of target text (rows labelled
good) and one of all raw text. A document's log weight is the sum over its n-grams of
log(p_target / p_raw), the log ratio of the two models for the whole text, divided by ``temperature`` (1: the models' own
ratio; larger ones let the draw stray further from it).
Documents are sampled without replacement by Gumbel top-k: the k largest of
log weight + Gumbel noise, noise from a hash of the id and the seed, so reruns agree. A document is thus drawn
with a probability in proportion to its weight among those not drawn yet.

k is ``fraction`` of the rows; if not given, the share of good rows among the labelled ones that are here.
The k-th key is found exactly by refined histograms, not by a global sort.

Raw counts cover every text, whole. Target counts take at most MAX_ROWS good rows, chosen by hash of the id. Null and empty texts have no n-grams and log weight
0. Rows with one id, or a null one, share one noise value; equal rows (id and text) are drawn together, so k can be passed by these.
Ties go to the smaller id. Columns named like those made here don't clash. An empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, label_sample, labelled, map_rows, mix, stored, texts

BUCKETS = 1 << 16
SLICES = 16
WEIGHT, KEY, LABEL, LABEL_ID = "_log_weight_", "_key_", "_good_", "_label_id_"  # names that don't clash with kept columns
MAX_ROWS = 30_000
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]")
_SAME = np.uint64(0x5A5A5A5A5A5A5A5A)


def features(text: bytes, hasher: WordHasher) -> np.ndarray:
    """Buckets of a text's words, marks and pairs; a repeated word counts as one fixed pair."""
    h = hasher.hashes(TOKEN.findall(text.lower()))
    if not len(h):
        return np.empty(0, np.int64)
    pair = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    return (np.concatenate([h, pair]) >> np.uint64(48)).astype(np.int64)


def _count(docs: DataFrame) -> np.ndarray:
    """Feature counts over (text, quality): row 0 of all texts, row 1 of those with quality 1. A table of fixed size."""

    def make():
        hasher, counts = WordHasher(), np.zeros((2, BUCKETS), np.int64)

        def f(batch):
            bags: tuple[list, list] = ([], [])
            for t, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                bags[y == 1].append(features(t, hasher))
            for k, bag in enumerate(bags):
                if bag:
                    counts[k] += np.bincount(np.concatenate(bag), minlength=BUCKETS)
            hasher.trim()

        def finish():
            parts = counts.reshape(2, SLICES, -1)
            yield pa.table({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([parts[:, i].tobytes() for i in range(SLICES)], pa.binary())})

        f.finish = finish
        return f

    def add(pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        pdf = pdf.iloc[:1].copy()
        pdf["counts"] = [total.tobytes()]
        return pdf

    rows = map_rows(docs, make, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    out = np.zeros((2, SLICES, BUCKETS // SLICES), np.int64)
    for r in rows:
        out[:, r["slice"]] = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    out = out.reshape(2, BUCKETS)
    return np.stack([out.sum(axis=0), out[1]])


def log_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    raw, target = counts
    share = raw + smooth
    share = share / share.sum()
    # target counts are smoothed towards the raw shares: unseen features then say little
    return np.log((target + smooth * BUCKETS * share) / (target.sum() + smooth * BUCKETS) / share).astype(np.float32)


def _weights(docs: DataFrame, ratio, keep: list[str], text_col: str, temperature: float) -> DataFrame:
    # a text that is kept anyway goes to the task once
    at, d = (keep.index(text_col), docs.select(*keep)) if text_col in keep else (len(keep), docs.select(*keep, text_col))

    def make():
        hasher, r = WordHasher(), ratio.value

        def f(batch):
            out = np.zeros(batch.num_rows)
            for i, t in enumerate(texts(batch.column(at))):
                k = features(t, hasher)
                if len(k):
                    out[i] = r[k].sum(dtype=np.float64) / temperature
            hasher.trim()
            return pa.table([*(batch.column(i) for i in range(len(keep))), pa.array(out)], names=[*keep, WEIGHT])

        return f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[: len(keep)]) + f", {WEIGHT} double"
    return map_rows(d, make, schema)


def top_k_key(keys: DataFrame, k: int, id_col: str, bins: int = 4096) -> tuple[float, int | None]:
    """Exact k-th largest ``key``: (key, id) such that the k rows are those above key, and those
    equal to it with an id up to the given one."""
    lo, hi, above = keys.agg(F.min("key"), F.max("key")).first()[:2] + (0,)
    for _ in range(40):
        width = (hi - lo) / bins
        if width <= 0:
            break
        b = F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)).cast("int")
        rows = sorted(keys.filter((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), reverse=True)
        for r in rows:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= 2_000:
            break
    rest = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi)).select("key", id_col)
    # at most 2,000 rows unless more share one key; then the smallest ids, by a bounded top-k
    last = rest.orderBy(F.desc("key"), F.asc_nulls_last(id_col)).limit(max(1, k - above)).orderBy("key", F.desc_nulls_first(id_col)).first()
    return last["key"], last[id_col]


def gumbel(id_col: Column, seed: Column) -> Column:
    """Standard Gumbel noise from a hash of the id and the seed."""
    return -F.log(-F.log((F.pmod(F.xxhash64(id_col, seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)))


def _keyed(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str, text_col: str, seed: int, temperature: float) -> DataFrame:
    """``keep`` with WEIGHT and KEY for every row, stored."""
    # at most 2 * MAX_ROWS labels, so the broadcast is bounded
    y = F.broadcast(label_sample(labels, "quality", MAX_ROWS).select(F.col("doc_id").alias(LABEL_ID), F.col("quality").alias(LABEL)))
    counts = _count(docs.join(y, docs[id_col] == y[LABEL_ID], "left").select(docs[text_col], LABEL))
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(counts))
    weighed = _weights(docs, ratio, keep, text_col, temperature)
    return stored(weighed.withColumn(KEY, F.col(WEIGHT) + gumbel(F.col(id_col), F.lit(seed))), "weights")


def good_share(ids: DataFrame, labels: DataFrame, id_col: str) -> float:
    """Share of good ones among the labelled ids (held-out ones left out) that are in ``ids``; 1 without any."""
    y = labelled(labels, "quality")
    return y.join(ids.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi").agg(F.coalesce(F.avg("quality"), F.lit(1.0))).first()[0]


def _drawn(keys: DataFrame, labels: DataFrame, id_col: str, fraction: float | None) -> Column:
    """Condition on (KEY, id_col) that holds for the k drawn rows."""
    k = round((good_share(keys, labels, id_col) if fraction is None else fraction) * keys.count())
    if k == 0:
        return F.lit(False)
    key, last = top_k_key(keys.select(F.col(KEY).alias("key"), id_col), k, id_col)
    tie = F.lit(True) if last is None else F.coalesce(F.col(id_col) <= F.lit(last), F.lit(False))
    return (F.col(KEY) > key) | ((F.col(KEY) == key) & tie)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float | None = None, seed: int = 4, temperature: float = 1.0) -> DataFrame:
    """(id_col, log_weight, key, kept) for every row of ``docs``.

    labels: (doc_id, quality 0/1); held-out ids are left out here. Without good rows the
    weights are 0; without a fraction and any labelled row everything is kept.
    """
    keys = _keyed(docs, labels, [id_col], id_col, text_col, seed, temperature)
    return keys.select(id_col, F.col(WEIGHT).alias("log_weight"), F.col(KEY).alias("key"), _drawn(keys, labels, id_col, fraction).alias("kept"))


def resample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float | None = None, seed: int = 4, temperature: float = 1.0) -> DataFrame:
    """The drawn rows of ``docs``, all columns. Rows are stored with their weights, so texts are neither shuffled nor weighed twice."""
    keys = _keyed(docs, labels, docs.columns, id_col, text_col, seed, temperature)
    return keys.filter(_drawn(keys, labels, id_col, fraction)).select(docs.columns)
