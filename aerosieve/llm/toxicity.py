"""Operator 10: class-conditional Kneser-Ney models of toxic and ordinary text.

Both classes have an interpolated Kneser-Ney bigram model over lower-cased words. Bigrams back
off to the class's continuation counts, those to continuation counts shared by both classes,
and those to a uniform share: words that are rare in both classes get nearly the same
probability from either. The n-gram counts are gathered by Spark from the labelled
rows and kept in hashed tables of fixed size (2**WORD_BITS and 2**BIGRAM_BITS entries).

A text's evidence is the difference of its two log-likelihoods per word: over the whole
text, and over its best windows of several lengths, so that a long text does not dilute
an insult. A logistic curve, fitted on labelled rows kept out of the counts, turns
these into a score from 0 to 1. Each class weighs in the fit as much as it has labelled rows,
taken or not, so the curve has the table's class rate at every size.

Fitting takes at most MAX_ROWS labelled rows a class, chosen by hash of the id (a fitting bound,
not a scoring one). Every text is scored, whole. Null and empty texts have no evidence and get the
curve's value at zero. With no labelled rows of either class all scores are 0. Exact copies among the labelled rows count once in the
fit (that of the smallest mark and id), repeated rows are all scored alike, an empty table gives an empty one. Where bigrams
share a bucket, all but the commonest back off: the more, the more different bigrams the labelled rows (bounded by MAX_ROWS) have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, drop_stored, label_counts, label_sample, map_rows, mix, stored

WORD_BITS, BIGRAM_BITS = 20, 21
SLICES = 8
#: Bytes of text that a task works on at a time.
BATCH = 4 << 20
CACHE = 60_000
MAX_ROWS = 30_000
MAX_CALIBRATION = 20_000
#: Absolute discounts. What a class has seen a few times says little, so those counts go to the shared backoff.
BIGRAM_DISCOUNT, WORD_DISCOUNT, SHARED_DISCOUNT = 2.0, 3.0, 0.75
WINDOWS = (1, 4, 16, 64)
TOPS = (2, 4)
N_EVIDENCE = 1 + len(WINDOWS) + len(TOPS) + 1
EVIDENCE, SCORE = "_evidence_", "_score_"  # names that don't clash with kept columns
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode("utf-8", "replace"))


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History bucket, word bucket and bigram hash at each word; the first word follows a start mark."""
    before = np.concatenate([np.array([7], np.uint64), h[:-1]])
    both = mix(before * np.uint64(0x9E3779B97F4A7C15) + h)
    down = np.uint64(64 - WORD_BITS)
    return (before >> down).astype(np.int32), (h >> down).astype(np.int32), both


def count_bigrams(rows: DataFrame) -> DataFrame:
    """(toxic, bigram, h, w, n) over rows (text, toxic)."""

    def make():
        hasher = WordHasher(CACHE)

        def f(batch):
            out = []
            label = batch.column(1).to_numpy(zero_copy_only=False)
            bags: dict[int, list] = {0: [], 1: []}
            for t, y in zip(batch.column(0).to_pylist(), label, strict=True):
                w = words(t)
                if w:
                    h, w, b = _grams(hasher.hashes(w))
                    b, at = np.unique(b, return_index=True)  # a text counts a bigram once
                    bags[int(y)].append((h[at], w[at], b))
            hasher.trim()
            for y, bag in bags.items():
                if bag:
                    h, w, b = (np.concatenate(x) for x in zip(*bag, strict=True))
                    b, at, n = np.unique(b, return_index=True, return_counts=True)
                    out.append(pa.table({"toxic": pa.array(np.full(len(b), y, np.int8)), "bigram": pa.array(b.view(np.int64)), "h": pa.array(h[at]), "w": pa.array(w[at]), "n": pa.array(n)}))
            return pa.concat_tables(out) if out else None

        return f

    parts = map_rows(rows.select("text", F.col("toxic").cast("int")), make, "toxic byte, bigram long, h int, w int, n long", max_bytes=BATCH)
    return parts.groupBy("toxic", "bigram").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.sum("n").alias("n"))


@dataclass
class ClassModels:
    """Counts and probabilities by bucket, first axis the class (0 ordinary, 1 toxic). A bigram bucket keeps
    its commonest bigram and that one's hash, so others in the bucket back off."""

    word: np.ndarray
    left: np.ndarray
    scale: np.ndarray
    bigram: np.ndarray
    owner: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame) -> ClassModels:
        counts = stored(count_bigrams(rows), "bigrams")
        v, b = 1 << WORD_BITS, 1 << BIGRAM_BITS
        slot = F.shiftrightunsigned("bigram", 64 - BIGRAM_BITS)
        # three tables with at most 2 * 2**bits rows each, whatever was counted
        kept = F.struct((F.col("n") - BIGRAM_DISCOUNT).alias("x"), F.col("bigram"))
        big = counts.filter(F.col("n") > BIGRAM_DISCOUNT).groupBy("toxic", slot.cast("int").alias("k")).agg(F.max(kept).alias("m")).select("toxic", "k", "m.x", "m.bigram")
        hist = counts.groupBy("toxic", F.col("h").alias("k")).agg(F.sum("n").alias("n"), F.sum(F.least(F.col("n"), F.lit(BIGRAM_DISCOUNT))).alias("d"))
        cont = counts.groupBy("toxic", F.col("w").alias("k")).agg(F.count("*").alias("d"))

        def gathered(df: DataFrame, size: int, **columns) -> list[np.ndarray]:
            """Tables of (class, bucket) from rows (toxic, k, columns), fetched slice by slice."""
            out = {c: np.zeros((2, size), t) for c, t in columns.items()}
            df = stored(df, "counts")
            for i in range(0, size, size // SLICES):
                t = df.filter((F.col("k") >= i) & (F.col("k") < i + size // SLICES)).toArrow()
                for c in columns:
                    out[c][t["toxic"].to_numpy(), t["k"].to_numpy()] = t[c].to_numpy()
            drop_stored(df)
            return list(out.values())

        # 32 further bits of the hash tell a bucket's bigram from others
        bigram, owner = gathered(big.withColumn("bigram", F.col("bigram").bitwiseAND(0xFFFFFFFF)), b, x=np.float32, bigram=np.uint32)
        n, held = gathered(hist, v, n=np.float64, d=np.float64)
        (after,) = gathered(cont, v, d=np.float64)
        drop_stored(counts)
        shared = after.sum(axis=0)
        seen = max(1.0, shared.sum())
        base = np.maximum(shared - SHARED_DISCOUNT, 0) / seen + SHARED_DISCOUNT * (shared > 0).sum() / seen / v + 1e-9
        word = np.empty((2, v))
        for c in (0, 1):
            total = max(1.0, after[c].sum())
            rest = np.minimum(after[c], WORD_DISCOUNT).sum() / total if after[c].any() else 1.0
            word[c] = np.maximum(after[c] - WORD_DISCOUNT, 0) / total + rest * base
        left = np.where(n > 0, held / np.maximum(n, 1), 1.0)
        return cls(word.astype(np.float32), left.astype(np.float32), (1 / np.maximum(n, 1)).astype(np.float32), bigram, owner)

    def ratios(self, h: np.ndarray) -> np.ndarray:
        """log p(word | before, toxic) - log p(word | before, ordinary) at each word."""
        before, word, both = _grams(h)
        k = (both >> np.uint64(64 - BIGRAM_BITS)).astype(np.int64)
        tag = both.astype(np.uint32)
        own = [self.owner[c][k] == tag for c in (0, 1)]
        p = [own[c] * self.bigram[c][k] * self.scale[c][before] + self.left[c][before] * self.word[c][word] for c in (0, 1)]
        return np.log(p[1] / p[0])


def evidence(r: np.ndarray) -> list[float]:
    """Mean ratio of the text; best mean in windows of each length; mean of the
    largest few ratios; log length."""
    if not len(r):
        return [0.0] * N_EVIDENCE
    c = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
    best = [float((c[w:] - c[:-w]).max() / w) if len(r) >= w else float(c[-1] / w) for w in WINDOWS]
    top = np.sort(np.partition(r, len(r) - TOPS[-1])[-TOPS[-1]:] if len(r) > TOPS[-1] else r)[::-1]
    return [float(c[-1] / len(r)), *best, *(float(np.maximum(top[:k], 0).sum() / k) for k in TOPS), float(np.log1p(len(r)))]


def fit_curve(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, halved until the loss falls, on standardised columns: (mean, spread, weights).
    ``share``: what each row counts for."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])

    def loss(w):
        m = z @ w
        return share @ (np.logaddexp(0, m) - y * m) + ridge * w @ w / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (share * (y - p)) - ridge * w)
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return mean, spread, w


def _evidence_rows(docs: DataFrame, models, keep: list[str]) -> DataFrame:
    names = [f"{EVIDENCE}{i}" for i in range(N_EVIDENCE)]
    # a text that is kept anyway goes to the task once
    at, kept = (keep.index("text"), docs.select(*keep)) if "text" in keep else (len(keep), docs.select(*keep, "text"))

    def make():
        hasher, m = WordHasher(CACHE), models.value

        def f(batch):
            rows = []
            for t in batch.column(at).to_pylist():
                w = words(t)
                rows.append(evidence(m.ratios(hasher.hashes(w)) if w else np.empty(0)))
            hasher.trim()
            x = np.array(rows, dtype=np.float64).reshape(len(rows), len(names))
            return pa.table([*(batch.column(i) for i in range(len(keep))), *(pa.array(x[:, i]) for i in range(len(names)))], names=[*keep, *names])

        return f

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]] + [f"{n} double" for n in names])
    return map_rows(kept, make, schema, max_bytes=BATCH)


def fit(docs: DataFrame, labels: DataFrame, counts: dict[int, int]) -> tuple:
    """docs: (doc_id, text); labels: (doc_id, toxic, mark) as :func:`label_sample` gives them; counts: labelled
    ids of each class, those left out of the sample included. Returns (models, curve), both None unless both classes have rows."""
    spark = docs.sparkSession
    # at most 2 * MAX_ROWS labels, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    # exact copies count once, as the row of smallest mark and id: the same in every run
    first = F.row_number().over(Window.partitionBy("toxic", F.xxhash64("text")).orderBy("mark", "doc_id", "text"))
    rows = stored(rows.withColumn("first", first).filter("first = 1").drop("first"), "labelled")
    if rows.select("toxic").distinct().count() < 2:
        return None, None
    spare = F.col("mark") % 3 == 0
    models = spark.sparkContext.broadcast(ClassModels.fit(rows.filter(~spare)))
    held = {r[0]: r[1] for r in rows.filter(spare).groupBy("toxic").count().collect()}
    one = [_evidence_rows(rows.filter(spare & (F.col("toxic") == k)), models, ["doc_id", "toxic", "mark"]).orderBy("mark", "doc_id").limit(MAX_CALIBRATION // 2) for k in (0, 1)]
    e = one[0].unionByName(one[1]).toPandas()
    drop_stored(rows)
    if len(e) < 2 or e["toxic"].nunique() < 2:
        return models, (np.zeros(N_EVIDENCE), np.ones(N_EVIDENCE), np.array([1.0, *[0.5] * (N_EVIDENCE - 2), 0.0, -2.0]))
    x = e[[f"{EVIDENCE}{i}" for i in range(N_EVIDENCE)]].to_numpy()
    y = e["toxic"].to_numpy(int)
    # rows of its class that a row stands for: labels past MAX_ROWS and spare rows past the limit
    stands = [counts[k] / min(counts[k], MAX_ROWS) * held[k] / (y == k).sum() for k in (0, 1)]
    share = np.where(y == 1, stands[1], stands[0])
    return models, fit_curve(x, y.astype(float), share * len(y) / share.sum())


def _scored(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and SCORE for every row of ``docs``."""
    models, curve = fit(train_docs, label_sample(labels, "toxic", MAX_ROWS), label_counts(labels, "toxic"))
    if models is None:
        return docs.select(*keep, F.lit(0.0).alias(SCORE))
    mean, spread, w = curve
    z = F.lit(float(w[-1]))
    for i in range(len(mean)):
        z = z + (F.col(f"{EVIDENCE}{i}") - float(mean[i])) * float(w[i] / spread[i])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    return _evidence_rows(docs, models, keep).select(*keep, score.alias(SCORE))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_docs: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id if not given; not score or predicted), score double, predicted int for every row of ``docs``, repeated and null ids included.
    ``labels`` (doc_id, toxic): held-out ids are left out here. ``train_docs``: texts of
    the labelled rows, ``docs`` itself if not given."""
    keep = keep or ["doc_id"]
    scored = _scored(docs, labels, docs if train_docs is None else train_docs, keep)
    return scored.select(*keep, F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under the threshold, all columns, whatever their names."""
    return _scored(docs, labels, docs, docs.columns).filter(F.col(SCORE) < threshold).select(docs.columns)
