"""Operator 1: URL filter by logistic regression on hashed character n-grams.

Rules decide first: a rule is a host and a path start (``org/es/``); it fits its host and
all subdomains where the URL's path starts with its own, and the longest fitting rule wins. Where none fits, a
logistic regression on hashed character n-grams of host and path decides. It is trained
from a small labelled URL table of at most MAX_TRAIN rows; LABELLED_WORDS is one, written out by :func:`labelled_urls`.

Host and path are cut with SQL functions. A null URL, or one without ``://``, has both empty and so
only the model's bias as evidence. Without rows of both labels the model allows everything. Repeated rows are all judged,
very long URLs whole; an empty table gives an empty one, and other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, mix

BITS = 18
SIZES = (3, 4, 5)
MAX_TRAIN = 20_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


# Words of hosts that a crawl blocks (1) or allows (0).
LABELLED_WORDS = {
    1: ["adult", "adult-x", "xxx", "porn", "sex-cam", "escort", "casino", "casino-win", "online-casino", "poker", "slots", "jackpot", "free-bets", "bets", "betting", "sportsbook", "lottery-win", "cheap-pills", "pills", "viagra", "pharma-deal", "weight-loss-fast", "replica-watch", "spam", "spam-farm", "link-farm", "seo-links", "ads", "ads-track", "ad-server", "click-track", "popads", "tracker", "payday-loan", "fast-cash", "get-rich", "crypto-double", "warez", "crack-keygen", "free-download-full", "malware", "phish-login"],
    0: ["news", "daily-post", "university", "library", "museum", "school", "science", "physics-lab", "history", "garden", "recipes", "cooking", "travel", "weather", "city-council", "hospital", "health-info", "wiki", "docs", "manual", "python", "code", "forum", "journal", "review", "books", "poetry", "music", "film", "theatre", "sports-club", "football", "chess", "maps", "transport", "railway", "farm-shop", "village", "church", "charity", "research", "data", "statistics", "economy", "law", "parliament", "art", "design", "photo", "nature", "birds", "ocean", "mountain", "camera", "house", "family", "letters", "winter", "address", "trackside", "better", "alphabet"],
}
#: Syllables of invented host names, which are allowed: a name that says nothing is no reason to block.
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ch", "ung", "ment", "ci", "que"]
WHERE = ["", "www.", "blog.", "m."]
DOMAINS = ["com", "net", "org", "example.com", "example.net", "example.org", "de", "fr"]
PATHS = ["/", "/en/{}", "/de/{}.html", "/fr/{}/", "/index.html", "/a/{}?x=1", "/es/{}#top", ""]


#: What names are put together from besides the words, in both classes alike, so that it says nothing by itself.
COMPANIONS = ["hub", "shop", "online", "best", "free", "my", "the", "top", "world", "24", "club", "zone", "land", "store", "center", "live", "pro", "info", "portal", "city", "daily", "home", "now", "videos", "place", "group", "direct", "planet", "box", "today", "one", "area"]
#: Names made of a word of each class, and of an invented one.
FORMS, INVENTED_FORMS = {1: 36, 0: 16}, 4


def labelled_table() -> list[tuple[str, int, str, str]]:
    """(url, label 1 block / 0 allow, name, its word): each word alone and put together with companions, in front, behind, with and without a
    hyphen, on many kinds of domain and path; invented words likewise, all allowed."""
    size = len(SYLLABLES)
    words = [(w, y, FORMS[y]) for y in (1, 0) for w in LABELLED_WORDS[y]]
    words += [(a + SYLLABLES[(3 * i + j) % size] + SYLLABLES[(7 * i + 5 * j) % size], 0, INVENTED_FORMS) for i, a in enumerate(SYLLABLES) for j in range(6)]
    out, k = [], 0
    for i, (word, y, forms) in enumerate(words):
        for form in range(forms):
            k += 1
            other, gap = COMPANIONS[(5 * i + 11 * form) % len(COMPANIONS)], ("", "-")[(i + form) // 4 % 2]
            name = (word, other + gap + word, word + gap + other, word)[form % 4]
            path = PATHS[(k // 4 + k) % len(PATHS)].format(k * 37 % 10_007)
            out.append((f"http://{WHERE[k % 4]}{name}.{DOMAINS[(3 * k + form) % len(DOMAINS)]}{path}", y, name, word))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label) of :func:`labelled_table`."""
    return [(url, y) for url, y, _, _ in labelled_table()]


def host_of(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end; only A-Z are lower-cased."""
    h = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, null if none fits; rules: (verdict, host + path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later ones, the longer, override
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, with marks at their ends."""
    out = []
    for salt, part in ((1, host), (2, path)):
        b = np.frombuffer(f"^{part}$".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(b) >= n:
                h = np.full(len(b) - n + 1, salt * 31 + n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + b[k : len(b) - n + 1 + k]
                out.append(mix(h) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.empty(0, np.int64)


def train(hosts: list[str], paths: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 1.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient steps scaled per weight; features of a URL share one unit of length."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if len(labels) == 0 or labels.min() == labels.max():
        return weights, -1.0
    sets = [url_features(h, p) for h, p in zip(hosts, paths, strict=True)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    used, col = np.unique(np.concatenate(sets), return_inverse=True)  # other weights stay zero
    scale = 1 / np.sqrt(np.maximum(1, np.array([len(s) for s in sets])))
    past, past_bias, own = np.full(len(used), 1e-8), 1e-8, np.zeros(len(used))
    for _ in range(rounds):
        z = np.bincount(row, own[col], len(sets)) * scale + bias
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(sets)
        g = np.bincount(col, slope[row] * scale[row], len(used)) + ridge * own
        past, past_bias = past + g * g, past_bias + slope.sum() ** 2
        own, bias = own - rate * g / np.sqrt(past), bias - rate * slope.sum() / np.sqrt(past_bias)
    weights[used] = own
    return weights, float(bias)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for every row; score: the model's probability of block.

    labelled: (url, label 1 block / 0 allow); only the MAX_TRAIN rows with the smallest URL hashes are used. If not
    given, the URLs of ``pages`` that a rule decides are the table, labelled by their rules.
    """
    d = pages.select(F.col(id_col).alias(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        table = d.filter("ruled is not null").select("host", "path", (F.col("ruled") == "block").cast("int").alias("label"))
    else:
        table = labelled.select(host_of("url").alias("host"), path_of("url").alias("path"), F.col("label").cast("int").alias("label")).filter("label is not null")
    rows = table.distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(MAX_TRAIN).toPandas()
    weights, bias = train(rows["host"].tolist(), rows["path"].tolist(), rows["label"].to_numpy(float))
    model = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS weights

    def make():
        w = model.value

        def f(batch):
            score = []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k = url_features(h, p)
                z = float(w[k].sum(dtype=np.float64)) / np.sqrt(max(1, len(k))) + bias
                score.append(1 / (1 + np.exp(-z)))
            return pa.table([*(batch.column(i) for i in range(5)), pa.array(score, pa.float64())], names=[id_col, "host", "path", "rule", "ruled", "score"])

        return f

    scored = map_rows(d, make, f"`{id_col}` {d.schema[0].dataType.simpleString()}, host string, path string, rule string, ruled string, score double")
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
