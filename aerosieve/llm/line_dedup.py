"""Operator 13: lines that many documents share are dropped. Built-in functions only.

A text is split at newlines; a line's key is the line without white space at its ends (space, tab, newline, vertical tab,
form feed, carriage return), A-Z in lower case. Lines are exploded and hashed (128 bits), and for each
hash the distinct documents are counted. A text loses all its lines whose key has at least ``min_chars`` code points and occurs in
at least ``min_docs`` documents; the others stay as they are, in order, joined by newlines.

Plan. Lines are exploded once, and their hashes and positions written; only these are shuffled, never lines: the distinct (key, document) pairs and then their counts,
both aggregated before the shuffle, so a line of every document is no hot key. To find where common keys occur, the few that hold more than
one in HOT_KEYS of all their occurrences (fewer than HOT_KEYS by arithmetic) are broadcast, and the others are joined on the key, where none is
larger than that share. Dropped positions go back to their texts in one join on the document, which
adaptive execution splits if equal rows abound.

Null and empty texts have one empty line, which has no key. Documents are told apart by id and text: equal rows count as one
document and come back as often as they were there; rows of one id with different texts are different
documents; a null id is an id like others. Very long texts are nothing special; positions of one
text meet in a row, as its text does. An empty table gives an empty one; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Upper bound of the keys that are broadcast, 16 bytes each.
HOT_KEYS = 4_096
#: The white space that is stripped, and the letters whose case is ignored.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashed(prefix: str, *columns) -> list:
    """Two independent 64-bit hashes of the columns, named ``prefix`` 1 and 2; a null counts as a value."""
    cols = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(*cols).alias(f"{prefix}1"), F.xxhash64(F.lit(13), *cols).alias(f"{prefix}2")]


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, d1, d2, pos): hashes of the key and of the document, and the place of every line that has a key. ``docs`` has d1, d2, text."""
    lines = docs.select("d1", "d2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER)
    keyed = lines.select("d1", "d2", "pos", key.alias("key")).filter(F.length("key") >= max(1, min_chars))
    return keyed.select(*_hashed("k", F.col("key")), "d1", "d2", "pos")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_lines int, n_dropped int): every row of ``docs`` with the text that is left."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_hashed("d", F.col(id_col), text))
    keys = stored(line_keys(d, min_chars), "line-keys")
    counts = keys.select("k1", "k2", "d1", "d2").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"))
    common = stored(counts.filter(F.col("n") >= min_docs), "common-lines")
    occurrences = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > occurrences // HOT_KEYS  # fewer than HOT_KEYS keys can have more than this share
    found = keys.join(F.broadcast(common.filter(hot).drop("n")), ["k1", "k2"]).unionByName(keys.join(common.filter(~hot).drop("n"), ["k1", "k2"]))
    drop = found.groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop"))
    out = d.join(drop, ["d1", "d2"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    joined = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("drop").isNull(), F.col("text")).otherwise(joined).alias("text"), F.size("lines").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"))
