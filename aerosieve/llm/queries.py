"""Queries of the thirteen operators, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, read, scratch_dir
from .embedding_dedup import near_duplicates
from .html_text import main_text
from .jaccard_join import jaccard_classes
from .line_dedup import dedup_lines
from .packing import pack
from .quality import resample
from .sentencepiece_unigram import round_trip
from .token_alignment import align_tokens
from .token_blocks import token_index, write_tokens
from .toxicity import score_toxicity
from .url_filter import judge_urls, labelled_urls
from .vector_search import nearest
from .whitening import whiten


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"), n=4, percent=85)


#: The rules of the URL contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_urls(), "url string, label int")
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES, labelled)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20).drop("scanned")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return token_index(spark, path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), capacity=4096, per_source=4)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)
    return out.select("doc_id", (fold_of() == 1).alias("held_out"), "score", "predicted")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), k=16)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_blocks": op8_token_blocks,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_whitening": op12_whitening,
    "op13_line_dedup": op13_line_dedup,
}

_CLASSES = """ends AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT u, u AS top FROM ends UNION SELECT ends.v, reach.top FROM reach JOIN ends ON ends.u = reach.u),
    low AS (SELECT u, min(top) AS c FROM reach GROUP BY u)"""

ORACLES: dict[str, str] = {
    "op13_line_dedup": """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op2_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    g AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE x IS NOT NULL),
    e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id < q.vec_id AND p.n > 0 AND q.n > 0 AND list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.9),
    {_CLASSES}, k AS (SELECT u, count(*) AS n FROM ends GROUP BY u)
    SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(low.c, vec_id) AS component_id, coalesce(low.c, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN k ON k.u = vec_id LEFT JOIN low ON low.u = vec_id""",
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    {_CLASSES}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.u = d.doc_id""",
}
