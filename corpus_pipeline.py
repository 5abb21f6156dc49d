"""Corpus pipeline: toxicity, quality, near duplicates, packing. Part of subpackage llm.

Every stage takes null ids and texts, empty and very long texts, repeated rows and an empty table, and returns the columns
of its input whatever their names, but for the last. Empty texts have no evidence against them: toxicity scores them like a text of ordinary
words only, quality gives them weight 0, near duplicates never joins them. Without labels the two filters keep everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerosieve.llm.common import drop_stored, read, stored
from aerosieve.llm.jaccard_join import one_of_each
from aerosieve.llm.packing import pack
from aerosieve.llm.quality import resample_rows
from aerosieve.llm.toxicity import clean_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7."""
    return clean_rows(docs, read(spark, sf_dir, "labels"), threshold=0.7)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards text labelled good draws, as many as the share of good ones among the labelled."""
    return resample_rows(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id, one row of it) of each class of five-word Jaccard similarity 0.8 or more."""
    return one_of_each(docs, n=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's place in the bins."""
    return pack(docs, capacity=4096, per_source=4)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]

#: No stage but the last could be written in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:  # one copy of the corpus at a time
            drop_stored(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # stored by itself
    drop_stored(docs)
    return out
