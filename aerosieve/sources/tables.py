"""Partitioned tables into which batches are merged, batch after batch (I10 and I13 as they go on; the sinks of S1 and S2).

A table is a folder with

    data     the rows, Parquet by partition columns
    staged   the new content of the partitions that the batch at hand touches, until these are replaced
    done     the manifest: a record for each batch that is in, with notes of the caller

A batch reads and rewrites only the partitions that it has rows for; the others keep their files. It is safe to repeat: a batch with a record is
skipped; one that failed while staging starts again from the untouched data; one that failed while partitions were
replaced takes the staged content once more, which is whole. So a merge may add up (sums) as well as choose (first of a key). One writer at a time. What is
finished is told by the _SUCCESS marks that Spark's writers leave unless told not to.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import FILE_ROWS, keep_first, write_partitioned

RECORD = "batch string, partitions array<string>, notes string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def in_partitions(by: list[str], values: list[tuple]) -> Column:
    """Rows of the partitions with these values; literals on partition columns, so that Spark lists no other directory."""
    if not values:
        return F.lit(False)
    if len(by) == 1 and all(v[0] is not None for v in values):
        return F.col(by[0]).isin(*[v[0] for v in values])
    return reduce(or_, [reduce(and_, [F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(by, v, strict=True)]) for v in values])


def read_table(spark: SparkSession, base: str, schema) -> DataFrame:
    """All rows; of a table without a batch none."""
    if not exists(spark, f"{base}/data"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/data")


def batches(spark: SparkSession, base: str) -> DataFrame:
    """The manifest: (batch, partitions, notes as JSON)."""
    if not exists(spark, f"{base}/done"):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("recursiveFileLookup", "true").json(f"{base}/done")


def merge_into(rows: DataFrame, base: str, by: list[str], combine: Callable[[DataFrame], DataFrame], batch: str, notes: dict | None = None, file_rows: int = FILE_ROWS) -> bool:
    """Merges a batch of rows, partitioned by ``by``: ``combine`` gets the touched partitions' rows and the new ones together and returns what is to stay,
    with the same columns and without moving rows between partitions. False if the batch is in already. The driver gets the values of the touched
    partitions, no more than it lists as directories anyway. A batch without rows is recorded too."""
    spark = rows.sparkSession
    staged, done = f"{base}/staged/{batch}", f"{base}/done/{batch}"
    if exists(spark, f"{done}/_SUCCESS"):
        delete(spark, staged)
        return False
    names = [*[c for c in rows.columns if c not in by], *by]
    rows = rows.select(names).persist()  # partition columns come last when they are read; a landing is parsed once
    touched = [tuple(r) for r in rows.select(*by).distinct().collect()]
    if touched:
        if not exists(spark, f"{staged}/_SUCCESS"):
            old = read_table(spark, base, rows.schema).filter(in_partitions(by, touched))
            _stage(combine(old.unionByName(rows)).select(names), staged)
        # counting rows for files of even size reads the staged rows, not the merge again
        write_partitioned(spark.read.schema(rows.schema).parquet(staged), f"{base}/data", by, "overwrite", file_rows, dynamic=True)
    rows.unpersist()
    record = [(batch, sorted("/".join(map(str, t)) for t in touched), json.dumps(notes or {}, default=str))]
    spark.createDataFrame(record, RECORD).coalesce(1).write.mode("overwrite").json(done)
    delete(spark, staged)
    return True


def _stage(merged: DataFrame, path: str) -> None:
    merged.write.mode("overwrite").parquet(path)


def merge_batch(rows: DataFrame, base: str, keys: list[str], order: list[str], by: list[str], batch: str) -> bool:
    """I10 on the touched partitions only: of each key the first row in ``order`` stays, whichever batch brought it. Let ``order`` begin with the number of
    the pull and old pulls win, in whatever order they arrive. A key's rows must share their partition."""
    return merge_into(rows, base, by, lambda both: keep_first(both, keys, [F.asc_nulls_last(c) for c in order]), batch)
