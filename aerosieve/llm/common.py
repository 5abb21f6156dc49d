"""Shared helpers: session settings, scratch tables, batch mapping, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Folders that this driver has written and not yet deleted.
_MADE: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only in local mode, where it may be
    unset, a temporary folder takes its place and is set; elsewhere executors could not read each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp"))
        path = f"file://{_LOCAL[0]}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, label: str = "t", **options) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: later jobs
    read the files instead of recomputing, whichever executors are still alive. ``options``: of the writer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.add(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.difference_update({path, path.replace("file:///", "file:/", 1), path.replace("file:/", "file:///", 1)})


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a frame made by :func:`stored`, through Hadoop's file system."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, root)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that :func:`stored` has written and that is still there: call it when the results of the operators have been saved, which are
    often read from these files."""
    for path in sorted(_MADE):
        _delete(spark, path)


#: Rows of an Arrow batch. Rows here hold whole texts, so Spark's 10,000 would make batches of tens of MB, held several times over.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROWS = 2_000


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, max_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow with a per-task function: ``make()`` runs once in each task and
    returns ``f(table) -> RecordBatch | Table | None``. Batches are cut so that a
    call sees at most ``max_bytes`` (or a single row, if longer). Lowers the session's rows of a batch to MOST_ROWS."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS, "0")) <= MOST_ROWS:
        conf.set(BATCH_ROWS, str(MOST_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                out = f(batch.slice(i, step))
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        last = getattr(f, "finish", None)
        if last:
            for out in last():
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


#: Rows that Spark decodes of a Parquet file at once; its 4,096 would be a whole row group of rows of some MB.
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: Writer options for rows of some MB: else a page and a row group hold 100 rows at least, whatever their size.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows, and as many read from Parquet at once, for what is executed inside: for rows of some MB each."""
    before = {key: spark.conf.get(key, None) for key in (BATCH_ROWS, READ_ROWS)}
    for key in before:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def texts(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHasher(dict):
    """word (bytes) -> its 64-bit hash as 8 bytes. A cache of at most ``limit``
    words: it is emptied between batches, results don't depend on it."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_64_digest(word)
        self[word] = h
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes, order kept."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _M + h[k : len(h) - n + 1 + k]
    return mix(out)


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 3; rows where it is 1 are held out. 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, column): one row per labelled id, held-out ids left out. An id with both labels counts as 1."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold_of() != 1))
    return y.groupBy("doc_id").agg(F.max(column).cast("int").alias(column))


def label_counts(labels: DataFrame, column: str) -> dict[int, int]:
    """How many ids have label 0 and how many 1, all of those that :func:`label_sample` chooses from."""
    return {0: 0, 1: 0} | {r[0]: r[1] for r in labelled(labels, column).groupBy(column).count().collect()}


def label_sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, column, mark): at most ``per_class`` ids with label 0 and as many with 1, held-out ids
    left out, the same ones in every run (smallest hashes). An id with both labels counts as 1."""
    y = labelled(labels, column).withColumn("mark", F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)))
    one = [y.filter(F.col(column) == k).orderBy("mark", "doc_id").limit(per_class) for k in (0, 1)]
    return one[0].unionByName(one[1])
