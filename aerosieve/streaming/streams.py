"""Structured Streaming forms of landing and daily means.

The append forms (ingest_stream, daily_stream) keep state in the stream and give up what is later than the watermark. The
merging forms (merge_stream, revise_stream) keep their state in a table (see sources.tables): whatever arrives, however late, takes effect once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tables
from ..sources.ingest import flatten_measurements
from ..sources.schemas import MEASUREMENTS_JSON


def measurement_stream(spark: SparkSession, path: str, watermark: str = "30 days", files_per_trigger: int = 1000) -> DataFrame:
    """Newly landed JSON pages as measurements, one per location and hour. Of several
    the first to arrive stays; ``ts`` is the UTC hour."""
    pages = spark.readStream.schema(MEASUREMENTS_JSON).option("maxFilesPerTrigger", files_per_trigger).json(path)
    rows = flatten_measurements(pages).withColumn("ts", F.col("datetime_from_utc").try_cast("timestamp"))
    return rows.filter("ts is not null").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["location_id", "datetime_from_utc"])


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, watermark: str = "30 days") -> StreamingQuery:
    """Appends what has landed since the last run to Parquet and stops; reruns skip files already taken."""
    rows = measurement_stream(spark, path, watermark)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def daily_stream(rows: DataFrame, keys: list[str], ts: str, value: str, min_n: int = 2, watermark: str = "2 days", mean: str = "daily_mean", count: str = "n_used") -> DataFrame:
    """Daily means that close once the watermark passes the day's end; the same as temporal.daily_mean for rows in time.
    Rows later than the watermark are dropped by Spark, which counts them in numRowsDroppedByWatermark."""
    d = rows.withWatermark(ts, watermark).groupBy(*keys, F.window(ts, "1 day").alias("w")).agg(F.avg(value).alias(mean), F.count(value).alias(count))
    return d.filter(F.col(count) >= min_n).select(*keys, F.to_date("w.start").alias("date"), mean, count)


#: Columns of merged measurements beside the narrow layout.
PULLED = "pull int"


def pulled_measurements(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON pages landed as ``pull=<number>/*.json``, as measurements with their pull and the month of their UTC hour; rows without a valid hour go."""
    reader = spark.readStream.schema(f"{MEASUREMENTS_JSON}, {PULLED}")
    pages = (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).json(path)
    rows = flatten_measurements(pages, also=("pull",))
    hour = F.col("datetime_from_utc").try_cast("timestamp_ntz")
    return rows.filter(hour.isNotNull()).withColumn("month", F.date_format(hour, "yyyyMM").cast("int"))


def merge_stream(spark: SparkSession, path: str, base: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """S1, old pull wins: what has landed since the last run is merged into the table ``base``, by month. For each location and hour the row of the
    smallest pull stays, ties by sensor and value, in whatever order the files arrive; a repeated batch changes nothing."""
    def merge(batch: DataFrame, number: int) -> None:
        keys, ties = ["location_id", "datetime_from_utc"], ["pull", "sensor_id", "value"]
        rest = [c for c in batch.columns if c not in (*keys, *ties)]  # so that the choice never depends on the files' order
        tables.merge_batch(batch, base, keys, [*ties, *rest], ["month"], f"batch-{number}")

    rows = pulled_measurements(spark, path, files_per_trigger)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_measurements(spark: SparkSession, base: str) -> DataFrame:
    """The table of :func:`merge_stream`."""
    schema = flatten_measurements(spark.createDataFrame([], f"{MEASUREMENTS_JSON}, {PULLED}"), also=("pull",)).withColumn("month", F.lit(1)).schema
    return tables.read_table(spark, base, schema)


def _sums(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    date = F.to_date(ts)
    return df.groupBy(*keys, date.alias("date")).agg(F.sum(value).alias("total"), F.count(value).alias("n_used")).withColumn("month", F.date_format("date", "yyyyMM").cast("int"))


def revise_stream(rows: DataFrame, base: str, checkpoint: str, keys: list[str], ts: str, value: str, delay: dt.timedelta = dt.timedelta(days=2)) -> StreamingQuery:
    """S2 with late rows: sums and counts by key and day are merged into the table ``base``/sums, so a late row revises its day. Rows earlier than the
    watermark (the latest time of the batches before, less ``delay``) also go to ``base``/late, by batch. A repeated batch changes neither. Rows without a time are left out."""
    sums, late = f"{base}/sums", f"{base}/late"

    def merge(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"batch-{number}"
        batch = batch.filter(F.col(ts).isNotNull())
        # one record a batch; a batch that is repeated must not count itself
        before = F.max(F.get_json_object("notes", "$.latest").cast("timestamp_ntz"))
        seen = tables.batches(spark, sums).filter(F.col("batch") != name).agg(before).first()[0]
        latest = batch.agg(F.max(F.col(ts).cast("timestamp_ntz"))).first()[0]
        passed = F.lit(False) if seen is None else F.col(ts).cast("timestamp_ntz") < F.lit(seen - delay).cast("timestamp_ntz")
        batch.filter(passed).write.mode("overwrite").parquet(f"{late}/batch={number}")
        again = lambda both: both.groupBy(*keys, "date", "month").agg(F.sum("total").alias("total"), F.sum("n_used").alias("n_used"))
        tables.merge_into(_sums(batch, keys, ts, value), sums, ["month"], again, name, {"latest": latest} if latest else {})

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revised_daily(spark: SparkSession, base: str, rows: DataFrame, keys: list[str], ts: str, value: str, min_n: int = 2, mean: str = "daily_mean", count: str = "n_used") -> DataFrame:
    """Daily means of all that :func:`revise_stream` has taken from ``rows`` so far, late or not: those of temporal.daily_mean."""
    made = _sums(spark.createDataFrame([], rows.schema), keys, ts, value)
    d = tables.read_table(spark, f"{base}/sums", made.schema).filter(F.col("n_used") >= min_n)
    return d.select(*keys, "date", F.try_divide("total", F.col("n_used").cast("double")).alias(mean), F.col("n_used").alias(count))


def late_counts(spark: SparkSession, base: str, rows: DataFrame, keys: list[str], ts: str, count: str = "n_late") -> DataFrame:
    """Late rows of :func:`revise_stream` by key and day."""
    if not tables.exists(spark, f"{base}/late"):
        return spark.createDataFrame([], rows.schema).groupBy(*keys, F.to_date(ts).alias("date")).agg(F.count("*").alias(count))
    return spark.read.schema(rows.schema).parquet(f"{base}/late").groupBy(*keys, F.to_date(ts).alias("date")).agg(F.count("*").alias(count))
