"""Intervals and times on Spark: overlaps as an equi-join (I7), last value before a time (Q15)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _units(c: str, df: DataFrame) -> Column:
    """A span's end as a whole number: days of dates, integers as they are."""
    return F.unix_date(F.col(c)) if df.schema[c].dataType.simpleString() == "date" else F.col(c)


def _binned(df: DataFrame, span: tuple[str, str], on: list[str]) -> DataFrame:
    """Rows with their span's numbers (_s, _e) and its level: the first at which it meets at most two bins."""
    s, e = (_units(c, df).cast("long") for c in span)
    d = df.withColumns({"_s": s, "_e": e}).filter("_s is not null and _e is not null and _s <= _e")
    for c in on:
        d = d.filter(F.col(c).isNotNull())
    # a span of n units meets at most two bins of width n or more
    return d.withColumn("_level", F.ceil(F.log2((F.col("_e") - F.col("_s") + 1).cast("double"))).cast("int"))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] = ()) -> DataFrame:
    """All pairs whose spans (both ends included) overlap and whose ``on`` columns are equal, once each: the columns of both, which must have different names
    but for ``on``. Spans are dates or integers; rows with a NULL end or key, or that end before they start, meet nothing.

    An equi-join on bins. Bins come in widths of powers of two; a span lives at the level where it meets at most two bins, and
    is shown also to the coarser levels that the other side lives at, so it is copied at most twice a level, however long it is. Two spans
    meet at the level of the longer, in the bin that holds the later start."""
    on = list(on)
    a, b = _binned(left, left_span, on), _binned(right, right_span, on)

    def lived(df: DataFrame) -> list[int]:  # a span of n units has level log2 n: some dozens of numbers
        return sorted(r[0] for r in df.select("_level").distinct().collect())

    def shown(df: DataFrame, names: list[str], other: list[int], tag: str) -> DataFrame:
        """Each row at its own level and at the coarser ones of the other side."""
        coarser = F.filter(F.array(*[F.lit(x) for x in other]).cast("array<int>"), lambda x: x > F.col("_level"))
        d = df.withColumn("_at", F.explode(F.array_union(F.array("_level"), coarser)))
        low, high = (F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_at"))).cast("long") for c in ("_s", "_e"))
        d = d.withColumn("_bin", F.explode(F.array_distinct(F.array(low, high))))
        return d.select(*[F.col(c).alias(f"_{tag}{k}") if c in on else F.col(c) for k, c in enumerate(names)],
                        F.col("_s").alias(f"_s{tag}"), F.col("_e").alias(f"_e{tag}"), F.col("_level").alias(f"_l{tag}"), F.col("_at").alias(f"_at{tag}"), F.col("_bin").alias(f"_bin{tag}"))

    x, y = shown(a, left.columns, lived(b), "a"), shown(b, right.columns, lived(a), "b")
    key = {c: (f"_a{left.columns.index(c)}", f"_b{right.columns.index(c)}") for c in on}
    same = [F.col("_ata") == F.col("_atb"), F.col("_bina") == F.col("_binb"), *[F.col(p) == F.col(q) for p, q in key.values()]]
    # one of them lives here, and the later start is in this bin
    here = (F.greatest("_la", "_lb") == F.col("_ata")) & (F.floor(F.greatest("_sa", "_sb") / F.pow(F.lit(2.0), F.col("_ata"))) == F.col("_bina"))
    met = x.join(y, reduce(and_, same) & here & (F.col("_sa") <= F.col("_eb")) & (F.col("_sb") <= F.col("_ea")))
    return met.select(*[F.col(key[c][0]).alias(c) if c in on else F.col(c) for c in left.columns], *[c for c in right.columns if c not in on])


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, columns: list[str], every: str = "month") -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with the same ``on`` whose time is not after the left one's; NULLs where there is none.
    Of right rows at the same time the one with the greatest ``columns`` counts. Left rows with a NULL key or time find nothing.

    Both sides are put together by key and time bucket (``every``: year, month, day, hour), and a running last value goes
    through each bucket. What a bucket starts with is the last value of the buckets before, from one row for each key and bucket, so that a key with very
    many rows is spread over its buckets."""
    if every not in ("year", "month", "day", "hour"):
        raise ValueError("every must be year, month, day or hour")
    known = reduce(and_, [F.col(c).isNotNull() for c in [*on, left_ts]])
    time = lambda c: F.col(c).cast("timestamp_ntz")
    bucket = lambda c: F.date_trunc(every, c).cast("timestamp_ntz")
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    k = [f"_k{i}" for i in range(len(on))]
    r = right.filter(reduce(and_, [F.col(c).isNotNull() for c in [*on, right_ts]])).select(*keys, time(right_ts).alias("_t"), F.struct(*columns).alias("_found"))
    r = r.withColumn("_bucket", bucket(F.col("_t")))
    rows = left.filter(known).select(*keys, time(left_ts).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row")).withColumn("_bucket", bucket(F.col("_t")))
    last = r.groupBy(*k, "_bucket").agg(F.max(F.struct("_t", "_found")).alias("m")).select(*k, "_bucket", F.col("m._found").alias("_last"))
    marks = last.unionByName(rows.select(*k, "_bucket").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)))
    marks = marks.groupBy(*k, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
    # as many rows a key as it has buckets
    before = Window.partitionBy(*k).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*k, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_found")).filter("_found is not null")
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # order in a bucket: what it starts with (0), then by time, right rows (1) before left rows (2)
    both = carried.select(*k, "_bucket", F.lit(None).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_side"), "_found", none("_row", rows))
    both = both.unionByName(r.select(*k, "_bucket", "_t", F.lit(1).alias("_side"), "_found", none("_row", rows)))
    both = both.unionByName(rows.select(*k, "_bucket", "_t", F.lit(2).alias("_side"), none("_found", r), "_row"))
    w = Window.partitionBy(*k, "_bucket").orderBy(F.asc_nulls_first("_t"), "_side", "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_side = 2")
    out = met.select(*[F.col("_row").getField(c).alias(c) for c in left.columns], *[F.col("_found").getField(c).alias(c) for c in columns])
    rest = left.filter(~known).select("*", *[none(c, right) for c in columns])
    return out.unionByName(rest)
