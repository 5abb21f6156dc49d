"""Quality control (Q1-Q15). Reports never change the data; filters say so in their name."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean, round_even
from .intervals import asof_join

# Fixed values of the aerosol product: fill, bit fields (shift, mask), code labels, allowed codes.
FILL = -28672
BIT_LAYOUT = {"cloud_mask": (0, 7), "adjacency_mask": (5, 7), "qa_aod": (8, 15), "glint_mask": (12, 1), "aerosol_model": (13, 3)}
STRICTNESS = {"strict": (0,), "moderate": (0, 3), "lenient": (0, 1, 3, 4, 7, 10)}
LABELS: dict[str, dict[int, str]] = {
    "cloud_mask": {0: "Undefined", 1: "Clear", 2: "Possibly Cloudy", 3: "Cloudy", 5: "Cloud Shadow", 6: "Hot spot of fire", 7: "Water Sediments"},
    "adjacency_mask": {0: "Normal/Clear", 1: "Adjacent to clouds", 2: "Surrounded by >4 cloudy pixels", 3: "Adjacent to a single cloudy pixel", 4: "Adjacent to snow", 5: "Snow previously detected"},
    "qa_aod": {0: "Best quality", 1: "Water Sediments detected", 3: "1 neighbor cloud", 4: ">1 neighbor clouds", 5: "No retrieval", 6: "No retrieval near snow", 7: "Climatology AOD (high altitude)", 8: "No retrieval due to sun glint", 9: "Very low AOD due to glint", 10: "AOD replaced near coastline", 11: "Research quality, possibly cloudy"},
    "aerosol_model": {0: "Background", 1: "Smoke", 2: "Dust"},
}


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q1: all rows of groups with more than one row, with the group's size. NULL keys are equal. Groups are counted
    and joined back, so the rows of a large one need not meet in a task."""
    n = df.groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]).agg(F.count("*").alias("n_in_group")).filter("n_in_group > 1")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    return df.join(n, same).select(*df.columns, "n_in_group")


def excess_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q1: rows beyond the first of their group, and groups concerned."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_excess"), F.count_if(F.col("n") > 1).alias("n_groups"))


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Q2: the first row of each group in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def range_report(df: DataFrame, value: str, low: float = 0.0, high: float = 1000.0) -> DataFrame:
    """Q3: rows strictly outside [low, high], labelled; NULL and NaN are in neither."""
    v = clean(F.col(value).cast("double"))
    return df.withColumn("violation", F.when(v < low, "below").when(v > high, "above")).filter("violation is not null")


def range_counts(df: DataFrame, bands: Mapping[str, tuple[list[str], float, float]]) -> DataFrame:
    """Q3: for each named band the rows in which any of its columns is outside the limits; one pass, nothing dropped."""
    out = []
    for name, (cols, low, high) in bands.items():
        bad = F.lit(False)
        for c in cols:
            v = clean(F.col(c).cast("double"))
            bad = bad | F.coalesce((v < low) | (v > high), F.lit(False))
        out.append(F.count_if(bad).alias(f"{name}_out_of_range"))
    return df.agg(*out, F.count("*").alias("n_rows"))


def range_filter(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Q4: rows within [low, high]; NULL and NaN go too."""
    return df.filter(clean(F.col(value).cast("double")).between(low, high))


def range_filter_report(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Q4: rows before, after, and out of range (NULLs aside)."""
    v = clean(F.col(value).cast("double"))
    return df.agg(F.count("*").alias("rows_before"), F.count_if(v.between(low, high)).alias("rows_after"), F.count_if(~v.between(low, high)).alias("n_out_of_range"))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Q5: (key, run_id, run_start, run_end, run_value, run_length) of consecutive rows with equal value; every
    NULL is a run of its own."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    starts = ~F.coalesce(F.col(value) == before, F.lit(False))
    marked = df.withColumn("_new", starts.cast("int"))
    # an explicit ROWS frame: the default RANGE frame would merge ties of the order
    marked = marked.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(key, "run_id").agg(F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"), F.first(value).alias("run_value"), F.count("*").alias("run_length"))


def stuck_runs(df: DataFrame, key: str, order: list[str], value: str, min_run: int = 3) -> DataFrame:
    """Q5: for each key with runs of at least ``min_run``: runs, rows in them, longest. Along a time or date, keys are cut into days or
    months (:func:`stuck_runs_bucketed`), so no key is sorted in one task; along anything else they are sorted whole."""
    kind = df.schema[order[0]].dataType.simpleString()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return stuck_runs_bucketed(df, key, order, value, F.trunc(order[0], "month") if kind == "date" else F.to_date(order[0]), min_run)
    long_runs = runs(df, key, order, value).filter(F.col("run_length") >= min_run)
    return long_runs.groupBy(key).agg(F.count("*").alias("n_runs"), F.sum("run_length").alias("rows_in_runs"), F.max("run_length").alias("longest_run"))


def stuck_runs_bucketed(df: DataFrame, key: str, order: list[str], value: str, bucket: Column, min_run: int = 3) -> DataFrame:
    """Q5 for keys with too many rows for one task: runs are found in each time bucket, and those
    that touch across bucket borders are joined. ``bucket`` must not decrease along ``order``. Same result."""
    d = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    marked = d.withColumn("_new", (~F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    local = marked.groupBy(key, "_bucket", "_run").agg(F.first(value).alias("v"), F.count("*").alias("n"))
    # a bucket's runs reduce to its first, its last and the long ones between; only first and last can grow
    b = Window.partitionBy(key, "_bucket")
    edge = local.withColumn("_last", F.max("_run").over(b)).withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    inner = edge.filter(~F.col("_edge") & (F.col("n") >= min_run)).select(key, F.col("n").alias("run_length"))
    k = Window.partitionBy(key).orderBy("_bucket", "_run")
    ends = edge.filter("_edge")
    joins = F.coalesce((F.col("v") == F.lag("v").over(k)) & ~F.col("_bucket").eqNullSafe(F.lag("_bucket").over(k)), F.lit(False))
    ends = ends.withColumn("_new", (~joins).cast("int")).withColumn("_g", F.sum("_new").over(k.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    outer = ends.groupBy(key, "_g").agg(F.sum("n").alias("run_length")).filter(F.col("run_length") >= min_run).select(key, "run_length")
    return inner.unionByName(outer).groupBy(key).agg(F.count("*").alias("n_runs"), F.sum("run_length").alias("rows_in_runs"), F.max("run_length").alias("longest_run"))


def zero_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Q6: zeros, rows (NULLs too) and percentage of zeros for every key."""
    out = df.groupBy(key).agg(F.count_if(F.col(value) == 0).alias("n_zero"), F.count("*").alias("n_rows"))
    return out.withColumn("pct_zero", round_even(F.col("n_zero") / F.col("n_rows") * 100, 1))


def fill_to_null_and_scale(df: DataFrame, scales: Mapping[str, float], fill: int = FILL) -> DataFrame:
    """Q7: the fill value becomes NULL, then the band is scaled."""
    return df.withColumns({c: F.when(F.col(c) != fill, F.col(c) * F.lit(s)) for c, s in scales.items()})


def fill_counts(df: DataFrame, columns: list[str], fill: int = FILL) -> DataFrame:
    """Q7: fill values of each band, one pass."""
    return df.agg(*[F.count_if(F.col(c) == fill).alias(f"{c}_fill") for c in columns])


def decode_bits(df: DataFrame, word: str, layout: Mapping[str, tuple[int, int]] = BIT_LAYOUT) -> DataFrame:
    """Q8: one integer column per bit field; NULL stays NULL."""
    return df.withColumns({name: F.shiftright(word, shift).bitwiseAND(F.lit(mask)).cast("int") for name, (shift, mask) in layout.items()})


def label_codes(df: DataFrame, labels: Mapping[str, Mapping[int, str]] = LABELS, suffix: str = "_label") -> DataFrame:
    """Q9: label of each code; unmapped codes give NULL."""
    def one(c: str, names: Mapping[int, str]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(c))

    return df.withColumns({f"{c}{suffix}": one(c, names) for c, names in labels.items()})


def category_summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """Q10: (field_order, field, category, n) over several label columns in one aggregation; NULLs left out."""
    rows = F.array(*[F.struct(F.lit(i).alias("field_order"), F.lit(f).alias("field"), F.col(f).alias("category")) for i, f in enumerate(fields)])
    return df.select(F.inline(rows)).filter("category is not null").groupBy("field_order", "field", "category").agg(F.count("*").alias("n"))


def strictness_flag(df: DataFrame, code: str, level: str, levels: Mapping[str, tuple[int, ...]] = STRICTNESS) -> DataFrame:
    """Q11: boolean ``keep``; NULL codes are not kept. Unknown levels raise before anything is planned."""
    if level not in levels:
        raise ValueError(f"strictness must be one of {sorted(levels)}, not {level!r}")
    return df.withColumn("keep", F.coalesce(F.col(code).isin(*levels[level]), F.lit(False)))


def strictness_filter(df: DataFrame, code: str, level: str, levels: Mapping[str, tuple[int, ...]] = STRICTNESS) -> tuple[DataFrame, DataFrame]:
    """Q11: (kept rows, dropped rows)."""
    flagged = strictness_flag(df, code, level, levels)
    return flagged.filter("keep").drop("keep"), flagged.filter("not keep").drop("keep")


def strictness_report(df: DataFrame, code: str, level: str, levels: Mapping[str, tuple[int, ...]] = STRICTNESS) -> DataFrame:
    """Q11: rows kept and dropped and the share kept in percent (one decimal)."""
    out = strictness_flag(df, code, level, levels).agg(F.count("*").alias("n_rows"), F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_dropped"))
    return out.withColumn("pct_kept", round_even(F.col("n_kept") / F.nullif("n_rows", F.lit(0)) * 100, 1))


def keys_lost(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Q12: keys that have no row left."""
    return before.select(key).filter(F.col(key).isNotNull()).distinct().join(after.select(key).distinct(), key, "left_anti")


def coordinate_violations(df: DataFrame, mapping: DataFrame, cell: str, lat: str, lon: str, cell_lat: str, cell_lon: str, tol: float = 0.05, tol_lon: float | None = None, digits: int | None = None) -> DataFrame:
    """Q13: rows farther than ``tol`` degrees from their cell's centre on either axis (``tol_lon`` for longitudes, if given). Cells that are not
    mapped are not checked. With ``digits`` distances are rounded to so many decimals first: for coordinates of fewer decimals that is their
    distance in decimals, whereas between doubles the last bit decides at the tolerance."""
    def off(c: str, centre: str) -> Column:
        d = F.abs(F.col(c) - F.col(centre))
        return d if digits is None else F.round(d, digits)

    m = mapping.select(F.col(cell), F.col(cell_lat), F.col(cell_lon)).dropDuplicates([cell])
    return df.join(m, cell).filter((off(lat, cell_lat) > tol) | (off(lon, cell_lon) > (tol if tol_lon is None else tol_lon)))


def coordinate_gate(df: DataFrame, mapping: DataFrame, cell: str, lat: str, lon: str, cell_lat: str, cell_lon: str, tol: float = 0.05, tol_lon: float | None = None, digits: int | None = None) -> DataFrame:
    """Q13: returns ``df``, or raises naming the cells concerned. One aggregate action; at most 20 names travel."""
    bad = coordinate_violations(df, mapping, cell, lat, lon, cell_lat, cell_lon, tol, tol_lon, digits).groupBy(cell).count().orderBy(cell).limit(20).collect()
    if bad:
        raise ValueError("coordinates do not match their cells: " + ", ".join(f"{r[0]} ({r[1]} rows)" for r in bad))
    return df


def unmapped_cells(df: DataFrame, mapping: DataFrame, cell: str) -> DataFrame:
    """Q13: cells of the data that the mapping lacks."""
    return keys_lost(df, mapping, cell)


def keep_registered(df: DataFrame, registry: DataFrame, key: str, status: str = "status", keep: str = "KEEP") -> DataFrame:
    """Q14: rows of registered keys with the status ``keep`` exactly."""
    return df.join(registry.filter(F.col(status) == keep).select(key), key, "left_semi")


def dropped_keys(df: DataFrame, registry: DataFrame, key: str, status: str = "status", keep: str = "KEEP") -> DataFrame:
    """Q14: keys of the data that are not kept, with their rows."""
    return df.join(registry.filter(F.col(status) == keep).select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n_rows"))


def review(registry: DataFrame, key: str, checks: Mapping[str, tuple[DataFrame, Column]], exceptions: DataFrame | None = None, status: str = "status", keep: str = "KEEP") -> DataFrame:
    """Q15: registry rows whose status disagrees with the rules. checks: name -> (report by key, failing condition on it);
    a key that a report lacks does not fail it. Keys in ``exceptions`` are left out."""
    out, failed = registry, F.lit(False)
    for name, (report, bad) in checks.items():
        flag = report.select(F.col(key), bad.alias(f"fails_{name}"))
        out = out.join(flag, key, "left").withColumn(f"fails_{name}", F.coalesce(f"fails_{name}", F.lit(False)))
        failed = failed | F.col(f"fails_{name}")
    out = out.withColumn("should_drop", failed).filter(F.coalesce(F.col(status) == keep, F.lit(False)) == F.col("should_drop"))
    return out if exceptions is None else out.join(exceptions.select(key), key, "left_anti")


def review_gate(mismatches: DataFrame, key: str) -> None:
    """Q15: raises if :func:`review` left rows; at most 20 keys travel."""
    bad = mismatches.select(key).orderBy(key).limit(20).collect()
    if bad:
        raise ValueError("registry status disagrees with the rules for: " + ", ".join(str(r[0]) for r in bad))


def excused(rows: DataFrame, exceptions: DataFrame, key: str, date: str, reason: str = "exception_reason", since: str = "exception_date", every: str = "month") -> DataFrame:
    """Q15: ``rows`` with the reason and date of the exception in force: the key's last one not after the row's date. An exception counts
    from its date on, until the next of its key; one without a date never does. On one date the greater reason counts."""
    e = exceptions.select(F.col(key), F.col(since), F.col(reason))
    return asof_join(rows, e, [key], date, since, [reason, since], every)


def unexcused(rows: DataFrame, exceptions: DataFrame, key: str, date: str, reason: str = "exception_reason", since: str = "exception_date", every: str = "month") -> DataFrame:
    """Q15: rows without an exception in force on their date; what :func:`review_gate` is to see."""
    return excused(rows, exceptions, key, date, reason, since, every).filter(F.col(since).isNull()).select(rows.columns)
