"""Fusion of ground measurements with satellite and model values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(base: DataFrame, other: DataFrame, keys: list[str], value: str, source: str) -> DataFrame:
    """every row of ``base`` with the matching row of ``other``; ``aod_source`` says whether its value is there.
    ``other`` must be unique on the keys (see qc.excess_duplicates), else rows would multiply."""
    return base.join(other, keys, "left").withColumn("aod_source", F.when(F.col(value).isNotNull(), F.lit(source)))


def calibrate(pairs: DataFrame, group: str, y: str, x: str, min_n: int = 2) -> DataFrame:
    """least squares y = intercept + slope x by group; NULL for constant x, pairs with a NULL don't count."""
    out = pairs.groupBy(group).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return out.filter(F.col("n") >= min_n)


def gap_fill(df: DataFrame, coefficients: DataFrame, group: str, y: str, x: str, observed: str = "maiac", filled: str = "merra2_gapfilled") -> DataFrame:
    """missing ``y`` from the group's line; ``source`` names where each value is from, NULL where there is none."""
    c = coefficients.select(group, "slope", "intercept")
    fit = F.col("intercept") + F.col("slope") * F.col(x)
    out = df.join(c, group, "left").withColumn("filled", F.coalesce(F.col(y), fit))
    source = F.when(F.col(y).isNotNull(), observed).when(fit.isNotNull(), filled)
    return out.withColumn("source", source).drop("slope", "intercept")


def held_out_error(pairs: DataFrame, group: str, fold: str, y: str, x: str, min_n: int = 2) -> DataFrame:
    """F2/F3, by group and fold: (n, n_fit, slope, intercept, rmse, bias) of the line fitted on the group's other folds, measured on this one. What
    gap filling would do to values it has not seen.

    One aggregation: each fold's count, means and centred sums of squares and products. The fit without a fold takes
    the fold's from the group's (centred, so large means cost no digits), and the errors follow from the fold's own. Pairs with a NULL don't count; a fit of fewer
    than ``min_n`` pairs or of a constant x has NULL errors."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    p = pairs.filter(both).select(group, fold, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    n = F.count("*")
    f = p.groupBy(group, fold).agg(n.alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), (F.var_pop("_x") * n).alias("xx"), (F.var_pop("_y") * n).alias("yy"), (F.covar_pop("_x", "_y") * n).alias("xy"))
    g = Window.partitionBy(group)  # one row a fold
    mean = lambda m: F.sum(F.col(m) * F.col("n")).over(g) / F.sum("n").over(g)
    f = f.withColumns({"g_n": F.sum("n").over(g), "g_mx": mean("mx"), "g_my": mean("my")})
    whole = lambda s, a, b: F.sum(F.col(s) + F.col("n") * (F.col(a) - F.col(f"g_{a}")) * (F.col(b) - F.col(f"g_{b}"))).over(g)
    f = f.withColumns({"g_xx": whole("xx", "mx", "mx"), "g_xy": whole("xy", "mx", "my"), "n_fit": F.col("g_n") - F.col("n")})
    other = lambda m: F.try_divide(F.col(f"g_{m}") * F.col("g_n") - F.col(m) * F.col("n"), F.col("n_fit"))
    f = f.withColumns({"o_mx": other("mx"), "o_my": other("my")})
    less = lambda s, a, b: F.col(f"g_{s}") - F.col(s) - F.col("n") * F.col("n_fit") / F.col("g_n") * (F.col(a) - F.col(f"o_{a}")) * (F.col(b) - F.col(f"o_{b}"))
    f = f.withColumns({"o_xx": less("xx", "mx", "mx"), "o_xy": less("xy", "mx", "my")})
    # what rounding leaves of a constant x is no slope
    slope = F.when((F.col("n_fit") >= min_n) & (F.col("o_xx") > 1e-12 * F.col("g_xx")), F.col("o_xy") / F.col("o_xx"))
    f = f.withColumn("slope", slope).withColumn("intercept", F.col("o_my") - F.col("slope") * F.col("o_mx"))
    bias = F.col("intercept") + F.col("slope") * F.col("mx") - F.col("my")
    f = f.withColumn("bias", bias)
    centred = F.col("yy") - 2 * F.col("slope") * F.col("xy") + F.col("slope") * F.col("slope") * F.col("xx")
    rmse = F.sqrt(F.greatest(F.lit(0.0), centred) / F.col("n") + F.col("bias") * F.col("bias"))
    return f.select(group, fold, "n", "n_fit", "slope", "intercept", F.when(F.col("slope").isNotNull(), rmse).alias("rmse"), "bias")


def calibration_error(errors: DataFrame, group: str) -> DataFrame:
    """by group the held-out pairs, folds, root mean square error and bias over all folds of :func:`held_out_error` that have a fit."""
    n = F.sum("n")
    return errors.filter("rmse is not null").groupBy(group).agg(
        n.alias("n"), F.count("*").alias("n_folds"), F.sqrt(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")) / n).alias("rmse"), (F.sum(F.col("n") * F.col("bias")) / n).alias("bias"))
