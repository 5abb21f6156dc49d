"""Column expressions shared by the operators. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Months of each season, in the order seasons are listed.
SEASONS: dict[str, tuple[int, ...]] = {
    "summer": (3, 4, 5),
    "monsoon": (6, 7, 8, 9),
    "post_monsoon": (10, 11),
    "winter": (12, 1, 2),
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, digits: int) -> Column:
    """Half-to-even rounding of the scaled value, as numpy rounds (Spark's round is half-up)."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def clean(c: str | Column) -> Column:
    """NaN becomes NULL: in Spark NaN equals NaN and exceeds every number, which would
    upset range and run checks."""
    return F.when(~F.isnan(col(c)), col(c))


def season(date: str | Column, seasons: Mapping[str, tuple[int, ...]] = SEASONS) -> Column:
    """Season of a date by its month; NULL for a NULL date or a month in no season."""
    month, out = F.month(col(date)), F.lit(None).cast("string")
    for name, months in seasons.items():
        out = F.when(month.isin(*months), name).otherwise(out)
    return out


def local_clock(text: str | Column) -> Column:
    """Wall clock of an ISO string with offset, whatever the session's zone; NULL for bad text."""
    return col(text).try_cast("timestamp_ntz")


def epoch_ms_clock(ms: str | Column) -> Column:
    """UTC wall clock of epoch milliseconds, whatever the session's zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (col(ms).cast("decimal(20,0)") / 1000).cast("decimal(18,6)"))


def haversine_km(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column) -> Column:
    la, lo, lb, lp = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((lp - lo) / 2), 2)
    # rounding may lift a above 1, of which asin is NaN
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate Pearson correlation; NULL for a constant side (built-in corr raises there under ANSI)."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)), F.lit(0.0))
