"""NaN-safe helpers. Spark orders NaN above every number and finds NaN equal to NaN; measured columns go through these first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def known(c: Column) -> Column:
    """NULL where a value is missing (NULL or NaN); infinite values stay."""
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    """True for a number that is neither missing nor infinite; never NULL."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INFINITY)), F.lit(False))


def finite(c: Column) -> Column:
    """NULL where a value is missing or infinite."""
    return F.when(is_finite(c), c)


def median(c: Column) -> Column:
    """Exact median, the mean of the two middle values for an even count; missing values don't count."""
    return F.percentile(known(c), F.lit(0.5))


def nonzero(c: Column) -> Column:
    """NULL for 0, so that a division by it gives NULL."""
    return F.when(c != 0, c)
