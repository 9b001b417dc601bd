"""Names, angles and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite


def file_name(target: Column) -> Column:
    """A target's name for use in a path: blank, slash and backslash become `_`."""
    return F.translate(target, " /\\", "___")


def slug(target: Column) -> Column:
    """Lower case with `-` for each run of other characters than ASCII letters and digits, none at the ends; `target` if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(target), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("target"))


def kic_number(target: Column) -> Column:
    """The number of a KIC name such as ` kic 0123 `; NULL for any other, so that the digits of other catalogues never match."""
    return F.regexp_extract(target, r"(?i)^\s*kic\s*(\d+)\s*$", 1).try_cast("bigint")


def last_number(text: Column) -> Column:
    """The number a text ends with, as a sector or quarter of a mission's name."""
    return F.regexp_extract(text, r"(\d+)\s*$", 1).try_cast("int")


def safe_double(text: Column) -> Column:
    """A finite number in a text, else NULL."""
    return finite(text.try_cast("double"))


def angle(text: Column, hours: bool) -> Column:
    """Degrees from decimal degrees or from sexagesimal text (`12 34 56.7`, `-05:06:07`), hours for a right ascension; NULL for anything else."""
    parts = F.split(F.trim(text), r"[\s:]+")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    sign = F.when(F.trim(text).startswith("-"), -1.0).otherwise(1.0)
    size = F.abs(part(0)) + part(1) / 60 + F.coalesce(part(2), F.lit(0.0)) / 3600
    return F.when(F.size(parts) == 1, safe_double(F.trim(text))).when(F.size(parts).isin(2, 3), sign * size * (15.0 if hours else 1.0))


def sexagesimal(degrees: Column, hours: bool) -> Column:
    """`HH MM SS.SS` of a right ascension or `+DD MM SS.S` of a declination."""
    scale, digits = (360000, 2) if hours else (36000, 1)
    units = F.bround(F.abs(degrees) / (15 if hours else 1) * scale).cast("bigint")
    per = scale // 3600
    text = F.format_string(f"%02d %02d %02d.%0{digits}d", F.floor(units / (3600 * per)), F.floor(units / (60 * per)) % 60, F.floor(units / per) % 60, units % per)
    return F.when(degrees.isNotNull(), text if hours else F.concat(F.when(degrees < 0, "-").otherwise("+"), text))
