"""Stars held out for validation, however they are spelled and by whatever catalogue they are named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stars import catalog_links, designation, star_keys
from .lookup import lookup


class HoldOutError(ValueError):
    """A star that is kept for validation turned up in training data."""


def with_star(rows: DataFrame, catalog: DataFrame, column: str, spread: str, name: str = "star") -> DataFrame:
    """rows with the one star that a column names, the smallest of its designations if the catalogue has several for it; NULL where it names none."""
    named = rows.withColumn("_at", designation(F.col(column)))
    stars = star_keys(named.select(F.col("_at").alias("designation")).distinct(), catalog_links(catalog)).groupBy(F.col("designation").alias("_at")).agg(F.min("star").alias(name))
    return lookup(named, stars, "_at", spread).drop("_at")


def _marked(rows: DataFrame, held: DataFrame, catalog: DataFrame, column: str, spread: str) -> DataFrame:
    """rows with `_held`, true where the column names a star of held (names in its first column)."""
    links = catalog_links(catalog)
    stars = star_keys(held.select(designation(F.col(held.columns[0])).alias("designation")).distinct(), links).select("star").distinct()
    named = rows.withColumn("_at", designation(F.col(column)))
    found = star_keys(named.select(F.col("_at").alias("designation")).distinct(), links).join(stars, "star", "left_semi").select(F.col("designation").alias("_at")).distinct().withColumn("_held", F.lit(True))
    return lookup(named, found, "_at", spread).withColumn("_held", F.coalesce("_held", F.lit(False))).drop("_at")


def without_held_out(rows: DataFrame, held: DataFrame, catalog: DataFrame, column: str = "host_star", spread: str = "label_id") -> DataFrame:
    """rows but for those whose column names a star that is held out, also by another spelling or by the number of another catalogue.

    The others stay as they are, with whatever says their order; rows that name no star stay. `spread` is a column by whose hash rows without a star are spread.
    """
    return _marked(rows, held, catalog, column, spread).where("NOT _held").drop("_held")


def check_held_out(rows: DataFrame, held: DataFrame, catalog: DataFrame, column: str = "host_star", spread: str = "label_id") -> DataFrame:
    """rows, unless one names a star that is held out: HoldOutError."""
    if _marked(rows, held, catalog, column, spread).where("_held").head(1):
        raise HoldOutError(f"a star held out for validation is in {column}")
    return rows
