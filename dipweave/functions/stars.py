"""Star designations: a catalogue prefix and a number, spelled in many ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks, `_` and `-` around prefix and number don't matter, nor do letter case and leading zeros.
DESIGNATION = r"^[\s_\-]*(KIC|EPIC|TIC)[\s_\-]*0*([0-9]+)[\s_\-]*$"


def designation(c: Column) -> Column:
    """The one spelling, such as `KIC 123`, of a designation; NULL for NULL and for any other string."""
    up = F.upper(c)
    prefix, number = F.regexp_extract(up, DESIGNATION, 1), F.regexp_extract(up, DESIGNATION, 2)
    return F.when(prefix != "", F.concat(prefix, F.lit(" "), number))


def catalog_links(catalog: DataFrame) -> DataFrame:
    """(tic, kic): each distinct link that a catalogue with tic_id and kic gives, as designations. Rows without either give none."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return catalog.where(F.col("tic_id").isNotNull() & F.col("kic").isNotNull()).select(name("TIC ", "tic_id").alias("tic"), name("KIC ", "kic").alias("kic")).distinct()


def star_keys(names: DataFrame, links: DataFrame, column: str = "designation") -> DataFrame:
    """names with a column star: two designations name the same star if and only if they share a star.

    A designation without a link is its own star; a TIC with links has the KICs it is linked to, one row for each. Rows without a
    designation go. `names` should be distinct designations, so that no star with many rows makes a hot join key.
    """
    kics = links.groupBy("tic").agg(F.collect_set("kic").alias("kics")).withColumnRenamed("tic", column)
    return names.where(F.col(column).isNotNull()).join(kics, column, "left").withColumn("star", F.explode(F.coalesce("kics", F.array(column)))).drop("kics")
