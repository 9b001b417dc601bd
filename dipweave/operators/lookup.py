"""Looking up a value for each row where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, values: DataFrame, key: str, spread: str, share: int = 200) -> DataFrame:
    """rows with the columns of `values` (unique in key) for their key, NULL where there is none; rows keep their number.

    Keys with more than 1/share of all rows are hot. There are fewer than `share` of them whatever the data, so their values are
    broadcast and their rows aren't shuffled by key; nor are rows with a NULL key, which go by a hash of `spread`. The others are joined by key.
    """
    others = [c for c in values.columns if c != key]
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.select(F.count("*").alias("total"))
    hot = counts.join(F.broadcast(total)).where(F.col("count") * share > F.col("total")).select(F.col(key).alias("_hot"))
    hot_values = values.join(F.broadcast(hot), F.col(key) == F.col("_hot")).select("_hot", F.struct(*others).alias("_hot_values"))
    marked = rows.join(F.broadcast(hot_values), F.col(key) == F.col("_hot"), "left")
    rest = marked.withColumn("_rest", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.xxhash64(spread).cast("string"))))
    looked = rest.join(values.select(F.col(key).alias("_rest"), F.struct(*others).alias("_values")), "_rest", "left")
    return looked.select(*rows.columns, *(F.when(F.col("_hot").isNotNull(), F.col(f"_hot_values.{c}")).otherwise(F.col(f"_values.{c}")).alias(c) for c in others))
