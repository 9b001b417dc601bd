"""Exact medians and quantiles per key, without a task that holds all values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import known


def exact_quantile(rows: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """(key, name): the exact q-quantile of value per key, between two values by linear interpolation; NULL and NaN don't count.

    First values are counted in narrow bins, combined before the shuffle; a key has a bounded number of bins. Then only the bins of the two
    ranks in question are looked into, value by value.
    """
    # asinh grows with the value and has bins about 0.2 % wide beyond 1e-11
    binned = rows.select(key, known(F.col(value)).alias("_v")).where("_v IS NOT NULL").withColumn("_bin", F.floor(F.asinh(F.col("_v") * 1e12) * 512))
    w = Window.partitionBy(key)
    counts = binned.groupBy(key, "_bin").count().withColumn("_upto", F.sum("count").over(w.orderBy("_bin"))).withColumn("_n", F.sum("count").over(w))
    rank = (F.col("_n") - 1) * q
    low, high = F.floor(rank) + 1, F.ceil(rank) + 1
    before = F.col("_upto") - F.col("count")
    middle = counts.where((F.col("_upto") >= low) & (before < high)).select(key, "_bin", before.alias("_before"), low.alias("_low"), high.alias("_high"), (rank - F.floor(rank)).alias("_part"))
    each = binned.join(middle, [key, "_bin"]).groupBy(key, "_bin", "_v").agg(F.count("*").alias("_c"), *(F.first(c).alias(c) for c in ("_before", "_low", "_high", "_part")))
    upto = each.withColumn("_at", F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "_bin").orderBy("_v")))
    reached = lambda c: F.min(F.when(F.col("_at") >= F.col(c), F.col("_v")))
    part = F.first("_part")
    return upto.groupBy(key).agg((reached("_low") * (1 - part) + reached("_high") * part).alias(name))


def exact_median(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the exact median of value per key, the mean of the two middle ones for an even count; see exact_quantile."""
    return exact_quantile(rows, key, value, 0.5, name)


def exact_medians(rows: DataFrame, key: str, **values) -> DataFrame:
    """(key, the names of values): the exact medians of several columns per key in one go; NULL for a key without values of one of them."""
    pairs = F.array(*(F.struct(F.lit(n).alias("what"), c.cast("double").alias("v")) for n, c in values.items()))
    long = rows.select(key, F.explode(pairs).alias("p")).select(F.struct(key, "p.what").alias("_k"), "p.v")
    found = exact_quantile(long, "_k", "v", 0.5, "m")
    return found.groupBy(F.col(f"_k.{key}").alias(key)).agg(*(F.max(F.when(F.col("_k.what") == n, F.col("m"))).alias(n) for n in values))
