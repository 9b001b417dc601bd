"""Combining records of several sources so that each contributes its share of the total size.

Records get a hash as a random key and are ordered by it within their source, in ranges of keys: sums per range, running sums over the few
ranges of a source and running sums within a range make prefix sums of the sizes without sorting a source in one task. Each source is cut where its
budget ends, after as many whole rounds as the budget takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import n_tokens

#: Records of a source in one range of keys, more or less.
PER_RANGE = 50_000


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, without blanks around, `_` for each run of blanks, `-` and `_` within; NULL if nothing is left."""
    name = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_\-]+", "_")
    return F.when(name != "", name)


def mixture(documents: DataFrame, targets: DataFrame, seed: str = "0") -> DataFrame:
    """(doc_id, source, tokens, uses): each text that is used, and how often.

    targets: source, target_share, max_repeats, one row per source. The total is the largest that every source with a share can bear: the smallest of tokens * max_repeats / share
    over the sources that have tokens. A source without any contributes nothing and the others keep their targets among themselves. A text counts once however many
    documents have it: it belongs to the source among those of its copies that can bear the smallest total (then the smaller name), and
    to its smallest doc_id there. Within a source the records come in the order of a hash; whole rounds over the source are followed by the records up to the budget, the
    last of them in if at least half of it is. Texts without tokens and documents of other sources aren't used. The result is the same for the same rows.
    """
    goals = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("most")).where("source IS NOT NULL AND share > 0 AND most > 0")
    docs = documents.select("doc_id", source_name(F.col("source")).alias("source"), n_tokens(F.col("text")).alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")).where("tokens > 0 AND doc_id IS NOT NULL")
    wanted = docs.join(F.broadcast(goals), "source")  # one row per source of the mixture, set by hand

    # a text belongs to the scarcest source that has it
    copies = wanted.groupBy("digest", "source", "share", "most").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    bears = copies.groupBy("source").agg((F.sum("tokens") * F.first("most") / F.first("share")).alias("bears"), F.ceil(F.count("*") / PER_RANGE).alias("ranges"))
    owned = copies.join(F.broadcast(bears), "source").groupBy("digest").agg(F.min(F.struct("bears", "source", "doc_id", "tokens", "share", "most", "ranges")).alias("m")).select("m.*", F.md5(F.concat_ws(":", F.lit(seed), F.col("m.doc_id").cast("string"))).alias("key"))

    # as many ranges of keys as the source has records for, each as wide as the others
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    ranged = owned.withColumn("range", F.floor(place * F.col("ranges")))
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("n"), F.first("share").alias("share"), F.first("most").alias("most"))
    w = Window.partitionBy("source")
    before = sums.select("source", "range", (F.sum("n").over(w.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("available"), "share", "most")
    total = before.groupBy("source").agg((F.first("available") * F.first("most") / F.first("share")).alias("bears"), F.first("share").alias("share")).agg((F.min("bears") * F.sum("share")).alias("all"), F.sum("share").alias("shares"))
    budget = F.floor(F.col("all") * F.col("share") / F.col("shares") + F.lit(1e-6))
    plan = before.join(F.broadcast(total)).select("source", "range", "before", "available", "most", F.least(budget, F.col("available") * F.col("most")).alias("budget"))
    local = ranged.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    rounds = F.floor(F.col("budget") / F.col("available"))
    start = F.col("before") + F.col("upto") - F.col("tokens")
    extra = (F.col("budget") - rounds * F.col("available") - start) * 2 >= F.col("tokens")
    uses = rounds + extra.cast("bigint")
    return local.drop("share", "most", "bears", "ranges").join(plan, ["source", "range"]).select("doc_id", "source", "tokens", uses.alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, n_records, most_uses) for each source of targets: what a mixture reached."""
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_records"), F.max("uses").alias("most_uses"))
    whole = reached.agg(F.sum("tokens").alias("whole"))
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    return goals.join(reached, "source", "left").join(F.broadcast(whole)).select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_records", "most_uses")))
