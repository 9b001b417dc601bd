"""Pairing records of two tables by nearest time within a tolerance, for the same entity.

Times fall into buckets as wide as the tolerance, so that a partner within it is in the same bucket or an adjacent one: an equality join,
spread over entity and time, then a filter by difference and a minimum that is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.epochs import common_time
from ..functions.numbers import finite
from ..functions.stars import catalog_links, designation, star_keys
from ..operators.lookup import lookup

#: Differences count to within so many days, for times are sums of decimal fractions.
EXACT = 1e-9


def nearest(left: DataFrame, right: DataFrame, links: DataFrame, tolerance: float) -> DataFrame:
    """(left_id, right_id, difference): for each left record its nearest right one of the same entity, if within the tolerance (inclusive).

    left: left_id, entity, time; right: right_id, entity, time; links: distinct pairs (left_entity, right_entity) of entities that are the
    same. Records with a NULL anywhere pair with nothing. Of several equally near the smallest right_id is taken; a right record may serve
    several left ones. Entities with many left records are looked up without a shuffle by entity. Right records of one entity, bucket and time are joined as one, so heaps of repeated records stay small.
    """
    width = tolerance * (1 + 1e-6) + EXACT
    bucket = F.floor(F.col("time") / width)
    some = right.where("right_id IS NOT NULL AND entity IS NOT NULL AND time IS NOT NULL").groupBy(F.col("entity").alias("right_entity"), bucket.alias("bucket"), F.col("time").alias("right_time")).agg(F.min("right_id").alias("right_id"))
    partners = links.groupBy(F.col("left_entity").alias("entity")).agg(F.collect_set("right_entity").alias("partners"))  # an entity has few names
    named = lookup(left.where("left_id IS NOT NULL AND time IS NOT NULL"), partners, "entity", "left_id").select("left_id", "time", F.explode("partners").alias("right_entity"))
    probes = named.select("left_id", "time", "right_entity", F.explode(F.array(*(bucket + k for k in (-1, 0, 1)))).alias("bucket"))
    difference = F.round(F.abs(F.col("time") - F.col("right_time")), 9)
    near = probes.join(some, ["right_entity", "bucket"]).withColumn("difference", difference).where(F.col("difference") <= tolerance)
    return near.groupBy("left_id").agg(F.min(F.struct("difference", "right_id")).alias("m")).select("left_id", "m.right_id", "m.difference")


def match_dips(dips: DataFrame, candidates: DataFrame, catalog: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(dip_id, candidate_id, difference): each known dip with a time and the candidate of the same star nearest to it, if within the tolerance of so many days.

    Candidates found more than once count with their latest found_at, repeated dips once. Times without a known mission, and missing or infinite ones, pair with nothing, nor do
    designations that name no star. Further columns are left out. Empty tables give an empty result.
    """
    links = catalog_links(catalog)
    dip = dips.select(F.col("dip_id").alias("left_id"), designation(F.col("target_id")).alias("entity"), finite(F.col("t_min_bkjd").cast("double")).alias("time")).distinct()
    latest = candidates.where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.max(F.struct("found_at", "target_id", "mission", "t_min")).alias("c"))
    found = latest.select(F.col("candidate_id").alias("right_id"), designation(F.col("c.target_id")).alias("entity"), common_time(F.col("c.t_min").cast("double"), F.col("c.mission")).alias("time"))
    # entities are matched once for each designation, so that no star with many candidates is a hot key here
    a, b = (star_keys(names.select(F.col("entity").alias("designation")).distinct(), links).withColumnRenamed("designation", k) for names, k in ((dip, "left_entity"), (candidates.select(designation(F.col("target_id")).alias("entity")), "right_entity")))
    pairs = a.join(b, "star").select("left_entity", "right_entity").distinct()
    return nearest(dip, found, pairs, tolerance).select(F.col("left_id").alias("dip_id"), F.col("right_id").alias("candidate_id"), "difference")
