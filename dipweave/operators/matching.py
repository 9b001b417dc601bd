"""Matching detections with published dips of the same star, by several rules, and control stars with targets on the sky."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.epochs import common_time
from ..functions.numbers import finite, known
from ..functions.stars import catalog_links, designation, star_keys
from ..sources.shared import kept


def pairs(dips: DataFrame, candidates: DataFrame, catalog: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(dip_id, candidate_id, dip_time, time, offset, and the candidate's depth_ppm, significance, duration_days): every candidate of a dip's star within the tolerance of its time.

    A range join by buckets of the tolerance's width. Candidates found twice count with their latest found_at.
    """
    links = catalog_links(catalog)
    latest = candidates.where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.max(F.struct("found_at", "target_id", "mission", "t_min", "depth_ppm", "significance", "duration_days")).alias("c")).select("candidate_id", "c.*")
    width = tolerance * (1 + 1e-6) + 1e-9
    bucket = lambda c: F.floor(F.col(c) / width)
    right = latest.select("candidate_id", designation(F.col("target_id")).alias("name"), common_time(F.col("t_min"), F.col("mission")).alias("time"), *(known(F.col(c)).alias(c) for c in ("depth_ppm", "significance", "duration_days"))).where("time IS NOT NULL").withColumn("bucket", bucket("time"))
    left = dips.select("dip_id", designation(F.col("target_id")).alias("dip_name"), finite(F.col("t_min_bkjd")).alias("dip_time")).where("dip_time IS NOT NULL").distinct()
    a = star_keys(left.select("dip_name").distinct(), links, "dip_name")
    b = star_keys(candidates.select(designation(F.col("target_id")).alias("name")).distinct(), links, "name")
    probes = left.join(a.join(b, "star").select("dip_name", "name").distinct(), "dip_name").select("dip_id", "dip_time", "name", F.explode(F.array(*(bucket("dip_time") + k for k in (-1, 0, 1)))).alias("bucket"))
    return probes.join(right, ["name", "bucket"]).withColumn("offset", F.round(F.abs(F.col("dip_time") - F.col("time")), 9)).where(F.col("offset") <= tolerance).select("dip_id", "candidate_id", "dip_time", "time", "offset", "depth_ppm", "significance", "duration_days")


def best(found: DataFrame, *order: Column) -> DataFrame:
    """The first pair of each dip by the given order, then by time and candidate_id; a candidate may serve several dips. Combined before the shuffle."""
    columns = [c for c in found.columns if c != "dip_id"]
    return found.groupBy("dip_id").agg(F.min(F.struct(*(o.alias(f"_{n}") for n, o in enumerate(order)), "time", "candidate_id", F.struct(*columns).alias("pair"))).alias("m")).select("dip_id", "m.pair.*")


def strongest(found: DataFrame) -> DataFrame:
    """Per dip the candidate of the largest significance; one without a significance comes last."""
    return best(found, F.coalesce(-F.col("significance"), F.lit(math.inf)))


def deepest(found: DataFrame) -> DataFrame:
    return best(found, F.coalesce(-F.col("depth_ppm"), F.lit(math.inf)))


def nearest_start(found: DataFrame) -> DataFrame:
    """Per dip the candidate whose window begins nearest to it; a candidate without a duration begins at its minimum."""
    return best(found, F.round(F.abs(F.col("time") - F.coalesce(F.col("duration_days"), F.lit(0.0)) / 2 - F.col("dip_time")), 9))


def one_to_one(found: DataFrame) -> DataFrame:
    """Pairs (dip_id, candidate_id, offset) such that, in the order (offset, dip_id, candidate_id), each pair whose sides are both free is taken.

    Taken in rounds: a pair that is the first of both its dip and its candidate would be taken by the greedy order too, whatever else is; it goes, with all pairs of its sides, and the rest is looked at again.
    """
    left, taken = kept(found.select("dip_id", "candidate_id", "offset").distinct()), None
    order = F.struct("offset", "dip_id", "candidate_id")
    while left.head(1):
        first = left.withColumn("_d", F.min(order).over(Window.partitionBy("dip_id"))).withColumn("_c", F.min(order).over(Window.partitionBy("candidate_id"))).where((F.col("_d") == order) & (F.col("_c") == order)).select("dip_id", "candidate_id", "offset")
        first = kept(first)
        taken = first if taken is None else taken.unionByName(first)
        left = kept(left.join(first.select("dip_id"), "dip_id", "left_anti").join(first.select("candidate_id"), "candidate_id", "left_anti"))
    return taken if taken is not None else found.select("dip_id", "candidate_id", "offset")


def distance_pc(plx: Column) -> Column:
    """Parsecs from a parallax in milliarcseconds; NULL unless positive."""
    return F.when(known(plx) > 0, 1000 / plx)


def stars_of(catalog: DataFrame) -> DataFrame:
    """One row per tic_id: repeated rows may differ in missing fields, each field takes its smallest value that is there."""
    return catalog.where("tic_id IS NOT NULL").groupBy("tic_id").agg(*(F.min(known(F.col(c)) if c != "kic" else F.col(c)).alias(c) for c in ("ra_deg", "dec_deg", "tmag", "teff", "plx", "kic", "dst_arcsec")))


def best_cross_match(catalog: DataFrame) -> DataFrame:
    """(kic, tic_id, dst_arcsec): for each KIC number the TIC star nearest to it; an unknown separation counts as none, of equals the smallest tic_id."""
    return stars_of(catalog).where("kic IS NOT NULL").groupBy("kic").agg(F.min(F.struct(F.coalesce("dst_arcsec", F.lit(0.0)).alias("d"), "tic_id", "dst_arcsec")).alias("m")).select("kic", "m.tic_id", "m.dst_arcsec")


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two places on the sky."""
    a, b = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def within_radius(centers: DataFrame, stars: DataFrame, radius: float) -> DataFrame:
    """All columns of both (centers: c_ra, c_dec; stars: ra_deg, dec_deg) and sep for each star within radius degrees of a center.

    Joined on bands of declination as high as the radius and, away from the poles, on bands of right ascension; then by the true distance.
    """
    # RA bands hold where the cone is narrower than a band: cos(dec) >= sin(radius) / sin(90)
    n_ra = max(1, int(360 / (radius * 4)))
    band = lambda d: F.floor((d + 90) / radius).cast("int")
    zone = lambda r: F.pmod(F.floor(r * n_ra / 360).cast("int"), F.lit(n_ra))
    wide = F.abs(F.col("c_dec")) + radius >= 70
    zones = F.when(wide, F.sequence(F.lit(0), F.lit(n_ra - 1))).otherwise(F.array_distinct(F.array(*(F.pmod(zone(F.col("c_ra")) + k, F.lit(n_ra)) for k in (-1, 0, 1)))))
    probes = centers.withColumn("_band", F.explode(F.array(*(band(F.col("c_dec")) + k for k in (-1, 0, 1))))).withColumn("_zone", F.explode(zones))
    placed = stars.withColumn("_band", band(F.col("dec_deg"))).withColumn("_zone", zone(F.col("ra_deg")))
    return probes.join(placed, ["_band", "_zone"]).withColumn("sep", separation(F.col("c_ra"), F.col("c_dec"), F.col("ra_deg"), F.col("dec_deg"))).where(F.col("sep") <= radius).drop("_band", "_zone")


def control_stars(targets: DataFrame, catalog: DataFrame, radii: tuple[float, ...] = (1.0, 3.0, 8.0, 15.0), magnitudes: float = 0.5, distances: float = 0.3) -> DataFrame:
    """(tic_id, control_id, radius, dmag, sep): for each target star the control most like it, from the smallest radius that has any.

    targets: tic_id. A control isn't a target; its brightness is known and within `magnitudes` of the target's; if both distances are known they differ by
    at most the part `distances` of the target's. In the smallest radius with one, the nearest in brightness is taken, then on the sky, then by number. Targets without a place or brightness have none.
    """
    stars = kept(stars_of(catalog).where("ra_deg IS NOT NULL AND dec_deg IS NOT NULL AND tmag IS NOT NULL").select("tic_id", "ra_deg", "dec_deg", "tmag", distance_pc(F.col("plx")).alias("distance")))
    wanted = targets.select("tic_id").where("tic_id IS NOT NULL").distinct()
    centers = stars.join(wanted, "tic_id").select(F.col("tic_id").alias("target"), F.col("ra_deg").alias("c_ra"), F.col("dec_deg").alias("c_dec"), F.col("tmag").alias("c_mag"), F.col("distance").alias("c_distance"))
    others = stars.join(wanted, "tic_id", "left_anti").select("tic_id", "ra_deg", "dec_deg", "tmag", "distance")
    answers = None
    for r in radii:  # only targets that have none yet look farther
        near = within_radius(centers, others, r).withColumn("dmag", F.round(F.abs(F.col("tmag") - F.col("c_mag")), 9)).where(F.col("dmag") <= magnitudes)
        alike = near.where(F.coalesce(F.abs(F.col("distance") - F.col("c_distance")) <= distances * F.col("c_distance"), F.lit(True)))
        got = kept(alike.groupBy("target").agg(F.min(F.struct("dmag", "sep", "tic_id")).alias("m")).select(F.col("target").alias("tic_id"), F.col("m.tic_id").alias("control_id"), F.lit(float(r)).alias("radius"), "m.dmag", "m.sep"))
        answers = got if answers is None else answers.unionByName(got)
        centers = centers.join(got.select(F.col("tic_id").alias("target")), "target", "left_anti")
    return answers
