"""Injections, recovery, completeness, and the upkeep of labelled rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import finite, is_finite, known
from ..functions.stars import designation
from .events import Event, candidate_rows, flagged, measured, periodicity, strength
from .training import FEATURES, features, noise_of
from .medians import exact_median
from ..sources.shared import kept, scratch
from . import series as se
from .series import has_long
from .variants import Variant, long_variants, near_events, variant_events

#: Classes with an injection, which have a positive depth.
INJECTED = ("comet", "symmetric", "reversed", "flare", "starspot")
#: The depths (ppm) that injections are drawn from, and their weights: fixed values.
DEPTHS_PPM = (200, 300, 500, 750, 1000, 1500, 2000, 3000)
DEPTH_WEIGHTS = (1, 2, 3, 4, 4, 3, 2, 1)


def ramp(time: Column, t0: Column, depth: Column, ingress: Column, egress: Column) -> Column:
    """The flux that a dip with a linear fall and a linear recovery takes away."""
    dt = time - t0
    return F.when((dt >= -ingress) & (dt <= 0), depth * (1 + dt / ingress)).when((dt > 0) & (dt <= egress), depth * (1 - dt / egress)).otherwise(0.0)


def _ramp(time: np.ndarray, t0: float, depth: float, ingress: float, egress: float) -> np.ndarray:
    """ramp() of an array."""
    return np.interp(time, [t0 - ingress, t0, t0 + egress], [0.0, depth, 0.0])


def flare(time: Column, t0: Column, amplitude: Column, rise: Column, decay: Column) -> Column:
    """The flux that a flare with a linear rise and an exponential decay adds."""
    dt = time - t0
    return F.when((dt >= -rise) & (dt <= 0), amplitude * (1 + dt / rise)).when(dt > 0, amplitude * F.exp(-dt / decay)).otherwise(0.0)


def starspot(time: Column, period: Column, amplitude: Column, phase: Column | float = 0.0) -> Column:
    """The flux that a rotating spot adds all along the series."""
    return amplitude * F.sin(2 * math.pi * time / period + phase)


def trials(rows: DataFrame, depths: tuple[float, ...], per_depth: int, ingress: float, egress: float, config: Config | None = None) -> DataFrame:
    """(series, trial, t0, depth): per series and depth so many epochs, drawn by hash clear of the ends. Series too short to hold one have none."""
    c = config or Config()
    pad = c.candidates.edge_margin_days + ingress + egress
    span = rows.groupBy("series").agg((F.min("time") + pad).alias("low"), (F.max("time") - pad).alias("high")).where("high > low")
    grid = F.array(*(F.struct(F.lit(float(d)).alias("depth"), F.lit(k * per_depth + n).cast("bigint").alias("trial")) for k, d in enumerate(depths) for n in range(per_depth)))
    draw = F.pmod(F.xxhash64(F.lit(c.runtime.rng_seed), "series", "g.trial"), F.lit(1 << 30)) / float(1 << 30)
    return span.withColumn("g", F.explode(grid)).select("series", "g.trial", (F.col("low") + draw * (F.col("high") - F.col("low"))).alias("t0"), "g.depth")


def recovery(rows: DataFrame, depths: tuple[float, ...], per_depth: int = 20, ingress: float = 0.1, egress: float = 0.5, tolerance: float = 0.5, config: Config | None = None, detrend: str = "savgol") -> DataFrame:
    """One row for each injection into the normalised series of rows: (series, trial, t0, depth, detected, flagged, recovered_t0, recovered_a_dur, delta_bic).

    A trial is a series of its own, whose events are measured where it is made. Of several events within the tolerance the most significant counts; no other is scored, and where there is one only, its significance isn't asked for.
    """
    depth, t0 = F.col("depth"), F.col("t0")
    with scratch(rows.sparkSession) as keep:
        spans = keep(rows.groupBy("series").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.max("n").alias("n")))
        plan = keep(trials(spans.select("series", F.explode(F.array("first", "last")).alias("time")), depths, per_depth, ingress, egress, config))
        near = near_events(rows, plan, ingress, egress, tolerance, config, detrend)
        if has_long(spans):
            flux = F.col("flux") - ramp(F.col("time"), t0, depth, F.lit(ingress), F.lit(egress))
            flat = keep(long_variants(rows.where(F.col("n") > se.BLOCK), plan, flux, config, detrend))
            near = near.unionByName(measured(flat, config, near=plan.select(F.struct("series", "trial").alias("series"), t0.alias("at")), tolerance=tolerance).select(near.columns))
        scored = near.withColumns({"significance": strength(), "flagged": flagged(F.col("delta_bic"), F.col("tau_over_sigma"), config)})
        top = scored.groupBy("series.series", "series.trial").agg(F.max(F.struct("significance", -F.col("t_min"), "flagged", "t_min", "a_dur", "delta_bic")).alias("m"))
        found = plan.join(top, ["series", "trial"], "left")
        return kept(found.select("series", "trial", "t0", "depth", F.col("m").isNotNull().alias("detected"), F.coalesce("m.flagged", F.lit(False)).alias("flagged"), F.col("m.t_min").alias("recovered_t0"), F.col("m.a_dur").alias("recovered_a_dur"), F.col("m.delta_bic").alias("delta_bic")))


def label_trials(rows: DataFrame, per_class: int, config: Config | None = None) -> DataFrame:
    """(series, trial, label, t0, amplitude, ingress, egress, period, phase) for per_class trials of each injected class and a fourth of that, at least one, of the others, per series.

    All draws are hashes of the seed, the series and the trial: depths from DEPTHS_PPM by weight; widths of 1 to 10 hours, the longer side of comets and mirrored comets 1.2 to 5 times
    the other; flares rising in 0.01 to 0.1 days and decaying in 0.02 to 0.3; spots of 100 to 5000 ppm with periods of 0.5 to 30 days. Epochs keep clear of the ends.
    """
    c = config or Config()
    margin = c.candidates.edge_margin_days + 2.0
    span = rows.groupBy("series").agg((F.min("time") + margin).alias("low"), (F.max("time") - margin).alias("high")).where("high > low")
    plan = [(k, n) for k in INJECTED for n in range(per_class)] + [(k, n) for k in ("noise", "time_reversed_real") for n in range(max(per_class // 4, 1))]
    grid = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(n).cast("bigint").alias("trial")) for n, (k, _) in enumerate(plan)))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(c.runtime.rng_seed), F.lit(k), "series", "trial"), F.lit(1 << 30)) / float(1 << 30)
    between = lambda k, a, b: a + draw(k) * (b - a)
    ladder = F.array(*(F.lit(p * 1e-6) for p, w in zip(DEPTHS_PPM, DEPTH_WEIGHTS) for _ in range(w)))
    label, width, ratio = F.col("label"), between(3, 1.0, 10.0) / 24, between(4, 1.2, 5.0)
    pick = lambda **by: F.coalesce(*(F.when(label == k, v) for k, v in by.items()))
    depth = F.element_at(ladder, (F.floor(draw(2) * sum(DEPTH_WEIGHTS)) + 1).cast("int"))
    amplitude = F.when(label == "starspot", between(2, 100e-6, 5000e-6)).when(label.isin("noise", "time_reversed_real"), F.lit(None).cast("double")).otherwise(depth)
    return span.withColumn("g", F.explode(grid)).select("series", "low", "high", "g.*").select(
        "series", "trial", "label", (F.col("low") + draw(1) * (F.col("high") - F.col("low"))).alias("t0"), amplitude.alias("amplitude"), pick(comet=width, symmetric=width, reversed=width * ratio, flare=between(3, 0.01, 0.1)).alias("ingress"),
        pick(comet=width * ratio, symmetric=width, reversed=width, flare=between(4, 0.02, 0.3)).alias("egress"), between(5, 0.5, 30.0).alias("period"), between(6, 0.0, 2 * math.pi).alias("phase"),
    )


def labelled(rows: DataFrame, per_class: int = 20, tolerance: float = 0.5, config: Config | None = None) -> DataFrame:
    """Feature rows of detected injections into normalised series: series, trial, label, injected_depth and FEATURES, at most one row per trial.

    A trial is injected, then detrended, then detected; it is answered by the event whose window begins nearest to its epoch, within the tolerance (spots: however far); one without injection by its first event.
    A trial's events, and the period and noise of an answered one, are worked out where the trial is made; the readings of trials of several blocks are kept until the result is written.
    """
    with scratch(rows.sparkSession) as keep:
        plan = keep(label_trials(rows, per_class, config))
        events = keep(variant_events(rows, plan, _changed, lambda v: _answer(v, tolerance), config=config, periods=True))
        if has_long(rows):
            far = rows.where(F.col("n") > se.BLOCK)
            far = far.join(far.select("series", (F.col("n") - 1 - F.col("pos")).alias("pos"), F.col("flux").alias("_back")), ["series", "pos"])
            events = events.unionByName(keep(_far_answers(keep(long_variants(far, plan, _changed_column(), config)), plan, tolerance, config, keep)))
        made = features(candidate_rows(None, config, events=events.drop("periodic", "period_days", "_mad"), periods=events.select("series", "periodic", "period_days")), None, ("series", "trial"), events.select("series", "_mad"))
        return kept(made.join(plan.select("series", "trial", "label", F.col("amplitude").alias("injected_depth")), ["series", "trial"]).select("series", "trial", "label", "injected_depth", *FEATURES))


def _near(v: Variant, tolerance: float) -> list[Event]:
    """The events of a trial whose minimum is within the tolerance of its injection."""
    t0 = v.given["t0"]
    events = [v.event(a, b) for a, b in v.windows if not v.away(a, b, t0, tolerance)]
    return [e for e in events if abs(e.t_min - t0) <= tolerance]


def _answer(v: Variant, tolerance: float) -> list[Event]:
    """The event of a trial of label_trials that answers it, if there is one."""
    label, t0 = v.given["label"], v.given["t0"]
    free = label in ("noise", "time_reversed_real")
    events = [v.event(a, b) for a, b in v.windows]
    apart = [(e.t_min if free else abs(e.t_min - (e.end_time - e.start_time) / 2 - t0), e.t_min, n) for n, e in enumerate(events)]
    return [events[n] for _, _, n in sorted(x for x in apart if free or label == "starspot" or x[0] <= tolerance)[:1]]


def _far_answers(flat: DataFrame, plan: DataFrame, tolerance: float, config: Config | None, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same for trials of series of several blocks, from their smoothed readings, with the period and the noise of their series."""
    events = keep(measured(flat, config))
    begin = F.abs(F.col("t_min") - (F.col("end_time") - F.col("start_time")) / 2 - F.col("t0"))
    free = F.col("label").isin("noise", "time_reversed_real")
    near = plan.join(events.select("series.*", "t_min", "start_time", "end_time"), ["series", "trial"]).withColumn("apart", F.when(free, F.col("t_min")).otherwise(begin))
    answer = near.where((F.col("apart") <= tolerance) | free | (F.col("label") == "starspot")).groupBy(F.struct("series", "trial").alias("series")).agg(F.min(F.struct("apart", "t_min")).getField("t_min").alias("t_min"))
    theirs = events.join(answer, ["series", "t_min"], "left_semi")
    rest = flat.join(theirs.select("series"), "series", "left_semi")
    return theirs.join(periodicity(rest, config), "series").join(noise_of(rest), "series")


def _changed(time: np.ndarray, flux: np.ndarray, trial: Mapping) -> np.ndarray:
    """The flux of a trial of label_trials."""
    label, t0, a = trial["label"], trial["t0"], trial["amplitude"]
    if label in ("comet", "symmetric", "reversed"):
        return flux - _ramp(time, t0, a, trial["ingress"], trial["egress"])
    if label == "flare":
        dt = time - t0
        return flux + a * np.where(dt > 0, np.exp(-np.maximum(dt, 0) / trial["egress"]), np.maximum(1 + np.minimum(dt, 0) / trial["ingress"], 0))
    if label == "starspot":
        return flux + a * np.sin(2 * math.pi * time / trial["period"] + trial["phase"])
    return np.ascontiguousarray(flux[::-1]) if label == "time_reversed_real" else flux


def _changed_column() -> Column:
    """The same by columns, with `_back` for the flux of the series turned round."""
    t, t0, a, label = F.col("time"), F.col("t0"), F.col("amplitude"), F.col("label")
    dip = label.isin("comet", "symmetric", "reversed")
    change = F.when(dip, -ramp(t, t0, a, F.col("ingress"), F.col("egress"))).when(label == "flare", flare(t, t0, a, F.col("ingress"), F.col("egress"))).when(label == "starspot", starspot(t, F.col("period"), a, F.col("phase"))).otherwise(0.0)
    return F.when(label == "time_reversed_real", F.col("_back")).otherwise(F.col("flux") + change)


def completeness(results: DataFrame, by: str = "depth") -> DataFrame:
    """Per depth the number of injections and the fractions detected and flagged."""
    return results.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("detected").cast("double")).alias("detected"), F.avg(F.col("flagged").cast("double")).alias("flagged"))


def overall(results: DataFrame) -> DataFrame:
    """The number of injections and the fractions detected and flagged over all depths."""
    return results.agg(F.count("*").alias("n"), F.avg(F.col("detected").cast("double")).alias("detected"), F.avg(F.col("flagged").cast("double")).alias("flagged"))


def detection_floor(by_depth: DataFrame, target: float = 0.5, by: str = "depth") -> DataFrame:
    """The smallest depth whose flagged fraction reaches the target; NULL if none does."""
    return by_depth.agg(F.min(F.when(F.col("flagged") >= target, F.col(by))).alias("floor"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Labelled injections of dips as results of a recovery: detected if a depth was measured, flagged by the rule."""
    return labels.where(F.col("label") == "comet").select(finite(F.col("injected_depth")).alias("depth"), finite(F.col("depth_ppm")).isNotNull().alias("detected"), flagged(F.col("delta_bic"), F.col("tau_over_sigma")).alias("flagged")).where("depth IS NOT NULL")


def clean_labels(labels: DataFrame, keep_unmeasured: bool = False) -> DataFrame:
    """Labelled rows with a host, of injected classes with a finite positive depth, each (host_star, label, seed, injected_depth, depth_ppm) once (the smallest label_id).

    Missing depths count as equal, so that repeated rows without one go too; with keep_unmeasured they all stay.
    """
    depth = finite(F.col("injected_depth"))
    valid = labels.where((F.col("host_star") != "") & (~F.coalesce(F.col("label").isin(*INJECTED), F.lit(False)) | (depth > 0)))
    key = [F.col("host_star"), F.col("label"), F.col("seed"), known(F.col("injected_depth")).alias("injected_depth"), known(F.col("depth_ppm")).alias("depth_ppm")]
    apart = F.when(known(F.col("depth_ppm")).isNull() | known(F.col("injected_depth")).isNull(), F.col("label_id")) if keep_unmeasured else F.lit(None).cast("bigint")
    return valid.groupBy(*key, apart.alias("_apart")).agg(F.min("label_id").alias("label_id")).drop("_apart")


def coverage(hosts: DataFrame, labels: DataFrame) -> DataFrame:
    """(host_star, place, n_rows) of a list of hosts: order by (n_rows, place) for the least covered first. Spelling doesn't matter; a host that is no designation is compared as it is."""
    name = F.coalesce(designation(F.col("host_star")), F.col("host_star")).alias("_name")
    counts = labels.groupBy(name).agg(F.count("*").alias("n_rows"))
    return hosts.select("host_star", "place", name).join(counts, "_name", "left").select("host_star", "place", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def ratio_summary(rows: DataFrame, key: str, ratio: Column) -> DataFrame:
    """Per key the median and the population deviation of the finite ratios."""
    r = rows.select(key, ratio.alias("ratio")).where(is_finite(F.col("ratio")))
    return r.groupBy(key).agg(F.count("*").alias("n"), F.stddev_pop("ratio").alias("spread")).join(exact_median(r, key, "ratio", "median"), key)


def flank_levels(rows: DataFrame, events: DataFrame, spans: tuple[float, ...] = (2.0621,), exclusion: float = 3.0, least_exclusion: float = 1.0, least: int = 10) -> DataFrame:
    """(series, event, span, n, level): for each event (series, event, t_min, duration_days) and each span the median flux of both flanks outside its excluded zone; NULL with fewer than `least` readings.

    The zone reaches exclusion / 2 times the duration from the minimum, at least least_exclusion days. Joined by buckets of time, so an event meets only the readings near it.
    """
    half = F.greatest(F.coalesce("duration_days", F.lit(0.0)) * 0.5 * exclusion, F.lit(least_exclusion))
    slot = lambda t: F.floor(t / 4.0)
    wide = events.withColumn("half", half).withColumn("span", F.explode(F.array(*map(F.lit, spans))))
    reach = F.col("half") + F.col("span")
    probes = wide.withColumn("slot", F.explode(F.sequence(slot(F.col("t_min") - reach), slot(F.col("t_min") + reach))))
    apart = F.abs(F.col("time") - F.col("t_min"))
    near = probes.join(rows.select("series", "time", "flux", slot(F.col("time")).alias("slot")), ["series", "slot"]).where((apart >= F.col("half")) & (apart <= reach))
    # an event's flanks hold as many readings as a few days have
    return near.groupBy("series", "event", "span").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.percentile("flux", 0.5)).alias("level"))
