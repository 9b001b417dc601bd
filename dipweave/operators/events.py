"""Dips of a series: runs below the local level, windows around them, their geometry, profiles, scores and periodicity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import is_finite
from ..sources.shared import kept, scratch
from .kernels import best_powers, compare_profiles, measure, periodogram_sums
from .series import KEYS, cadences, flattened_twice, loose

#: Readings of a bucket of places, for joining events with their readings.
BUCKET = 512


def significance(flux: Column, baseline: Column, sigma: Column) -> Column:
    """How far a reading is below its local level, in units of the local noise."""
    return (baseline - flux) / sigma


def runs(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """(series, start, end, start_time, end_time, n, cadence): merged runs of significant readings. Only those readings are shuffled.

    A run has at least min_consecutive readings in a row above the threshold; runs with at most max_gap_cadences readings between them are one.
    """
    c = (config or Config()).candidates
    hit = rows.where(significance(F.col("flux"), F.col("baseline"), F.col("sigma")) > c.sigma_threshold).select("series", "pos", "time", "n", "cadence")
    w = Window.partitionBy("series").orderBy("pos")
    islands = hit.withColumn("_island", F.col("pos") - F.row_number().over(w))
    each = islands.groupBy("series", "_island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.max("n").alias("n"), F.max("cadence").alias("cadence")).where(F.col("end") - F.col("start") + 1 >= c.min_consecutive)
    v = Window.partitionBy("series").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("end").over(v) - 1 > c.max_gap_cadences, F.lit(True))
    return each.withColumn("_run", F.sum(apart.cast("int")).over(v)).groupBy("series", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("n").alias("n"), F.max("cadence").alias("cadence")).drop("_run")


def bounds(rows: DataFrame, config: Config | None = None, found: DataFrame | None = None) -> DataFrame:
    """(series, n, start, end): disjoint windows around the runs, in time order; found: the runs, if they are known already.

    Runs entirely within the edge margin go. A run grows on each side until the significance is no more than recovery_sigma or the time is more than half the
    longest window from that of its middle reading; it never shrinks. A window begins after the end of the one before; one with nothing left goes.
    """
    c = (config or Config()).candidates
    margin = cadences(c.edge_margin_days, F.coalesce(F.col("cadence"), F.lit(1.0)))
    inner = (runs(rows, config) if found is None else found).where((F.col("end") >= margin) & (F.col("start") <= F.col("n") - 1 - margin))
    half = c.max_window_days / 2
    slot = lambda t: F.floor(t / c.max_window_days)
    # the middle reading is somewhere in the run, so what is near it is near the run
    near = inner.select("series", "start", "end", "n", F.explode(F.sequence(slot(F.col("start_time") - half), slot(F.col("end_time") + half))).alias("slot"))
    sig = significance(F.col("flux"), F.col("baseline"), F.col("sigma"))
    around = near.join(rows.select("series", slot(F.col("time")).alias("slot"), "pos", "time", (sig <= c.recovery_sigma).alias("low")), ["series", "slot"])
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    around = around.withColumn("center", F.max(F.when(F.col("pos") == mid, F.col("time"))).over(Window.partitionBy("series", "start"))).where(F.abs(F.col("time") - F.col("center")) <= half)
    pos, stop = F.col("pos"), F.coalesce(F.col("low"), F.lit(True))
    left, right = pos < F.col("start"), pos > F.col("end")
    grown = around.groupBy("series", "start").agg(
        F.max("n").alias("n"), F.max("end").alias("end"), F.max(F.when(left & stop, pos)).alias("_lstop"), F.min(F.when(left, pos)).alias("_lmin"), F.min(F.when(right & stop, pos)).alias("_rstop"), F.max(F.when(right, pos)).alias("_rmax"),
    ).select("series", "n", F.coalesce(F.col("_lstop") + 1, "_lmin", "start").alias("a"), F.coalesce(F.col("_rstop") - 1, "_rmax", "end").alias("b"), F.col("start").alias("run"))
    before = F.coalesce(F.max("b").over(Window.partitionBy("series").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return grown.withColumn("a", F.greatest("a", before + 1)).where("a <= b").select("series", "n", F.col("a").alias("start"), F.col("b").alias("end"))


def windows(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """(series, n, start, end, start_time, end_time): the windows of bounds() with the times of their first and last reading."""
    ends = bounds(rows, config).withColumn("pos", F.explode(F.array_distinct(F.array("start", "end"))))
    return ends.join(rows.select("series", "pos", "time"), ["series", "pos"]).groupBy("series", "start", "end").agg(F.max("n").alias("n"), F.min("time").alias("start_time"), F.max("time").alias("end_time")).select("series", "n", "start", "end", "start_time", "end_time")


def with_readings(found: DataFrame, rows: DataFrame, padding: float) -> DataFrame:
    """Windows with the readings of each, and of `padding` times its length on either side, by an equality join on buckets of places."""
    pad = F.bround((F.col("end") - F.col("start") + 1) * padding).cast("bigint")
    low, high = F.greatest(F.col("start") - pad, F.lit(0)), F.least(F.col("end") + pad, F.col("n") - 1)
    wide = found.withColumns({"low": low, "high": high}).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))))
    readings = rows.select("series", F.floor(F.col("pos") / BUCKET).alias("bucket"), "pos", "time", "flux", "flux_err", "baseline")
    return wide.join(readings, ["series", "bucket"]).where((F.col("pos") >= F.col("low")) & (F.col("pos") <= F.col("high"))).drop("bucket")


GEOMETRY = "t_min double, f_min double, depth double, ingress_duration_days double, ingress_slope double, ingress_slope_err double, egress_duration_days double, egress_slope double, egress_slope_err double, a_dur double, a_slope double"
SCORES = "delta_bic double, tau_over_sigma double, fitted_depth double, a_dur_sigma double"


#: The columns of both.
EVENT = tuple(x.split()[0] for x in (GEOMETRY + ", " + SCORES).split(", "))


class Event:
    """One window with its padding, by arrays from place `first` on: its geometry, and what its scores are worked out from."""

    def __init__(self, time: np.ndarray, flux: np.ndarray, err: np.ndarray, base: np.ndarray, first: int, start: int, end: int, c: Config) -> None:
        self.time, self.flux, self.err, self.c, self.start, self.end = time, flux, err, c, int(start), int(end)
        self.window = (self.start - first, self.end - first)
        self.start_time, self.end_time = float(time[self.window[0]]), float(time[self.window[1]])
        self.level = float(np.median(base[self.window[0] : self.window[1] + 1]))
        self.args = (self.level, self.window, (0, len(time) - 1), c.asymmetry.half_depth_fraction, c.asymmetry.min_points_per_side)
        m = {k: x[0] for k, x in measure(time, flux[None, :], *self.args).items()}
        self.t_min = m["t_min"]
        self.geometry = {k: m[k] for k in ("t_min", "f_min", "depth", "a_dur", "a_slope")}
        for side in ("ingress", "egress"):
            self.geometry |= {f"{side}_duration_days": m[f"{side}_duration"], f"{side}_slope": m[f"{side}_slope"], f"{side}_slope_err": m[f"{side}_slope_err"]}

    def profiles(self) -> dict[str, float]:
        return compare_profiles(self.time, self.flux, self.err, self.t_min, self.geometry["depth"], self.level, self.start_time, self.end_time)

    def a_dur_sigma(self) -> float:
        """The bootstrap error of a_dur; NaN if there is none."""
        if not math.isfinite(self.geometry["a_dur"]):
            return math.nan
        draws_of = self.c.scoring.bootstrap_draws
        low, high = max(self.window[0] - 1, 0), min(self.window[1] + 2, len(self.time))
        rng = np.random.default_rng([self.c.runtime.rng_seed, self.start, self.end, int(abs(self.start_time) * 1e6)])
        draws = np.repeat(self.flux[None, :], draws_of, axis=0)
        draws[:, low:high] += rng.normal(size=(draws_of, high - low)) * np.abs(self.err[low:high])
        values = measure(self.time, draws, *self.args, slopes=False)["a_dur"]
        values = values[np.isfinite(values)]
        return float(values.std(ddof=1)) if len(values) > 1 else math.nan


def windows_of(time: np.ndarray, depth: np.ndarray, cadence: float | None, config: Config, place: int = 0, size: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of bounds() of a whole series by arrays; depth: the significance of its readings. Of a part of a series of `size` readings: those from `place` on."""
    c, n, out, before = config.candidates, size or len(time), [], -1
    hit = np.zeros(len(depth) + 2, bool)
    np.greater(depth, c.sigma_threshold, out=hit[1:-1])
    edges = (hit[1:] != hit[:-1]).nonzero()[0].tolist()
    found: list[list[int]] = []
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a < c.min_consecutive:
            continue
        if found and a - found[-1][1] - 1 <= c.max_gap_cadences:
            found[-1][1] = b - 1
        else:
            found.append([a, b - 1])
    margin, half = max(round(c.edge_margin_days / (cadence or 1.0)), 1), c.max_window_days / 2
    for a, b in found:
        if b + place < margin or a + place > n - 1 - margin:
            continue
        center = time[(a + b) // 2]
        first, last = int(time.searchsorted(center - half)), int(time.searchsorted(center + half, "right")) - 1
        # by the difference of times, whatever the rounding of the sums
        while first > 0 and center - time[first - 1] <= half:
            first -= 1
        while center - time[first] > half:
            first += 1
        while last + 1 < len(time) and time[last + 1] - center <= half:
            last += 1
        while time[last] - center > half:
            last -= 1
        left, right = (depth[first:a] <= c.recovery_sigma).nonzero()[0], (depth[b + 1 : last + 1] <= c.recovery_sigma).nonzero()[0]
        a, b = (first + int(left[-1]) + 1 if len(left) else min(first, a)), (b + int(right[0]) if len(right) else max(last, b))
        a, before = max(a, before + 1), max(before, b)
        if a <= b:
            out.append((a + place, b + place))
    return out


def measured(rows: DataFrame, config: Config | None = None, score: bool = True, near: DataFrame | None = None, tolerance: float = 0.5, found: DataFrame | None = None) -> DataFrame:
    """Windows with their geometry and, with score, the comparison of profiles and the bootstrap error of a_dur; NULL is what couldn't be measured.

    found: the runs, if they are known already. With near (series, at), one row per series, only events whose minimum is within the tolerance of that time are scored and returned.

    Each event is one group of at most 1 + 2 search_padding_factor times its window's readings, which max_window_days bounds. The random draws of an event depend on the seed and on its
    place only, not on the order of events.
    """
    c = config or Config()
    wins = bounds(rows, c, found)
    wins = wins.withColumn("at", F.lit(None).cast("double")) if near is None else wins.join(near.select("series", "at"), "series")
    data = with_readings(wins, rows, c.asymmetry.search_padding_factor)
    kind = rows.schema["series"].dataType.simpleString()

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        v = {k: t[k][0].as_py() for k in ("n", "start", "end")}
        pos, time, flux, err, base = (t[k].to_numpy() for k in ("pos", "time", "flux", "flux_err", "baseline"))
        event = Event(time, flux, err, base, int(pos[0]), v["start"], v["end"], c)
        v |= {"start_time": event.start_time, "end_time": event.end_time}
        at = t["at"][0].as_py()
        near_enough = at is None or abs(event.t_min - at) <= tolerance
        got = event.geometry | (event.profiles() | {"a_dur_sigma": event.a_dur_sigma()} if score and near_enough else {})
        row = pa.table({"series": t["series"].slice(0, 1).cast(loose(t["series"].type)), **{k: pa.array([x], pa.float64() if "time" in k else pa.int64()) for k, x in v.items()}, **{k: pa.array([None if got.get(k) is None or got[k] != got[k] else float(got[k])], pa.float64()) for k in EVENT}})
        return row if near_enough else row.slice(0, 0)

    # an event costs time, not space, so its task isn't merged with others for being small
    spread = data.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series", "start")
    return spread.groupBy("series", "start").applyInArrow(one, f"series {kind}, n bigint, start bigint, end bigint, start_time double, end_time double, {GEOMETRY}, {SCORES}")


def periodicity(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """(series, periodic, period_days): the strongest period of each series by a generalised Lomb-Scargle periodogram, and whether its false-alarm probability is below the threshold.

    Each block gives its sums for every frequency; they add up per series and frequency, so a long series spreads over its blocks. Five frequencies per peak width, between the longest and the shortest
    period; standard normalisation; Baluev's bound on the probability, for frequencies up to five times the mean Nyquist frequency. A series with fewer than 10 readings or no extent has no period.
    """
    s = (config or Config()).scoring
    weight = F.expr("CASE WHEN flux_err > 0 THEN 1 / (flux_err * flux_err) ELSE 1.0D END")
    stats = rows.withColumn("weight", weight).groupBy("series").agg(F.count("*").alias("n"), F.min("time").alias("t0"), F.expr("max(time) - min(time)").alias("extent"), F.var_pop("time").alias("spread"), F.sum("weight").alias("w"), F.expr("sum(weight * flux)").alias("wy"))
    long = stats.where("n >= 10 AND extent > 0")
    data = rows.select("series", "block", "time", "flux", weight.alias("weight")).join(rows.select("series", "block").distinct().join(long.selectExpr("series", "t0", "extent", "wy / w AS mean", "w"), "series"), ["series", "block"]).selectExpr("series", "block", "time - t0 AS t", "flux - mean AS y", "weight / w AS weight", "extent")
    low, high = 1 / s.periodicity_max_period_days, 1 / s.periodicity_min_period_days
    kind = rows.schema["series"].dataType.simpleString()

    def sums(t: pa.Table) -> pa.Table:
        step = 1 / (5 * t["extent"][0].as_py())
        f = low + step * np.arange(1 + int(round((high - low) / step)))
        x, y, w = (t[k].to_numpy() for k in ("t", "y", "weight"))
        out = periodogram_sums(x, y, w, low, step, len(f))
        return pa.table({"series": t["series"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(f), np.int64))).cast(loose(t["series"].type)), "frequency": f, "k": np.arange(len(f)), **{c: out[k] for k, c in enumerate(("c", "s", "yc", "ys", "cc", "cs"))}, "yy": np.full(len(f), float((w * y * y).sum()))})

    parts = data.groupBy("series", "block").applyInArrow(sums, f"series {kind}, frequency double, k bigint, c double, s double, yc double, ys double, cc double, cs double, yy double")
    total = parts.groupBy("series", "k").agg(F.max("frequency").alias("frequency"), *(F.sum(c).alias(c) for c in ("c", "s", "yc", "ys", "cc", "cs", "yy")))
    x = total.selectExpr("series", "k", "frequency", "yc", "ys", "yy", "cc - c * c AS cc", "cs - c * s AS cs", "1 - cc - s * s AS ss").selectExpr("*", "cc * ss - cs * cs AS d")
    power = F.expr("least(CASE WHEN d > 0 AND yy > 0 THEN (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * d) END, 1.0D)")
    best = x.groupBy("series").agg(F.max(F.struct(power.alias("power"), -F.col("k"), "frequency")).alias("b"))
    joined = stats.select("series", "n", "extent", "spread").join(best.selectExpr("series", "b.power AS z", "b.frequency AS frequency"), "series", "left")
    top, gamma = "5 * 0.5 * n / extent", f"sqrt(2 / (n - 1)) * exp({_log_gamma('(n - 1) / 2')} - ({_log_gamma('(n - 2) / 2')}))"
    tau = f"{gamma} * {top} * sqrt(4 * pi() * spread) * pow(1 - z, 0.5 * (n - 4)) * sqrt(0.5 * (n - 1) * z)"
    false_alarm = F.expr(f"CASE WHEN z IS NOT NULL THEN 1 - (1 - pow(1 - z, 0.5 * (n - 3))) * exp(-({tau})) END")
    return joined.select("series", F.coalesce(F.coalesce(false_alarm, F.lit(1.0)) < s.periodicity_fap_threshold, F.lit(False)).alias("periodic"), F.expr("1 / frequency").alias("period_days"))


def whole_periods(time: np.ndarray, fluxes: np.ndarray, err: np.ndarray, config: Config) -> list[tuple[bool, float | None]]:
    """(periodic, period_days) of periodicity() for series of one block that share times and errors, a row of fluxes each."""
    s, n, extent = config.scoring, len(time), float(time[-1] - time[0])
    if n < 10 or extent <= 0:
        return [(False, None)] * len(fluxes)
    with np.errstate(all="ignore"):
        weight = np.where(err > 0, 1 / (err * err), 1.0)
        weight = weight / weight.sum()
        y = fluxes - (fluxes @ weight)[:, None]
        low, high, step = 1 / s.periodicity_max_period_days, 1 / s.periodicity_min_period_days, 1 / (5 * extent)
        z, k = best_powers(time - time[0], y, weight, low, step, 1 + int(round((high - low) / step)))
        gamma = math.sqrt(2 / (n - 1)) * math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2))
        tau = gamma * 5 * 0.5 * n / extent * math.sqrt(4 * math.pi * float(time.var())) * (1 - z) ** (0.5 * (n - 4)) * np.sqrt(0.5 * (n - 1) * z)
        false_alarm = 1 - (1 - (1 - z) ** (0.5 * (n - 3))) * np.exp(-tau)
    return list(zip((false_alarm < s.periodicity_fap_threshold).tolist(), (1 / (low + step * k)).tolist()))


def _log_gamma(x: str) -> str:
    """SQL of Stirling's series, shifted so that it holds to 1e-10 from 1 on."""
    y = f"({x} + 7.0D)"
    log = f"({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5))"
    return log + "".join(f" - ln({x} + {k}.0D)" for k in range(7))


def flagged(delta_bic: Column, tau_over_sigma: Column, config: Config | None = None) -> Column:
    """The flag rule: both statistics finite and above their thresholds; never NULL."""
    s = (config or Config()).scoring
    return is_finite(delta_bic) & is_finite(tau_over_sigma) & F.coalesce((delta_bic > s.delta_bic_threshold) & (tau_over_sigma > s.tau_over_sigma_threshold), F.lit(False))


def strength() -> Column:
    """The significance of an event's asymmetry: a_dur in units of its bootstrap error, 0 without one."""
    a, sigma = F.col("a_dur"), F.col("a_dur_sigma")
    return F.when(sigma.isNull(), 0.0).when(sigma <= 0, F.when(a != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(F.abs(a) / sigma)


def candidate_rows(rows: DataFrame, config: Config | None = None, found: DataFrame | None = None, events: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """The output relation: one row for each event with its 18 columns, series' keys in front. The periodogram is worked out only for series with events.

    found: the runs, events: the measured ones, periods: what periodicity() gives for their series, if they are known already.
    """
    events = kept(measured(rows, config, found=found)) if events is None else events
    if periods is None:
        periods = periodicity(rows.join(events.select("series").distinct(), "series", "left_semi"), config)
    all_columns = events.join(periods, "series", "left")
    a = F.col("a_dur")
    return all_columns.select(
        "series.*", "t_min", (F.col("depth") * 1e6).alias("depth_ppm"), (F.col("end_time") - F.col("start_time")).alias("duration_days"), "a_dur", "a_slope", "ingress_duration_days", "egress_duration_days", "a_dur_sigma",
        strength().alias("significance"), "delta_bic", "tau_over_sigma", F.coalesce((F.signum(a) == F.signum("a_slope")) & (a != 0), F.lit(False)).alias("signs_agree"), flagged(F.col("delta_bic"), F.col("tau_over_sigma"), config).alias("flagged"),
        F.coalesce("periodic", F.lit(False)).alias("periodic"), "period_days", F.lit("candidate").alias("vetting_status"), F.lit("").alias("vetting_reasons"), (F.col("end") - F.col("start") + 1).alias("n_points_in_window"), "ingress_slope", "ingress_slope_err", "egress_slope", "egress_slope_err",
    )


def detect(readings: DataFrame, config: Config | None = None, detrend: str = "savgol", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """candidate_rows of raw readings, in two rounds: the first finds the runs, the second goes back only to series that have some, whose flattened readings are written once and go at the end."""
    with scratch(readings.sparkSession) as keep:
        flat, only = flattened_twice(readings, config, detrend, keys)
        found = keep(runs(flat, config))
        own = keep(only(found))
        return kept(candidate_rows(own, config, found))
