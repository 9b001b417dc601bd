"""Queries over light_curves: normalising, levels and noise, runs, windows, events, injections, periodicity; and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Scoring
from ..operators import calibration as cal
from ..operators import events as ev
from ..operators import series as se
from ..operators.training import FEATURES, features
from ..sources.shared import kept, scratch
from ..sources.tables import table

KEYS = list(se.KEYS)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return se.normalised(table(spark, folder, "light_curves"))


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return se.flattened(table(spark, folder, "light_curves"), detrend="none")


def _detrended(spark: SparkSession, folder: str) -> DataFrame:
    return se.flattened(table(spark, folder, "light_curves"))


def _digits(c, n: int = 9):
    return F.round(c, n)


def normalise_series(spark: SparkSession, folder: str) -> DataFrame:
    out = se.series_stats(table(spark, folder, "light_curves"))
    return out.select(*KEYS, "n_points", "n_dropped", _digits("level", 6).alias("level"), _digits("cadence_days").alias("cadence_days"), _digits("baseline_days", 6).alias("baseline_days"))


def normalised_readings(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("series.*", "pos", "time", _digits("flux").alias("flux"), _digits("flux_err").alias("flux_err"))


def time_order(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings of each series are not later than the one before."""
    return se.time_order(table(spark, folder, "light_curves"))


def rolling_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(spark, folder).select("series.*", "pos", _digits("baseline").alias("baseline"), _digits("sigma").alias("sigma"))


def depth_significance(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per series by significance of their depth."""
    r = _plain(spark, folder).withColumn("s", ev.significance(F.col("flux"), F.col("baseline"), F.col("sigma")))
    return r.groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 4).alias("n_deep"), F.count_if(F.col("s") < -4).alias("n_bright")).select("series.*", "n", "n_deep", "n_bright")


def upper_clip(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per series that are clipped as too bright."""
    r = se.clipped(_rows(spark, folder), 5.0)
    return r.groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("clipped") != F.col("flux")).alias("n_clipped")).select("series.*", "n", "n_clipped")


def dip_runs(spark: SparkSession, folder: str) -> DataFrame:
    return ev.runs(_plain(spark, folder)).select("series.*", F.col("start").alias("first_pos"), F.col("end").alias("last_pos"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return ev.windows(_plain(spark, folder)).select("series.*", F.col("start").alias("first_pos"), F.col("end").alias("last_pos"), "start_time", "end_time")


def event_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Minimum, sides and asymmetry of each event."""
    e = ev.measured(_plain(spark, folder), score=False)
    return e.select("series.*", F.col("start").alias("first_pos"), *(_digits(c, n).alias(c) for c, n in (("t_min", 6), ("f_min", 8), ("depth", 8), ("ingress_duration_days", 6), ("egress_duration_days", 6), ("ingress_slope", 6), ("egress_slope", 6), ("a_dur", 6), ("a_slope", 6))))


def time_reverse(spark: SparkSession, folder: str) -> DataFrame:
    """Each series with its flux in reverse order over the same times."""
    r = _rows(spark, folder)
    back = r.select("series", (F.col("n") - 1 - F.col("pos")).alias("pos"), F.col("flux").alias("reversed"))
    return r.join(back, ["series", "pos"]).select("series.*", "pos", "time", _digits("reversed").alias("flux"))


def _middle(spark: SparkSession, folder: str) -> DataFrame:
    r = _rows(spark, folder)
    mid = r.groupBy("series").agg(((F.min("time") + F.max("time")) / 2).alias("t0"))
    return r.join(r.select("series", "block").distinct().join(mid, "series"), ["series", "block"])


def _injected(r: DataFrame, change) -> DataFrame:
    return r.groupBy("series").agg(F.count_if(change != 0).alias("n_changed"), F.round(F.sum(change), 9).alias("total"), F.round(F.min(F.col("flux") + change), 9).alias("lowest"), F.round(F.max(F.col("flux") + change), 6).alias("highest")).select("series.*", "n_changed", "total", "lowest", "highest")


def inject_comet(spark: SparkSession, folder: str) -> DataFrame:
    return _injected(_middle(spark, folder), -cal.ramp(F.col("time"), F.col("t0"), F.lit(2e-3), F.lit(0.1), F.lit(0.5)))


def inject_flare(spark: SparkSession, folder: str) -> DataFrame:
    return _injected(_middle(spark, folder), cal.flare(F.col("time"), F.col("t0"), F.lit(2e-3), F.lit(0.05), F.lit(0.3)))


def inject_starspot(spark: SparkSession, folder: str) -> DataFrame:
    return _injected(_middle(spark, folder), cal.starspot(F.col("time"), F.lit(7.5), F.lit(1e-3)))


def _flanks(spark: SparkSession, folder: str, spans: tuple[float, ...]) -> DataFrame:
    """Levels around the middle of each series."""
    r = _rows(spark, folder)
    mid = r.groupBy("series").agg(F.lit(0).alias("event"), ((F.min("time") + F.max("time")) / 2).alias("t_min"), F.lit(0.5).alias("duration_days"))
    return cal.flank_levels(r, mid, spans).select("series.*", "span", "n", _digits("level").alias("level"))


def out_of_event_level(spark: SparkSession, folder: str) -> DataFrame:
    return _flanks(spark, folder, (2.0621,)).drop("span")


def baseline_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of the flanks by their width."""
    return _flanks(spark, folder, (2.0621, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 14.0, 20.0)).groupBy("span").agg(F.count("*").alias("n_series"), F.count("level").alias("n_levels"), F.round(F.avg("level"), 8).alias("mean_level"), F.sum("n").alias("n_readings"))


def depth_five_ways(spark: SparkSession, folder: str) -> DataFrame:
    """Depths in ppm of the events of the detrended flux: against the local level, against the flanks (h1), of the fitted profile (h2), and both of the first two on the same window of the flux that still has its trend (h3, h1h3)."""
    readings = table(spark, folder, "light_curves")
    with scratch(spark) as keep:
        flat = keep(se.flattened(readings))
        e = keep(ev.measured(flat, Config(scoring=Scoring(bootstrap_draws=0))).withColumn("duration_days", F.col("end_time") - F.col("start_time")))
        raw = se.flattened(readings, detrend="none")
        spots = e.select("series", F.col("start").alias("event"), "t_min", "duration_days")
        level = lambda rows, name: cal.flank_levels(rows, spots).select("series", F.col("event").alias("start"), F.col("level").alias(name))
        inside = ev.with_readings(e.select("series", "n", "start", "end"), raw, 0.0).groupBy("series", "start").agg(F.percentile("baseline", 0.5).alias("raw_level"), F.min("flux").alias("raw_min"))
        all_ways = e.join(level(flat, "flank"), ["series", "start"], "left").join(level(raw, "raw_flank"), ["series", "start"], "left").join(inside, ["series", "start"])
        ppm = {"current": "depth", "h1": "flank - f_min", "h2": "fitted_depth", "h3": "raw_level - raw_min", "h1h3": "raw_flank - raw_min"}
        return kept(all_ways.select("series.*", F.round("t_min", 6).alias("t_min"), *(F.expr(f"({x}) * 1e6D").alias(f"{k}_ppm") for k, x in ppm.items())))


def detrend_savgol(spark: SparkSession, folder: str) -> DataFrame:
    return _detrended(spark, folder).select("series.*", "pos", "time", "flux", "trend")


def detrend_spline(spark: SparkSession, folder: str) -> DataFrame:
    return se.flattened(table(spark, folder, "light_curves"), detrend="spline").select("series.*", "pos", "time", "flux", "trend")


def detect_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return ev.detect(table(spark, folder, "light_curves"))


def periodicity(spark: SparkSession, folder: str) -> DataFrame:
    return ev.periodicity(_detrended(spark, folder)).select("series.*", "periodic", "period_days")


def event_features(spark: SparkSession, folder: str) -> DataFrame:
    r = _detrended(spark, folder)
    return features(ev.candidate_rows(r), r, se.KEYS).select(*KEYS, "t_min", *FEATURES)


def injection_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Completeness by depth of 20 injections per series and depth into every series."""
    return cal.completeness(cal.recovery(_rows(spark, folder), (2e-4, 5e-4, 1e-3, 2e-3, 3e-3, 5e-3, 1e-2)))


def generate_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows of detected injections of all seven classes: per series 20 trials of each injected class and 5 of each of the others."""
    return cal.labelled(_rows(spark, folder)).select("series.*", "trial", "label", "injected_depth", *FEATURES)


def sector_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The quarters or sectors of each target, as a text."""
    q = table(spark, folder, "light_curves").groupBy("target_id", "mission").agg(F.array_sort(F.collect_set("quarter_no")).alias("q"), F.count("*").alias("n_rows"))
    return q.select("target_id", "mission", F.concat_ws(" ", F.transform("q", lambda x: x.cast("string"))).alias("quarters"), "n_rows")


_BASE = """
WITH l AS (SELECT *, isfinite(time) AND isfinite(flux) AND isfinite(flux_err) AND time > 0 AND time < 40000 AND flux > 0 AND flux_err > 0 AS ok FROM light_curves),
u AS (SELECT target_id, mission, quarter_no, idx, time, flux, flux_err, row_number() OVER (PARTITION BY target_id, mission, quarter_no, time ORDER BY idx, flux, flux_err) AS k FROM l WHERE ok),
p AS (SELECT target_id, mission, quarter_no, time, flux AS raw, flux_err AS raw_err, row_number() OVER w - 1 AS pos, lead(time) OVER w - time AS step FROM u WHERE k = 1 WINDOW w AS (PARTITION BY target_id, mission, quarter_no ORDER BY time)),
st AS (SELECT target_id, mission, quarter_no, count(*) AS n, median(raw) AS level, median(step) AS cad, min(time) AS t_first, max(time) AS t_last FROM p GROUP BY ALL),
m AS (SELECT p.target_id, p.mission, p.quarter_no, p.pos, p.time, raw / level AS flux, raw_err / level AS flux_err, n, level, cad, t_first, t_last FROM p JOIN st ON p.target_id = st.target_id AND p.mission = st.mission AND p.quarter_no = st.quarter_no)"""
_SERIES = "target_id, mission, quarter_no"
_ON = " AND ".join("{0}.%s = {1}.%s" % (k, k) for k in KEYS)  # noqa: UP031
_LEVELS = f"""{_BASE},
h AS (SELECT *, greatest(round_even(2.0621 / coalesce(cad, 1), 0)::BIGINT, 1) AS w0 FROM m),
h2 AS (SELECT *, (greatest(least(w0, n) - CASE WHEN least(w0, n) % 2 = 0 THEN 1 ELSE 0 END, 1) - 1) // 2 AS h FROM h),
b AS (SELECT *, median(flux) OVER (PARTITION BY {_SERIES} ORDER BY pos ROWS BETWEEN h PRECEDING AND h FOLLOWING) AS baseline FROM h2),
r AS (SELECT *, 1.4826 * median(abs(flux - baseline)) OVER (PARTITION BY {_SERIES} ORDER BY pos ROWS BETWEEN h PRECEDING AND h FOLLOWING) AS noise FROM b),
g AS (SELECT {_SERIES}, median(abs(flux - baseline)) AS every FROM b GROUP BY ALL),
s AS (SELECT r.*, greatest(noise, 1.4826e-3 * every, 2.2250738585072014e-308) AS sigma FROM r JOIN g ON {_ON.format("r", "g")})"""
_RUNS = f"""{_LEVELS},
hit AS (SELECT {_SERIES}, pos, n, cad, pos - row_number() OVER (PARTITION BY {_SERIES} ORDER BY pos) AS island FROM s WHERE (baseline - flux) / sigma > 4),
r1 AS (SELECT {_SERIES}, n, cad, min(pos) AS a, max(pos) AS z FROM hit GROUP BY {_SERIES}, n, cad, island HAVING count(*) >= 3),
r2 AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY {_SERIES} ORDER BY a) AS grp FROM (SELECT *, a - lag(z) OVER (PARTITION BY {_SERIES} ORDER BY a) - 1 AS gap FROM r1)),
runs AS (SELECT {_SERIES}, n, cad, min(a) AS a, max(z) AS z FROM r2 GROUP BY {_SERIES}, n, cad, grp)"""
_WINDOWS = f"""{_RUNS},
v AS (SELECT * FROM (SELECT *, greatest(round_even(1.0208 / coalesce(cad, 1), 0)::BIGINT, 1) AS margin FROM runs) WHERE z >= margin AND a <= n - 1 - margin),
c AS (SELECT v.*, s.time AS center FROM v JOIN s ON {_ON.format("v", "s")} AND s.pos = (v.a + v.z) // 2),
o AS (SELECT c.{_SERIES.replace(", ", ", c.")}, c.a, c.z, max(CASE WHEN s.pos < c.a AND (baseline - flux) / sigma <= 1 THEN s.pos END) AS ls, min(CASE WHEN s.pos < c.a THEN s.pos END) AS lm,
  min(CASE WHEN s.pos > c.z AND (baseline - flux) / sigma <= 1 THEN s.pos END) AS rs, max(CASE WHEN s.pos > c.z THEN s.pos END) AS rm FROM c JOIN s ON {_ON.format("c", "s")} AND abs(s.time - c.center) <= 1.5 GROUP BY ALL),
w0 AS (SELECT *, coalesce(ls + 1, lm, a) AS na, coalesce(rs - 1, rm, z) AS nz FROM o),
w1 AS (SELECT *, greatest(na, coalesce(max(nz) OVER (PARTITION BY {_SERIES} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1) AS fa FROM w0),
wins AS (SELECT w1.{_SERIES.replace(", ", ", w1.")}, fa AS first_pos, nz AS last_pos, x.time AS start_time, y.time AS end_time FROM w1 JOIN s x ON {_ON.format("w1", "x")} AND x.pos = fa JOIN s y ON {_ON.format("w1", "y")} AND y.pos = nz WHERE fa <= nz)"""
_GEOMETRY = f"""{_WINDOWS},
e0 AS (SELECT wins.{_SERIES.replace(", ", ", wins.")}, first_pos, last_pos, median(baseline) AS level, arg_min(s.pos, (flux, s.pos)) AS i, max(n) AS n FROM wins JOIN s ON {_ON.format("wins", "s")} AND s.pos BETWEEN first_pos AND last_pos GROUP BY ALL),
e1 AS (SELECT e0.*, x.flux AS f, x.time AS t, p0.flux AS fp, p0.time AS tp, p1.flux AS fn, p1.time AS tn FROM e0 JOIN s x ON {_ON.format("e0", "x")} AND x.pos = i LEFT JOIN s p0 ON {_ON.format("e0", "p0")} AND p0.pos = i - 1 LEFT JOIN s p1 ON {_ON.format("e0", "p1")} AND p1.pos = i + 1),
e2 AS (SELECT *, CASE WHEN fp - 2 * f + fn > 0 AND abs(0.5 * (fp - fn) / (fp - 2 * f + fn)) < 1 THEN 0.5 * (fp - fn) / (fp - 2 * f + fn) END AS d FROM e1),
e3 AS (SELECT *, t + coalesce(d * 0.5 * (tn - tp), 0) AS t_min, f - coalesce(0.25 * (fp - fn) * d, 0) AS f_min, round_even((last_pos - first_pos + 1) * 2.0, 0)::BIGINT AS pad FROM e2),
e4 AS (SELECT *, level - f_min AS depth, level - 0.5 * (level - f_min) AS half, greatest(first_pos - pad, 0) AS lo, least(last_pos + pad, n - 1) AS hi FROM e3),
j AS (SELECT e4.{_SERIES.replace(", ", ", e4.")}, first_pos, min(CASE WHEN s.pos > i THEN s.pos END) FILTER (s.flux >= half) AS je, max(CASE WHEN s.pos < i THEN s.pos END) FILTER (s.flux >= half) AS ji FROM e4 JOIN s ON {_ON.format("e4", "s")} AND s.pos BETWEEN lo AND hi GROUP BY ALL),
e5 AS (SELECT e4.*, je, ji, greatest(je - 1, least(i + 2, hi)) AS eh, least(ji + 1, greatest(i - 2, lo)) AS il FROM e4 JOIN j ON {_ON.format("e4", "j")} AND e4.first_pos = j.first_pos),
side AS (SELECT e5.{_SERIES.replace(", ", ", e5.")}, e5.first_pos,
  regr_slope(s.flux, s.time - t) FILTER (s.pos BETWEEN i AND eh) AS se, count(*) FILTER (s.pos BETWEEN i AND eh) AS ne, regr_slope(s.flux, s.time - t) FILTER (s.pos BETWEEN il AND i) AS si, count(*) FILTER (s.pos BETWEEN il AND i) AS ni,
  max(s.flux) FILTER (s.pos = je) AS fe1, max(s.time) FILTER (s.pos = je) AS te1, max(s.flux) FILTER (s.pos = je - 1) AS fe0, max(s.time) FILTER (s.pos = je - 1) AS te0,
  max(s.flux) FILTER (s.pos = ji) AS fi1, max(s.time) FILTER (s.pos = ji) AS ti1, max(s.flux) FILTER (s.pos = ji + 1) AS fi0, max(s.time) FILTER (s.pos = ji + 1) AS ti0
  FROM e5 JOIN s ON {_ON.format("e5", "s")} AND s.pos BETWEEN lo AND hi GROUP BY ALL),
q AS (SELECT e5.*, side.* EXCLUDE ({_SERIES}, first_pos), abs(t_min - CASE WHEN fe1 = fe0 THEN te1 ELSE te0 + (half - fe0) / (fe1 - fe0) * (te1 - te0) END) AS de, abs(t_min - CASE WHEN fi1 = fi0 THEN ti1 ELSE ti0 + (half - fi0) / (fi1 - fi0) * (ti1 - ti0) END) AS di
  FROM e5 JOIN side ON {_ON.format("e5", "side")} AND e5.first_pos = side.first_pos),
z AS (SELECT *, depth > 0 AND je IS NOT NULL AND ne >= 3 AND isfinite(se) AND de > 0 AS oe, depth > 0 AND ji IS NOT NULL AND ni >= 3 AND isfinite(si) AND di > 0 AS oi FROM q)
SELECT {_SERIES}, first_pos, round(t_min, 6) AS t_min, round(f_min, 8) AS f_min, round(depth, 8) AS depth, CASE WHEN oi THEN round(di, 6) END AS ingress_duration_days, CASE WHEN oe THEN round(de, 6) END AS egress_duration_days,
  CASE WHEN oi THEN round(si, 6) END AS ingress_slope, CASE WHEN oe THEN round(se, 6) END AS egress_slope, CASE WHEN oi AND oe THEN round((de - di) / (de + di), 6) END AS a_dur,
  CASE WHEN oi AND oe THEN CASE WHEN abs(si) + abs(se) > 0 THEN round((abs(si) - abs(se)) / (abs(si) + abs(se)), 6) ELSE 0 END END AS a_slope FROM z"""


def _inject(change: str) -> str:
    return f"{_BASE}, x AS (SELECT *, time - (t_first + t_last) / 2 AS dt FROM m), y AS (SELECT *, {change} AS d FROM x) SELECT {_SERIES}, count(*) FILTER (d <> 0) AS n_changed, round(sum(d), 9) AS total, round(min(flux + d), 9) AS lowest, round(max(flux + d), 6) AS highest FROM y GROUP BY ALL"


_FLANKS = f"""{_BASE},
f AS (SELECT {_SERIES}, span, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(median(flux), 9) END AS level FROM m, (SELECT unnest([2.0621, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 14.0, 20.0])::DOUBLE AS span) sp
  WHERE abs(time - (t_first + t_last) / 2) >= 1 AND abs(time - (t_first + t_last) / 2) <= 1 + span GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (time_order, normalise_series, normalised_readings, rolling_baseline, depth_significance, upper_clip, dip_runs, event_windows, event_geometry, time_reverse, inject_comet, inject_flare, inject_starspot, out_of_event_level, baseline_sweep, depth_five_ways, detrend_savgol, detrend_spline, detect_pipeline, periodicity, event_features, injection_recovery, generate_labels, sector_lists)}
SQL = {
    "time_order": f"WITH o AS (SELECT {_SERIES}, idx, min(time) FILTER (NOT isnan(time)) AS time FROM light_curves GROUP BY ALL HAVING min(time) FILTER (NOT isnan(time)) IS NOT NULL), b AS (SELECT *, lag(time) OVER (PARTITION BY {_SERIES} ORDER BY idx) AS before FROM o) SELECT {_SERIES}, count(*) AS n, count(*) FILTER (time <= before) AS n_back FROM b GROUP BY ALL",
    "normalise_series": f"{_BASE}, a AS (SELECT {_SERIES}, count(*) AS every FROM light_curves GROUP BY ALL) SELECT st.{_SERIES.replace(', ', ', st.')}, n AS n_points, every - n AS n_dropped, round(level, 6) AS level, round(cad, 9) AS cadence_days, round(t_last - t_first, 6) AS baseline_days FROM st JOIN a ON {_ON.format('st', 'a')}",
    "normalised_readings": f"{_BASE} SELECT {_SERIES}, pos, time, round(flux, 9) AS flux, round(flux_err, 9) AS flux_err FROM m",
    "rolling_baseline": f"{_LEVELS} SELECT {_SERIES}, pos, round(baseline, 9) AS baseline, round(sigma, 9) AS sigma FROM s",
    "depth_significance": f"{_LEVELS} SELECT {_SERIES}, count(*) AS n, count(*) FILTER ((baseline - flux) / sigma > 4) AS n_deep, count(*) FILTER ((baseline - flux) / sigma < -4) AS n_bright FROM s GROUP BY ALL",
    "upper_clip": f"{_BASE}, d AS (SELECT {_SERIES}, median(flux) AS md FROM m GROUP BY ALL), e AS (SELECT m.*, md FROM m JOIN d ON {_ON.format('m', 'd')}), f AS (SELECT {_SERIES}, median(abs(flux - md)) AS mad FROM e GROUP BY ALL) SELECT e.{_SERIES.replace(', ', ', e.')}, count(*) AS n, count(*) FILTER (mad > 0 AND flux > md + 5 * 1.4826 * mad) AS n_clipped FROM e JOIN f ON {_ON.format('e', 'f')} GROUP BY ALL",
    "dip_runs": f"{_RUNS} SELECT {_SERIES}, a AS first_pos, z AS last_pos FROM runs",
    "event_windows": f"{_WINDOWS} SELECT * FROM wins",
    "event_geometry": _GEOMETRY,
    "time_reverse": f"{_BASE} SELECT a.{_SERIES.replace(', ', ', a.')}, a.pos, a.time, round(b.flux, 9) AS flux FROM m a JOIN m b ON {_ON.format('a', 'b')} AND b.pos = a.n - 1 - a.pos",
    "inject_comet": _inject("-CASE WHEN dt >= -0.1 AND dt <= 0 THEN 2e-3 * (1 + dt / 0.1) WHEN dt > 0 AND dt <= 0.5 THEN 2e-3 * (1 - dt / 0.5) ELSE 0 END"),
    "inject_flare": _inject("CASE WHEN dt >= -0.05 AND dt <= 0 THEN 2e-3 * (1 + dt / 0.05) WHEN dt > 0 THEN 2e-3 * exp(-dt / 0.3) ELSE 0 END"),
    "inject_starspot": _inject("1e-3 * sin(2 * pi() * time / 7.5)"),
    "out_of_event_level": f"{_FLANKS} SELECT * EXCLUDE (span) FROM f WHERE span = 2.0621",
    "baseline_sweep": f"{_FLANKS} SELECT span, count(*) AS n_series, count(level) AS n_levels, round(avg(level), 8) AS mean_level, sum(n)::BIGINT AS n_readings FROM f GROUP BY ALL",
    "sector_lists": "SELECT target_id, mission, array_to_string(list_sort(list(DISTINCT quarter_no)), ' ') AS quarters, count(*) AS n_rows FROM light_curves GROUP BY ALL",
}
