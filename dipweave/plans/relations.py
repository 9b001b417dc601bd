"""Queries over candidates, labels, catalogues and the ledger; and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import finite, known
from ..functions.stars import catalog_links, designation, star_keys
from ..operators import calibration as cal
from ..operators import ledger as le
from ..operators import matching as ma
from ..operators import training as tr
from ..operators.events import flagged
from ..operators.hold_out import without_held_out
from ..operators.medians import exact_quantile
from ..sources.shared import new_folder
from ..sources.tables import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ma.pairs(*(table(spark, folder, t) for t in ("known_dips", "candidates", "tic_catalog")))


def match_all(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("dip_id", "candidate_id", F.round("offset", 6).alias("offset"))


def match_max_significance(spark: SparkSession, folder: str) -> DataFrame:
    return ma.strongest(_pairs(spark, folder)).select("dip_id", "candidate_id")


def match_deepest(spark: SparkSession, folder: str) -> DataFrame:
    return ma.deepest(_pairs(spark, folder)).select("dip_id", "candidate_id")


def match_nearest_start(spark: SparkSession, folder: str) -> DataFrame:
    return ma.nearest_start(_pairs(spark, folder)).select("dip_id", "candidate_id")


def match_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    return ma.one_to_one(_pairs(spark, folder)).select("dip_id", "candidate_id", F.round("offset", 6).alias("offset"))


def match_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Every dip with a time, recovered or missed, per mission."""
    dips = table(spark, folder, "known_dips").where("t_min_bkjd IS NOT NULL AND NOT isnan(t_min_bkjd)").select("dip_id", "mission").distinct()
    hit = ma.one_to_one(_pairs(spark, folder)).select("dip_id", F.lit(1).alias("hit"))
    return dips.join(hit, "dip_id", "left").groupBy("mission").agg(F.count("*").alias("n_dips"), F.count("hit").alias("n_recovered"))


def best_cross_match(spark: SparkSession, folder: str) -> DataFrame:
    return ma.best_cross_match(table(spark, folder, "tic_catalog"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "tic_catalog")
    names = table(spark, folder, "validation_targets").select(designation(F.col("target_id")).alias("designation")).distinct()
    stars = star_keys(names, catalog_links(catalog)).select("star").distinct()
    tics = catalog.where("tic_id IS NOT NULL").select("tic_id", F.explode(F.array(F.concat(F.lit("TIC "), F.col("tic_id").cast("string")), F.concat(F.lit("KIC "), F.col("kic").cast("string")))).alias("star"))
    return tics.join(stars, "star").select("tic_id").distinct()


def match_control(spark: SparkSession, folder: str) -> DataFrame:
    c = ma.control_stars(_targets(spark, folder), table(spark, folder, "tic_catalog"))
    return c.select("tic_id", "control_id", "radius", F.round("dmag", 6).alias("dmag"), F.round("sep", 7).alias("sep"))


def cone_search(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue stars within 5 degrees of each target star."""
    stars = ma.stars_of(table(spark, folder, "tic_catalog")).where("ra_deg IS NOT NULL AND dec_deg IS NOT NULL")
    centers = stars.join(_targets(spark, folder), "tic_id").select(F.col("tic_id").alias("target"), F.col("ra_deg").alias("c_ra"), F.col("dec_deg").alias("c_dec"))
    return ma.within_radius(centers, stars, 5.0).groupBy("target").agg(F.count("*").alias("n_stars"), F.round(F.max("sep"), 7).alias("farthest"))


def catalog_stars(spark: SparkSession, folder: str) -> DataFrame:
    """One row per TIC star with its distance and its place in sexagesimal text."""
    s = ma.stars_of(table(spark, folder, "tic_catalog"))
    ra, dec = text.sexagesimal(F.col("ra_deg"), True), text.sexagesimal(F.col("dec_deg"), False)
    return s.select("tic_id", F.round(ma.distance_pc(F.col("plx")), 6).alias("distance_pc"), F.round(text.angle(ra, True), 3).alias("ra"), F.round(text.angle(dec, False), 3).alias("dec"))


def completeness_by_depth(spark: SparkSession, folder: str) -> DataFrame:
    c = cal.completeness(cal.label_outcomes(table(spark, folder, "training_labels")))
    return c.select(F.round(F.col("depth") * 1e6, 3).alias("depth_ppm"), "n", F.round("detected", 9).alias("detected"), F.round("flagged", 9).alias("flagged"))


def detection_floor(spark: SparkSession, folder: str) -> DataFrame:
    c = cal.completeness(cal.label_outcomes(table(spark, folder, "training_labels")))
    return cal.detection_floor(c, 0.25).select(F.round(F.col("floor") * 1e6, 3).alias("floor_ppm"))


def fpr_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The value of delta_bic that one in a hundred rows of each class exceeds."""
    rows = table(spark, folder, "training_labels").where("label IS NOT NULL").select("label", finite(F.col("delta_bic")).alias("v"))
    return exact_quantile(rows, "label", "v", 0.99, "threshold").select("label", F.round("threshold", 6).alias("threshold"))


def host_vetting(spark: SparkSession, folder: str) -> DataFrame:
    """Stars with a candidate deeper than 3000 ppm or with more than 15; stars of the light curves without any count as quiet."""
    c = table(spark, folder, "candidates").groupBy("candidate_id").agg(F.max(F.struct("found_at", "target_id", "depth_ppm")).alias("c")).select(designation(F.col("c.target_id")).alias("star"), known(F.col("c.depth_ppm")).alias("depth"))
    counts = c.where("star IS NOT NULL").groupBy("star").agg(F.max("depth").alias("deepest"), F.count("*").alias("n"))
    hosts = table(spark, folder, "light_curves").select(designation(F.col("target_id")).alias("star")).distinct().union(c.select("star").where("star IS NOT NULL").distinct()).distinct()
    out = hosts.join(counts, "star", "left").select("star", F.coalesce("deepest", F.lit(0.0)).alias("deepest"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("suspect", (F.col("deepest") > 3000) | (F.col("n") > 15))


def candidates_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates, flagged ones and the strongest per mission and status."""
    c = table(spark, folder, "candidates").groupBy("candidate_id").agg(F.max(F.struct("found_at", "mission", "vetting_status", "flagged", "significance")).alias("c")).select("c.*")
    return c.groupBy("mission", "vetting_status").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"), F.max(finite(F.col("significance"))).alias("strongest"))


def a_dur_histogram(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidates").where("a_dur IS NOT NULL AND NOT isnan(a_dur)")
    return c.groupBy(F.expr("width_bucket(a_dur, -1.0D, 1.0D, 40)").alias("bin")).agg(F.count("*").alias("n"))


def flag_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The flag rule applied again to the stored statistics."""
    c = table(spark, folder, "candidates")
    return c.select("candidate_id", "found_at", flagged(F.col("delta_bic"), F.col("tau_over_sigma")).alias("again")).groupBy("candidate_id").agg(F.max("again").alias("again"), F.count("*").alias("n"))


def dedup_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cal.clean_labels(table(spark, folder, "training_labels")).select("label_id", "host_star", "label")


def least_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows per target of the validation list, for working on the least covered first."""
    hosts = table(spark, folder, "validation_targets").where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("host_star")).agg(F.min("target_no").alias("place"))
    return cal.coverage(hosts, table(spark, folder, "training_labels"))


def hold_out_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows per split whose host is a star of the validation list, which must not be trained on."""
    catalog = table(spark, folder, "tic_catalog")
    links = catalog_links(catalog)
    held = star_keys(table(spark, folder, "validation_targets").select(designation(F.col("target_id")).alias("designation")).distinct(), links).select("star").distinct()
    labels = table(spark, folder, "training_labels").groupBy("split", designation(F.col("host_star")).alias("designation")).agg(F.count("*").alias("n"))
    names = star_keys(labels.select("designation").distinct(), links).join(held, "star", "left_semi").select("designation").distinct()
    return labels.join(names, "designation").groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_hosts"))


def ratio_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Measured over injected depth, per label."""
    rows = table(spark, folder, "training_labels").where("label IS NOT NULL")
    injected = finite(F.col("injected_depth"))
    r = cal.ratio_summary(rows, "label", finite(F.col("depth_ppm")) / F.when(injected > 0, injected * 1e6))
    return r.select("label", "n", F.round("spread", 6).alias("spread"), F.round("median", 6).alias("median"))


def impute_features(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of the 38 inputs of the classifier: imputed features and what was measured."""
    from pyspark.ml.functions import vector_to_array

    x = tr.imputed(table(spark, folder, "training_labels")).select(F.posexplode(vector_to_array("x")).alias("k", "v"))
    return x.groupBy("k").agg(F.round(F.sum("v"), 3).alias("total"))


def train_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold scores of labelled rows by a forest of 200 trees, and whether they exceed the threshold for 1 % false positives."""
    scored, threshold = tr.out_of_fold(table(spark, folder, "training_labels"), table(spark, folder, "tic_catalog"))
    return scored.select("label_id", "label", "score", "calibrated", (F.col("score") >= threshold).alias("accepted"))


def classifier_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """By injected depth, the part of the dips that the classifier takes for dips."""
    return tr.completeness_by_depth(*tr.out_of_fold(table(spark, folder, "training_labels"), table(spark, folder, "tic_catalog")))


def classifier_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows and folds of each star that the classifier is trained on."""
    return tr.folded(table(spark, folder, "training_labels"), table(spark, folder, "tic_catalog")).groupBy("star").agg(F.count("*").alias("n_rows"), F.countDistinct("fold").alias("n_folds"))


def backtest_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Stored candidates scored by a forest over all labelled rows; features that candidates don't have take the training medians."""
    labels, c = table(spark, folder, "training_labels"), table(spark, folder, "candidates")
    latest = c.groupBy("candidate_id").agg(F.max(F.struct("found_at", *(x for x in c.columns if x not in ("candidate_id", "found_at")))).alias("c")).select("candidate_id", "c.*")
    made = {"log_depth_ppm": tr.safe_log(F.col("depth_ppm")), "abs_a_dur": F.abs("a_dur"), "log_tau_over_sigma": tr.safe_log(F.col("tau_over_sigma"))}
    features = latest.select("candidate_id", *(made.get(f, F.col(f) if f in c.columns else F.lit(None)).cast("double").alias(f) for f in tr.FEATURES))
    model, medians = tr.train(labels)
    return tr.backtest(model, features, medians, 0.5).select("candidate_id", "score", "accepted")


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows without those of stars of the validation list."""
    labels, held, catalog = (table(spark, folder, t) for t in ("training_labels", "validation_targets", "tic_catalog"))
    return without_held_out(labels, held.select("target_id"), catalog).select("label_id", "host_star", "label")


def slugify(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "candidates").select("target_id").distinct()
    return names.select("target_id", text.slug(F.col("target_id")).alias("slug"), text.file_name(F.col("target_id")).alias("file"), text.kic_number(F.col("target_id")).alias("kic"), text.last_number(F.col("target_id")).alias("last"))


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an attempt on its user: an error is a failed one, all else succeeded."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").cast("string").alias("target_id"), F.lit("Kepler").alias("mission"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_utc"), F.col("event_id").alias("seq"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts in order of time, counted from the last success."""
    return le.numbered(_attempts(spark, folder))


def written_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Latest attempts from a ledger that was added to in three goes, without seq; each go writes several files, the ones of a target in order."""
    path = new_folder(spark)
    entries = _ledger(spark, folder)
    for k in range(3):
        part = entries.where(F.least(F.floor((F.col("seq") - 1) / 2), F.lit(2)) == k)
        le.append(part.repartition(3, "target_id").sortWithinPartitions("target_id", "seq").drop("seq"), path)
    return le.latest(le.read_ledger(spark, path)).select("target_id", "status", "attempt", "timestamp_utc")


def latest_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return le.latest(_ledger(spark, folder)).select("target_id", "status", "attempt", "timestamp_utc")


def next_targets(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("target_id"), F.lit("Kepler").alias("mission"), F.col("c_custkey").alias("place"))
    return le.next_targets(wanted, _ledger(spark, folder)).select("target_id", "place", "is_retry", "retry_time")


def targets_view(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts with the orders of a customer as results, urgent ones flagged; customers with a negative balance have no results file."""
    return le.targets_view(_ledger(spark, folder), *_orders(spark, folder)).drop("mission")


def attempts_view(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts, numbered."""
    return _ledger(spark, folder).select("target_id", "status", "attempt", "timestamp_utc", "seq")


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as results, urgent ones flagged; customers without a negative balance have a results file."""
    key = lambda c: (F.col(c).cast("string").alias("target_id"), F.lit("Kepler").alias("mission"))
    results = table(spark, folder, "orders").select(*key("o_custkey"), "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("flagged"))
    return results, table(spark, folder, "customer").where("c_acctbal >= 0").select(*key("c_custkey"))


def candidates_view(spark: SparkSession, folder: str) -> DataFrame:
    return le.candidates_view(_ledger(spark, folder), *_orders(spark, folder)).select("target_id", "o_orderkey", "flagged")


def united_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of the validation list, then those of the published dips."""
    name = lambda t, place: table(spark, folder, t).where("target_id IS NOT NULL").select("target_id", F.col(place).cast("bigint").alias("place"))
    return le.united(name("validation_targets", "target_no"), name("known_dips", "dip_id"))


def first_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200 targets of the work queue, the share of one run."""
    return next_targets(spark, folder).orderBy("is_retry", "retry_time", "place").limit(200)


def monitor_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows that the rule flags, as additions to the list of a watch."""
    rows = table(spark, folder, "training_labels").withColumn("flagged", flagged(F.col("delta_bic"), F.col("tau_over_sigma")))
    f = F.col("features")
    return tr.found_rows(rows, "2022-12-01 00:00:00").select("label_id", "found_utc", F.size(f).alias("n_features"), F.size(F.map_filter(f, lambda _, v: v.isNotNull())).alias("n_known"), f["delta_bic"].alias("delta_bic"))


def newest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 attempts that are newest, a page of the list of runs."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


def export_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged candidates as rows of an export: each target with the source of its data behind it."""
    c = table(spark, folder, "candidates").where("flagged").groupBy("candidate_id").agg(F.max(F.struct("found_at", "target_id", "mission", "t_min", "depth_ppm")).alias("c"))
    return c.select("candidate_id", F.concat(F.coalesce("c.target_id", F.lit("unknown")), F.lit(" ["), "c.mission", F.lit("]")).alias("target"), known(F.col("c.t_min")).alias("t_min"), known(F.col("c.depth_ppm")).alias("depth_ppm"))


def fresh_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched documents per source that are no older than 14 days on the first of December 2022."""
    d = le.fresh(table(spark, folder, "documents"), "2022-12-01 00:00:00", 14.0)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.max("fetched_at").cast("date").cast("string").alias("last_day"))


def new_products(spark: SparkSession, folder: str) -> DataFrame:
    """Series of light curves that a ledger of the first half of the quarters doesn't have yet."""
    lc = table(spark, folder, "light_curves")
    n = lambda df: df.groupBy("target_id", "mission").agg(F.countDistinct("quarter_no").alias("n_products"))
    return le.new_products(n(lc.where("quarter_no % 2 = 0")), n(lc))


_NAME = r"CASE WHEN regexp_matches(upper({0}), '^[\s_\-]*(KIC|EPIC|TIC)[\s_\-]*0*([0-9]+)[\s_\-]*$') THEN regexp_extract(upper({0}), '^[\s_\-]*(KIC|EPIC|TIC)[\s_\-]*0*([0-9]+)[\s_\-]*$', 1) || ' ' || regexp_extract(upper({0}), '^[\s_\-]*(KIC|EPIC|TIC)[\s_\-]*0*([0-9]+)[\s_\-]*$', 2) END"
_NAME_OR = "coalesce(" + _NAME + ", {0})"
_LINK = "link AS (SELECT DISTINCT 'TIC ' || tic_id AS name, 'KIC ' || kic AS star FROM tic_catalog WHERE tic_id IS NOT NULL AND kic IS NOT NULL)"
_LATEST = "cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY found_at DESC) AS rn FROM candidates) WHERE rn = 1)"
_MATCH = f"""
WITH {_LINK}, {_LATEST},
d0 AS (SELECT DISTINCT dip_id, {_NAME.format("target_id")} AS name, t_min_bkjd AS dt FROM known_dips WHERE isfinite(t_min_bkjd)),
c0 AS (SELECT candidate_id, {_NAME.format("target_id")} AS name, t_min + CASE upper(trim(mission)) WHEN 'TESS' THEN 2167 WHEN 'KEPLER' THEN 0 WHEN 'K2' THEN 0 END AS t, CASE WHEN NOT isnan(depth_ppm) THEN depth_ppm END AS depth, CASE WHEN NOT isnan(significance) THEN significance END AS sig, CASE WHEN NOT isnan(duration_days) THEN duration_days END AS dur FROM cand WHERE isfinite(t_min)),
d AS (SELECT dip_id, dt, coalesce(star, d0.name) AS star FROM d0 LEFT JOIN link ON d0.name = link.name WHERE d0.name IS NOT NULL),
c AS (SELECT c0.*, coalesce(star, c0.name) AS star FROM c0 LEFT JOIN link ON c0.name = link.name WHERE c0.name IS NOT NULL),
pairs AS (SELECT DISTINCT dip_id, candidate_id, dt, t, round(abs(dt - t), 9) AS off, depth, sig, dur FROM d JOIN c ON d.star = c.star WHERE round(abs(dt - t), 9) <= 0.5)"""


#: All pairs in order, each with what is taken before it.
_GREEDY = f"""{_MATCH.replace("WITH", "WITH RECURSIVE", 1)},
o AS (SELECT dip_id, candidate_id, off, row_number() OVER (ORDER BY off, dip_id, candidate_id) AS k FROM pairs),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS dip_id, NULL::BIGINT AS candidate_id, NULL::DOUBLE AS off, false AS free, []::BIGINT[] AS ds, []::BIGINT[] AS cs
UNION ALL SELECT o.k, o.dip_id, o.candidate_id, o.off, NOT (list_contains(ds, o.dip_id) OR list_contains(cs, o.candidate_id)), CASE WHEN list_contains(ds, o.dip_id) OR list_contains(cs, o.candidate_id) THEN ds ELSE list_append(ds, o.dip_id) END,
  CASE WHEN list_contains(ds, o.dip_id) OR list_contains(cs, o.candidate_id) THEN cs ELSE list_append(cs, o.candidate_id) END FROM g JOIN o ON o.k = g.k + 1)"""


def _first(order: str) -> str:
    return f"{_MATCH} SELECT dip_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY dip_id ORDER BY {order}, t, candidate_id) AS k FROM pairs) WHERE k = 1"


_STAR = "star AS (SELECT tic_id, min(ra_deg) FILTER (NOT isnan(ra_deg)) AS ra_deg, min(dec_deg) FILTER (NOT isnan(dec_deg)) AS dec_deg, min(tmag) FILTER (NOT isnan(tmag)) AS tmag, min(plx) FILTER (NOT isnan(plx)) AS plx, min(kic) AS kic, min(dst_arcsec) FILTER (NOT isnan(dst_arcsec)) AS dst FROM tic_catalog WHERE tic_id IS NOT NULL GROUP BY 1)"
_WANTED = f"""WITH {_LINK}, {_STAR},
v AS (SELECT DISTINCT coalesce(link.star, n.name) AS star FROM (SELECT {_NAME.format("target_id")} AS name FROM validation_targets) n LEFT JOIN link ON n.name = link.name WHERE n.name IS NOT NULL),
want AS (SELECT DISTINCT tic_id FROM tic_catalog t, v WHERE v.star = 'TIC ' || tic_id OR v.star = 'KIC ' || kic),
sep AS (SELECT a.tic_id AS target, b.tic_id AS other, a.tmag AS m1, b.tmag AS m2, CASE WHEN a.plx > 0 THEN 1000 / a.plx END AS d1, CASE WHEN b.plx > 0 THEN 1000 / b.plx END AS d2,
  degrees(2 * asin(least(1, sqrt(pow(sin((radians(b.dec_deg) - radians(a.dec_deg)) / 2), 2) + cos(radians(a.dec_deg)) * cos(radians(b.dec_deg)) * pow(sin(radians(b.ra_deg - a.ra_deg) / 2), 2))))) AS sep FROM star a, star b WHERE a.tic_id IN (SELECT tic_id FROM want))"""
_OUTCOMES = "o AS (SELECT injected_depth AS depth, isfinite(depth_ppm) IS TRUE AS det, (isfinite(delta_bic) AND isfinite(tau_over_sigma) AND delta_bic > 10 AND tau_over_sigma > 1) IS TRUE AS flg FROM training_labels WHERE label = 'comet' AND isfinite(injected_depth)), by_depth AS (SELECT depth, count(*) AS n, avg(det::INT) AS detected, avg(flg::INT) AS flagged FROM o GROUP BY 1)"
_ATTEMPTS = """
WITH e AS (SELECT user_id::VARCHAR AS target_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp_utc, event_id FROM events),
e1 AS (SELECT *, coalesce(sum((status = 'success')::INT) OVER (PARTITION BY target_id ORDER BY timestamp_utc, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM e),
led AS (SELECT target_id, status, timestamp_utc, (row_number() OVER (PARTITION BY target_id, wins ORDER BY timestamp_utc, event_id))::INT AS attempt, row_number() OVER (PARTITION BY target_id ORDER BY timestamp_utc DESC, event_id DESC) AS back FROM e1),
last AS (SELECT * FROM led WHERE back = 1)"""
_MEDIANS = ", ".join(f"(SELECT coalesce(median({f}) FILTER (isfinite({f})), 0) FROM training_labels) AS m_{f}" for f in tr.FEATURES)
_SUMS = " UNION ALL ".join([f"SELECT {k} AS k, round(sum(CASE WHEN isfinite({f}) THEN {f} ELSE m_{f} END), 3) AS total FROM training_labels, md" for k, f in enumerate(tr.FEATURES)] + [f"SELECT {k + len(tr.FEATURES)} AS k, round(sum(CASE WHEN isfinite({f}) THEN 1.0 ELSE 0.0 END), 3) AS total FROM training_labels" for k, f in enumerate(tr.FEATURES)])

QUERIES = {f.__name__: f for f in (match_all, match_max_significance, match_deepest, match_nearest_start, match_one_to_one, match_truth, best_cross_match, match_control, cone_search, catalog_stars, completeness_by_depth, detection_floor, fpr_threshold, host_vetting, candidates_summary, a_dur_histogram, flag_rule, dedup_labels, least_covered, hold_out_guard, ratio_summary, impute_features, train_classifier, classifier_completeness, classifier_folds, backtest_candidates, training_rows, slugify, latest_attempts, written_ledger, next_targets, targets_view, attempts_view, candidates_view, united_lists, first_targets, monitor_rows, newest_runs, export_rows, fresh_cache, new_products)}
SQL = {
    "match_all": f"{_MATCH} SELECT dip_id, candidate_id, round(off, 6) AS \"offset\" FROM pairs",
    "match_max_significance": _first("-coalesce(sig, '-inf'::DOUBLE)"),
    "match_deepest": _first("-coalesce(depth, '-inf'::DOUBLE)"),
    "match_nearest_start": _first("round(abs(t - coalesce(dur, 0) / 2 - dt), 9)"),
    "best_cross_match": f"WITH {_STAR} SELECT kic, tic_id, dst AS dst_arcsec FROM (SELECT *, row_number() OVER (PARTITION BY kic ORDER BY coalesce(dst, 0), tic_id) AS k FROM star WHERE kic IS NOT NULL) WHERE k = 1",
    "match_control": f"""{_WANTED},
k AS (SELECT *, round(abs(m2 - m1), 9) AS dmag, CASE WHEN sep <= 1 THEN 1.0 WHEN sep <= 3 THEN 3.0 WHEN sep <= 8 THEN 8.0 ELSE 15.0 END AS radius FROM sep WHERE sep <= 15 AND other NOT IN (SELECT tic_id FROM want) AND coalesce(abs(d2 - d1) <= 0.3 * d1, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY radius, dmag, sep, other) AS n FROM k WHERE dmag <= 0.5)
SELECT target AS tic_id, other AS control_id, radius::DOUBLE AS radius, round(dmag, 6) AS dmag, round(sep, 7) AS sep FROM r WHERE n = 1""",
    "cone_search": f"{_WANTED} SELECT target, count(*) AS n_stars, round(max(sep), 7) AS farthest FROM sep WHERE sep <= 5 GROUP BY 1",
    "catalog_stars": f"WITH {_STAR} SELECT tic_id, round(CASE WHEN plx > 0 THEN 1000 / plx END, 6) AS distance_pc, round(round_even(ra_deg / 15 * 360000, 0) / 360000 * 15, 3) AS ra, round(sign(dec_deg) * round_even(abs(dec_deg) * 36000, 0) / 36000, 3) AS dec FROM star",
    "completeness_by_depth": f"WITH {_OUTCOMES} SELECT round(depth * 1e6, 3) AS depth_ppm, n, round(detected, 9) AS detected, round(flagged, 9) AS flagged FROM by_depth",
    "detection_floor": f"WITH {_OUTCOMES} SELECT round(min(depth) FILTER (flagged >= 0.25) * 1e6, 3) AS floor_ppm FROM by_depth",
    "fpr_threshold": "SELECT label, round(quantile_cont(delta_bic, 0.99) FILTER (isfinite(delta_bic)), 6) AS threshold FROM training_labels WHERE label IS NOT NULL GROUP BY 1",
    "host_vetting": f"""WITH {_LATEST}, c AS (SELECT {_NAME.format("target_id")} AS star, CASE WHEN NOT isnan(depth_ppm) THEN depth_ppm END AS depth FROM cand), n AS (SELECT star, coalesce(max(depth), 0) AS deepest, count(*) AS n FROM c WHERE star IS NOT NULL GROUP BY 1),
h AS (SELECT {_NAME.format("target_id")} AS star FROM light_curves UNION SELECT star FROM n) SELECT h.star, coalesce(deepest, 0) AS deepest, coalesce(n, 0) AS n, coalesce(deepest, 0) > 3000 OR coalesce(n, 0) > 15 AS suspect FROM h LEFT JOIN n ON h.star = n.star""",
    "candidates_summary": f"WITH {_LATEST} SELECT mission, vetting_status, count(*) AS n, count(*) FILTER (flagged) AS n_flagged, max(significance) FILTER (isfinite(significance)) AS strongest FROM cand GROUP BY ALL",
    "a_dur_histogram": "SELECT CASE WHEN a_dur < -1 THEN 0 WHEN a_dur >= 1 THEN 41 ELSE floor((a_dur + 1) / 2 * 40)::BIGINT + 1 END AS bin, count(*) AS n FROM candidates WHERE NOT isnan(a_dur) GROUP BY 1",
    "flag_rule": "SELECT candidate_id, bool_or((isfinite(delta_bic) AND isfinite(tau_over_sigma) AND delta_bic > 10 AND tau_over_sigma > 1) IS TRUE) AS again, count(*) AS n FROM candidates GROUP BY 1",
    "dedup_labels": "SELECT min(label_id) AS label_id, host_star, label FROM training_labels WHERE host_star <> '' AND (coalesce(label, '') NOT IN ('comet', 'symmetric', 'reversed', 'flare', 'starspot') OR (isfinite(injected_depth) AND injected_depth > 0)) GROUP BY host_star, label, seed, CASE WHEN NOT isnan(injected_depth) THEN injected_depth END, CASE WHEN NOT isnan(depth_ppm) THEN depth_ppm END",
    "least_covered": "SELECT v.target_id AS host_star, min(target_no) AS place, any_value(coalesce(n, 0)) AS n_rows FROM validation_targets v LEFT JOIN (SELECT " + _NAME_OR.format("host_star") + " AS name, count(*) AS n FROM training_labels GROUP BY 1) t ON t.name = " + _NAME_OR.format("v.target_id") + " WHERE target_id IS NOT NULL GROUP BY 1",
    "hold_out_guard": f"""WITH {_LINK}, h AS (SELECT DISTINCT coalesce(star, n.name) AS star FROM (SELECT {_NAME.format("target_id")} AS name FROM validation_targets) n LEFT JOIN link ON n.name = link.name WHERE n.name IS NOT NULL),
l AS (SELECT split, {_NAME.format("host_star")} AS name, count(*) AS n FROM training_labels GROUP BY ALL) SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_hosts FROM l WHERE name IN (SELECT star FROM h) OR name IN (SELECT name FROM link WHERE star IN (SELECT star FROM h)) GROUP BY 1""",
    "classifier_folds": f"WITH {_LINK}, s AS (SELECT coalesce(min(star), any_value(n.name), any_value(host_star)) AS star FROM (SELECT label_id, host_star, {_NAME.format('host_star')} AS name FROM training_labels WHERE label IS NOT NULL AND host_star <> '') n LEFT JOIN link ON n.name = link.name GROUP BY label_id) SELECT star, count(*) AS n_rows, 1::BIGINT AS n_folds FROM s GROUP BY 1",
    "training_rows": f"""WITH {_LINK}, h AS (SELECT DISTINCT coalesce(star, n.name) AS star FROM (SELECT {_NAME.format("target_id")} AS name FROM validation_targets) n LEFT JOIN link ON n.name = link.name WHERE n.name IS NOT NULL),
l AS (SELECT label_id, host_star, label, {_NAME.format("host_star")} AS name FROM training_labels) SELECT label_id, host_star, label FROM l WHERE name IS NULL OR NOT (name IN (SELECT star FROM h) OR name IN (SELECT name FROM link WHERE star IN (SELECT star FROM h)))""",
    "match_one_to_one": f"{_GREEDY} SELECT dip_id, candidate_id, round(off, 6) AS \"offset\" FROM g WHERE free",
    "match_truth": f"{_GREEDY}, w AS (SELECT DISTINCT dip_id, mission FROM known_dips WHERE NOT isnan(t_min_bkjd)) SELECT mission, count(*) AS n_dips, count(g.dip_id) AS n_recovered FROM w LEFT JOIN (SELECT DISTINCT dip_id FROM g WHERE free) g ON w.dip_id = g.dip_id GROUP BY 1",
    "ratio_summary": "WITH r AS (SELECT label, depth_ppm / (injected_depth * 1e6) AS ratio FROM training_labels WHERE label IS NOT NULL AND isfinite(depth_ppm) AND isfinite(injected_depth) AND injected_depth > 0) SELECT label, count(*) AS n, round(stddev_pop(ratio), 6) AS spread, round(median(ratio), 6) AS median FROM r GROUP BY 1",
    "impute_features": f"WITH md AS (SELECT {_MEDIANS}) SELECT * FROM ({_SUMS})",
    "slugify": r"SELECT DISTINCT target_id, coalesce(nullif(regexp_replace(regexp_replace(lower(target_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'target') AS slug, translate(target_id, ' /\', '___') AS file, TRY_CAST(nullif(regexp_extract(target_id, '(?i)^\s*kic\s*(\d+)\s*$', 1), '') AS BIGINT) AS kic, TRY_CAST(nullif(regexp_extract(target_id, '(\d+)\s*$', 1), '') AS INT) AS last FROM candidates",
    "latest_attempts": f"{_ATTEMPTS} SELECT target_id, status, attempt, timestamp_utc FROM last",
    "written_ledger": f"{_ATTEMPTS} SELECT target_id, status, attempt, timestamp_utc FROM last",
    "next_targets": f"{_ATTEMPTS} SELECT c_custkey::VARCHAR AS target_id, c_custkey AS place, status IS NOT NULL AS is_retry, timestamp_utc AS retry_time FROM customer LEFT JOIN last ON last.target_id = c_custkey::VARCHAR WHERE status IS NULL OR (status = 'failed' AND attempt < 3)",
    "targets_view": f"{_ATTEMPTS}, c AS (SELECT o_custkey::VARCHAR AS target_id, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS f FROM orders GROUP BY 1), h AS (SELECT c_custkey::VARCHAR AS target_id FROM customer WHERE c_acctbal >= 0) SELECT last.target_id, status, attempt, CASE WHEN h.target_id IS NOT NULL THEN coalesce(n, 0) END AS n_candidates, CASE WHEN h.target_id IS NOT NULL THEN coalesce(f, 0) END AS n_flagged, CASE WHEN status = 'failed' THEN greatest(3 - attempt, 0) END AS retries_left FROM last LEFT JOIN c ON last.target_id = c.target_id LEFT JOIN h ON last.target_id = h.target_id",
    "attempts_view": f"{_ATTEMPTS}, s AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY back DESC) AS seq FROM led) SELECT target_id, status, attempt, timestamp_utc, seq FROM s",
    "candidates_view": f"{_ATTEMPTS} SELECT o_custkey::VARCHAR AS target_id, o_orderkey, o_orderpriority = '1-URGENT' AS flagged FROM orders WHERE o_custkey::VARCHAR IN (SELECT target_id FROM last) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "united_lists": "WITH a AS (SELECT target_id, 0 AS list, target_no::BIGINT AS place FROM validation_targets UNION ALL SELECT target_id, 1, dip_id::BIGINT FROM known_dips) SELECT target_id, list, place FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY list, place) AS k FROM a WHERE target_id IS NOT NULL) WHERE k = 1",
    "first_targets": f"{_ATTEMPTS} SELECT c_custkey::VARCHAR AS target_id, c_custkey AS place, status IS NOT NULL AS is_retry, timestamp_utc AS retry_time FROM customer LEFT JOIN last ON last.target_id = c_custkey::VARCHAR WHERE status IS NULL OR (status = 'failed' AND attempt < 3) ORDER BY is_retry, retry_time NULLS FIRST, place LIMIT 200",
    "monitor_rows": "SELECT label_id, '2022-12-01T00:00:00' AS found_utc, 19::INT AS n_features, (" + " + ".join(f"(isfinite({f}::DOUBLE) IS TRUE)::INT" for f in tr.FEATURES) + ")::INT AS n_known, delta_bic FROM training_labels WHERE isfinite(delta_bic) AND isfinite(tau_over_sigma) AND delta_bic > 10 AND tau_over_sigma > 1",
    "newest_runs": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "export_rows": "SELECT candidate_id, coalesce(target_id, 'unknown') || ' [' || mission || ']' AS target, CASE WHEN NOT isnan(t_min) THEN t_min END AS t_min, CASE WHEN NOT isnan(depth_ppm) THEN depth_ppm END AS depth_ppm FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY found_at DESC) AS k FROM candidates WHERE flagged) WHERE k = 1",
    "fresh_cache": "SELECT source, count(*) AS n, strftime(max(fetched_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS last_day FROM documents WHERE fetched_at >= TIMESTAMPTZ '2022-12-01 00:00:00+00' - INTERVAL 14 DAY GROUP BY 1",
    "new_products": "WITH a AS (SELECT target_id, mission, count(DISTINCT quarter_no) AS n_products, count(DISTINCT quarter_no) FILTER (quarter_no % 2 = 0) AS n_known FROM light_curves GROUP BY ALL) SELECT target_id, mission, n_known, n_products FROM a WHERE n_known < n_products",
}
