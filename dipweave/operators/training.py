"""Features of events and the classifier over labelled rows."""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..sources.shared import kept
from .hold_out import with_star
from .medians import exact_median, exact_quantile
from .series import MAD_TO_SIGMA

#: The features in their order, on which a stored model depends.
FEATURES = (
    "depth_ppm", "log_depth_ppm", "duration_days", "depth_snr", "a_dur", "a_slope", "abs_a_dur", "signs_agree", "tau_over_sigma", "log_tau_over_sigma",
    "delta_bic", "significance", "a_dur_sigma", "ingress_duration_days", "egress_duration_days", "ingress_slope_snr", "egress_slope_snr", "n_points_in_window", "periodic",
)


def safe_log(x: Column) -> Column:
    return F.when(finite(x) > 0, F.log(x))


def noise_of(rows: DataFrame) -> DataFrame:
    """(series, _mad): the median distance of the readings of a series from their median."""
    middle = exact_median(rows, "series", "flux", "_m")
    apart = rows.join(rows.select("series", "block").distinct().join(middle, "series"), ["series", "block"]).select("series", F.abs(F.col("flux") - F.col("_m")).alias("r"))
    return exact_median(apart, "series", "r", "_mad")


def features(candidates: DataFrame, rows: DataFrame | None, keys: tuple[str, ...], noise: DataFrame | None = None) -> DataFrame:
    """keys, t_min and FEATURES of each candidate, with the robust noise of its series in rows; NULL is what couldn't be measured. noise: what noise_of() gives, if it is known already."""
    noise = noise_of(rows) if noise is None else noise
    snr = lambda side: F.when(F.col(f"{side}_slope_err") > 0, F.abs(F.col(f"{side}_slope")) / F.col(f"{side}_slope_err"))
    made = {
        "log_depth_ppm": safe_log(F.col("depth_ppm")), "depth_snr": F.when(F.col("_mad") > 0, F.col("depth_ppm") * 1e-6 / (MAD_TO_SIGMA * F.col("_mad"))), "abs_a_dur": F.abs("a_dur"),
        "log_tau_over_sigma": safe_log(F.col("tau_over_sigma")), "significance": finite(F.col("significance")), "ingress_slope_snr": snr("ingress"), "egress_slope_snr": snr("egress"),
    }
    joined = candidates.withColumn("_series", F.struct(*keys)).join(noise.withColumnRenamed("series", "_series"), "_series", "left")
    return joined.select(*keys, "t_min", *(made.get(f, F.col(f)).cast("double").alias(f) for f in FEATURES))


def found_rows(candidates: DataFrame, now) -> DataFrame:
    """What a watch over new data adds to its list: the flagged candidates with `features`, a map of their FEATURES (missing ones have NULL), in place of those that are no columns of a candidate, and found_utc, an ISO text."""
    entries = [x for f in FEATURES for x in (F.lit(f), finite(F.col(f).cast("double")))]
    return candidates.where("flagged").withColumns({"features": F.create_map(*entries), "found_utc": F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")})


def feature_medians(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> dict[str, float]:
    """The exact median of each feature, one number each; a feature that is never there has none."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("k"), finite(F.col(n).cast("double")).alias("v")) for n in names))).alias("e")).select("e.*")
    return {r["k"]: r["m"] for r in exact_median(long, "k", "v", "m").collect()}


def with_inputs(rows: DataFrame, medians: dict[str, float], names: tuple[str, ...] = FEATURES) -> DataFrame:
    """rows with `x`: the features with the given medians where one is missing or infinite (0 without one), followed by a 1 or 0 for each that was there."""
    filled = [F.coalesce(finite(F.col(n).cast("double")), F.lit(float(medians.get(n) or 0.0))).alias(f"_{n}") for n in names]
    there = [finite(F.col(n).cast("double")).isNotNull().cast("double").alias(f"_has_{n}") for n in names]
    wide = rows.select("*", *filled, *there)
    return VectorAssembler(inputCols=[f"_{n}" for n in names] + [f"_has_{n}" for n in names], outputCol="x").transform(wide).select(*rows.columns, "x")


def imputed(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """with_inputs by the medians of the rows themselves."""
    return with_inputs(rows, feature_medians(rows, names), names)


def forest(rows: DataFrame, trees: int, seed: int):
    """A random forest on x and y, both classes with the same total weight. Trees are at most 10 deep."""
    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    weight = F.when(F.col("y") == 1, n["n"] / (2.0 * max(n["k"] or 0, 1))).otherwise(n["n"] / (2.0 * max(n["n"] - (n["k"] or 0), 1)))
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=10, seed=seed, subsamplingRate=1.0).fit(rows.withColumn("w", weight))


def scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def folded(labels: DataFrame, catalog: DataFrame, folds: int = 5) -> DataFrame:
    """Labelled rows with star and fold: all rows of a star are in one fold, however the host is spelled. A host that is no designation is its own star; rows without a host or label go."""
    data = with_star(labels.where("label IS NOT NULL AND host_star <> ''"), catalog, "host_star", "label_id").withColumn("star", F.coalesce("star", "host_star"))
    return data.withColumn("fold", F.pmod(F.xxhash64("star"), F.lit(folds)))


def isotonic(rows: DataFrame):
    return IsotonicRegression(featuresCol="score", labelCol="y", predictionCol="calibrated").fit(rows)


def out_of_fold(labels: DataFrame, catalog: DataFrame, folds: int = 5, trees: int = 200, seed: int = 42, false_positives: float = 0.01) -> tuple[DataFrame, float]:
    """folded rows with a score from a forest that saw no row of their star, that score calibrated by isotonic regression over the scores of the other folds, and the threshold that the given part of the negative rows exceeds."""
    data = folded(labels, catalog, folds).withColumn("y", (F.col("label") == "comet").cast("double"))
    ready = kept(imputed(data).select("label_id", "host_star", "star", "label", "injected_depth", "y", "fold", "x"))
    parts = [kept(scores(forest(ready.where(F.col("fold") != k), trees, seed), ready.where(F.col("fold") == k)).drop("x")) for k in range(folds)]
    out = None
    for k, part in enumerate(parts):
        others = None
        for other in parts[:k] + parts[k + 1 :]:
            others = other if others is None else others.unionByName(other)
        done = isotonic(others).transform(part)
        out = done if out is None else out.unionByName(done)
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    return out, quantile(raw.where("y = 0"), "score", 1 - false_positives)


def completeness_by_depth(scored: DataFrame, threshold: float) -> DataFrame:
    """(injected_depth, n, recovered): of the dips injected at each depth the part whose score reaches the threshold."""
    dips = scored.where((F.col("label") == "comet") & finite(F.col("injected_depth")).isNotNull() & finite(F.col("score")).isNotNull())
    return dips.groupBy("injected_depth").agg(F.count("*").alias("n"), F.bround(F.avg((F.col("score") >= threshold).cast("double")), 3).alias("recovered"))


def train(labels: DataFrame, trees: int = 200, seed: int = 42) -> tuple:
    """The forest over all labelled rows, and the medians that stand for missing features."""
    data = labels.where("label IS NOT NULL AND host_star <> ''").withColumn("y", (F.col("label") == "comet").cast("double"))
    return forest(imputed(data), trees, seed), feature_medians(data)


def save_model(model, medians: dict[str, float], threshold: float, labels: DataFrame, path: str, manifest: str, date_utc: str, **about: float) -> None:
    """Writes the model and adds an entry to its manifest: rows, stars, medians, threshold, the training rows' fingerprint and whatever else is known of it, as JSON lines."""
    spark = labels.sparkSession
    model.write().overwrite().save(path)
    n = labels.agg(F.count("*").alias("n"), F.countDistinct("host_star").alias("hosts")).first()
    entry = {"date_utc": date_utc, "path": path, "n_rows": n["n"], "n_host_stars": n["hosts"], "training_set_hash": fingerprint(labels), "threshold": float(threshold), "medians": medians, "numbers": {k: float(v) for k, v in about.items()}}
    schema = "date_utc string, path string, n_rows bigint, n_host_stars bigint, training_set_hash string, threshold double, medians map<string,double>, numbers map<string,double>"
    spark.createDataFrame([tuple(entry[x.split()[0]] for x in schema.split(", "))], schema).write.mode("append").json(manifest)


def compare(manifest: DataFrame) -> DataFrame:
    """(name, previous, current) of the numbers of the last two entries of a manifest; NULL where one is missing."""
    last = [nth_last(manifest, "date_utc", k).select(F.explode(F.map_concat(F.create_map(F.lit("n_rows"), F.col("n_rows").cast("double"), F.lit("threshold"), F.col("threshold")), "numbers")).alias("name", name)) for k, name in ((1, "previous"), (0, "current"))]
    return last[1].join(last[0], "name", "full").select("name", "previous", "current")


def quantile(rows: DataFrame, column: str, q: float) -> float:
    """A quantile of a column by linear interpolation, 0.5 if there are no values; from counts of distinct values near it, never from all rows in one task."""
    got = exact_quantile(rows.select(F.lit(0).alias("k"), column), "k", column, q, "q").first()
    return float(got["q"]) if got else 0.5


def backtest(model, candidates: DataFrame, medians: dict[str, float], threshold: float) -> DataFrame:
    """candidates (FEATURES) with a score of the model and `accepted`; missing features take the medians of the training rows."""
    ready = with_inputs(candidates, medians)
    return scores(model, ready).drop("x").withColumn("accepted", F.col("score") >= threshold)


def fingerprint(rows: DataFrame) -> str:
    """16 digits that tell tables with other rows apart, whatever the order of rows and files."""
    r = rows.select(F.xxhash64(*rows.columns).alias("a"), F.xxhash64(F.lit(1), *rows.columns).alias("b")).agg(F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)")), F.count("*")).first()
    return hashlib.sha256(repr(tuple(r)).encode()).hexdigest()[:16]


def nth_last(manifest: DataFrame, order: str, skip: int = 0) -> DataFrame:
    """The entry of a manifest that is `skip` before the last."""
    return manifest.orderBy(F.desc(order)).offset(skip).limit(1)
