"""Published dips that a run is validated against, and the gate that decides whether it passes."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hold_out import HoldOutError, check_held_out

try:
    import yaml
except ImportError:  # JSON does
    yaml = None

__all__ = ["DIPS", "HoldOutError", "first_present", "gate", "load_labels", "passed", "read_spec", "save_report", "synthetic", "truth"]

DIPS = "target_id string, mission string, expected_dip_count int, t_min_bkjd double, depth_ppm double, note string"


def truth(spark: SparkSession, spec: dict) -> tuple[DataFrame, float]:
    """One row per published dip (and one with a NULL time for a target without any), and the tolerance, from a parsed specification.

    ValueError without a positive finite match_tolerance_days or without targets: a broken specification must never pass as one with nothing to check.
    """
    tolerance = spec.get("match_tolerance_days")
    if not isinstance(tolerance, (int, float)) or not math.isfinite(tolerance) or tolerance <= 0:
        raise ValueError("match_tolerance_days must be positive and finite")
    targets = spec.get("targets")
    if not isinstance(targets, list) or not targets or any(not isinstance(t, dict) or "target_id" not in t for t in targets):
        raise ValueError("targets must be a list of mappings with a target_id, and not empty")
    rows = []
    for t in targets:
        for d in t.get("dips") or [{}]:
            at = d.get("t_min_bkjd")
            rows.append((str(t["target_id"]), t.get("mission", "Kepler"), t.get("expected_dip_count"), None if at is None else float(at), None if d.get("depth_ppm") is None else float(d["depth_ppm"]), d.get("note")))
    return spark.createDataFrame(rows, DIPS), float(tolerance)


def read_spec(path: str) -> dict:
    """A specification or configuration from a file: YAML for names that end so, where a parser for it is installed, else JSON. ValueError if it is neither or no mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        if path.endswith((".yaml", ".yml")):
            if yaml is None:
                raise ValueError("no parser for YAML is installed")
            spec = yaml.safe_load(text)
        else:
            spec = json.loads(text)
    except (json.JSONDecodeError, *((yaml.YAMLError,) if yaml else ())) as e:
        raise ValueError(f"{path}: {e}") from e
    if not isinstance(spec, dict):
        raise ValueError(f"{path} holds no mapping")
    return spec


def gate(dips: DataFrame, matched: DataFrame, strict: bool = False) -> DataFrame:
    """(target_id, n_dips, n_recovered, state) with state `passed`, `failed` or, for a target without published dips, `skipped` (`failed` if strict).

    dips: as truth() gives them; matched: (target_id, t_min_bkjd) of those recovered. The run passes if some target passed and none failed.
    """
    joined = dips.join(matched.select("target_id", "t_min_bkjd").distinct().withColumn("hit", F.lit(1)), ["target_id", "t_min_bkjd"], "left")
    per = joined.groupBy("target_id").agg(F.count("t_min_bkjd").alias("n_dips"), F.count("hit").alias("n_recovered"))
    return per.withColumn("state", F.when(F.col("n_dips") == 0, "failed" if strict else "skipped").when(F.col("n_recovered") == F.col("n_dips"), "passed").otherwise("failed"))


def passed(states: DataFrame) -> bool:
    r = states.agg(F.count_if(F.col("state") == "passed").alias("ok"), F.count_if(F.col("state") == "failed").alias("bad")).first()
    return r["ok"] > 0 and r["bad"] == 0


def save_report(states: DataFrame, path: str) -> None:
    """Writes the states of gate() as JSON lines, one per target."""
    states.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_labels(spark: SparkSession, *paths: str, held_out: tuple[str, ...] = (), catalog: DataFrame | None = None) -> DataFrame:
    """Labelled rows of all paths; HoldOutError if a host is one of those held out, in any spelling and, with a catalogue, by any of its numbers."""
    rows = spark.read.parquet(*paths)
    if not held_out:
        return rows
    links = spark.createDataFrame([], "tic_id bigint, kic bigint") if catalog is None else catalog
    return check_held_out(rows, spark.createDataFrame([(h,) for h in held_out], "name string"), links)


def first_present(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of several names that a table has a column for."""
    return next((n for n in names if n in columns), None)


def synthetic(spark: SparkSession, n: int = 4000, cadence: float = 0.02043, noise: float = 5e-5, seed: int = 42, target_id: str = "SYNTHETIC-1") -> DataFrame:
    """A flat series with Gaussian noise, made by the executors."""
    return spark.range(n).select(F.lit(target_id).alias("target_id"), F.lit("SYNTHETIC").alias("mission"), F.lit(1).alias("quarter_no"), F.col("id").alias("idx"), (F.col("id") * cadence).alias("time"), (1 + noise * F.randn(seed)).alias("flux"), F.lit(max(noise, 1e-12)).alias("flux_err"))
