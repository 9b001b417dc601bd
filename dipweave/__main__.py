"""python -m dipweave run|inject|validate: the pipeline over a Parquet table of readings. Exit codes: 0 well, 1 a failed validation, 2 a bad specification."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, from_dict
from .operators.calibration import completeness, recovery
from .operators.events import detect
from .operators.matching import one_to_one
from .operators.series import normalised
from .sources.truth import gate, passed, read_spec, save_report, truth


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dipweave", description=__doc__)
    p.add_argument("--config", help="JSON or YAML file with sections of the configuration")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="find dips and write one JSON line for each")
    inject = commands.add_parser("inject", help="inject dips and print how many come back, by depth")
    validate = commands.add_parser("validate", help="hold the dips found against published ones")
    for c in (run, inject, validate):
        c.add_argument("readings")
        c.add_argument("--detrend", choices=("savgol", "spline", "none"), default="savgol")
    run.add_argument("out")
    run.add_argument("--flagged", action="store_true", help="only flagged ones")
    inject.add_argument("--depths", type=float, nargs="+", default=[200.0, 500.0, 1000.0, 2000.0, 3000.0, 5000.0], help="in ppm")
    inject.add_argument("--per-depth", type=int, default=20)
    validate.add_argument("truth", help="JSON or YAML file with match_tolerance_days and targets")
    validate.add_argument("--strict", action="store_true", help="a target without published dips fails")
    validate.add_argument("--report", help="folder for the states as JSON lines")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    config = from_dict(read_spec(a.config)) if a.config else Config()
    spark = spark or SparkSession.builder.appName("dipweave").getOrCreate()
    readings = spark.read.parquet(a.readings)
    if a.command == "inject":
        found = recovery(normalised(readings), tuple(d * 1e-6 for d in a.depths), a.per_depth, config=config, detrend=a.detrend)
        for r in completeness(found).orderBy("depth").collect():
            print(f"{r['depth'] * 1e6:.0f} ppm: {r['detected']:.0%} detected, {r['flagged']:.0%} flagged of {r['n']}")
        return 0
    if a.command == "validate":
        try:
            dips, tolerance = truth(spark, read_spec(a.truth))
        except (ValueError, OSError) as e:
            print(e, file=sys.stderr)
            return 2
    found = detect(readings, config, a.detrend)
    if a.command == "run":
        (found.where("flagged") if a.flagged else found).write.mode("overwrite").json(a.out)
        return 0
    known = dips.where("t_min_bkjd IS NOT NULL").withColumn("dip_id", F.xxhash64("target_id", "t_min_bkjd"))
    offset = F.abs(F.col("t_min") - F.col("t_min_bkjd"))
    near = known.join(found.select("target_id", "t_min").withColumn("candidate_id", F.xxhash64("target_id", "t_min")), "target_id").withColumn("offset", offset).where(F.col("offset") <= tolerance)
    states = gate(dips, known.join(one_to_one(near.select("dip_id", "candidate_id", "offset")).select("dip_id"), "dip_id"), a.strict)
    if a.report:
        save_report(states, a.report)
    for r in states.orderBy("target_id").collect():
        print(f"{r['target_id']}: {r['state']}, {r['n_recovered']} of {r['n_dips']}")
    return 0 if passed(states) else 1


if __name__ == "__main__":
    sys.exit(main())
