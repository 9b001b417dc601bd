"""Matching, the ledger, files and streams."""

import json
import math
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dipweave.operators import ledger as le
from dipweave.operators import matching as ma
from dipweave.operators import series as se
from dipweave.operators import training as tr
from dipweave.sources import extracts as ex
from dipweave.sources import truth
from dipweave.streaming import ingest as st


@pytest.mark.parametrize("seed", [1, 2])
def test_one_to_one(rows, seed):
    rng = random.Random(seed)
    pairs = sorted({(d, c): rng.choice([0.1, 0.2, 0.3, 0.4]) for d, c in ((rng.randint(1, 12), rng.randint(1, 12)) for _ in range(60))}.items())
    table = [(d, c, o) for (d, c), o in pairs]
    want, left, right = set(), set(), set()
    for o, d, c in sorted((o, d, c) for d, c, o in table):
        if d not in left and c not in right:
            want.add((d, c))
            left.add(d)
            right.add(c)
    assert {(r[0], r[1]) for r in ma.one_to_one(rows(table, "dip_id bigint, candidate_id bigint, offset double")).collect()} == want
    assert ma.one_to_one(rows([], "dip_id bigint, candidate_id bigint, offset double")).count() == 0


def test_best_rules(rows):
    found = rows([(1, 10, 5.0, 4.9, 0.1, 100.0, 2.0, 0.2), (1, 11, 5.0, 5.3, 0.3, 300.0, 2.0, None), (1, 12, 5.0, 5.2, 0.2, None, None, 0.4)], "dip_id bigint, candidate_id bigint, dip_time double, time double, offset double, depth_ppm double, significance double, duration_days double")
    assert [f(found).first()["candidate_id"] for f in (ma.strongest, ma.deepest, ma.nearest_start)] == [10, 11, 12]


def test_control_star(rows):
    # target, then by arcseconds on the sky: as in (8.4, 30"), (8.05, 60"), (9.5, 10"), one beyond the distance allowed, one without brightness
    a = 1 / 3600
    stars = [(1, 10.0, 20.0, 8.0, 20.0), (2, 10.0, 20 + 30 * a, 8.4, None), (3, 10.0, 20 + 60 * a, 8.05, 21.0), (4, 10.0, 20 + 10 * a, 9.5, None), (5, 10.0, 20 + 5 * a, 8.01, 1.0), (6, 10.0, 20 + 5 * a, None, None), (7, 10.0, 25.0, 8.0, None), (8, 200.0, 89.9, 5.0, None), (9, 20.0, 89.9, 5.1, None)]
    catalog = rows([(*s, None, None, None) for s in stars] + [(1, 10.0, None, math.nan, 20.0, None, None, None)], "tic_id bigint, ra_deg double, dec_deg double, tmag double, plx double, teff double, kic bigint, dst_arcsec double")
    got = {r["tic_id"]: r for r in ma.control_stars(rows([(1,), (8,), (6,), (None,)], "tic_id bigint"), catalog).collect()}
    assert got.keys() == {1, 8} and got[1]["control_id"] == 3 and got[1]["radius"] == 1.0
    assert got[8]["control_id"] == 9 and got[8]["sep"] == pytest.approx(0.2, abs=1e-3)


def test_cone_around_the_sky(rows):
    rng = random.Random(3)
    stars = [(k, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(1500)]
    centers = [(k, rng.choice([0.1, 359.9, rng.uniform(0, 360)]), rng.choice([-89.5, 88.0, rng.uniform(-90, 90)])) for k in range(40)]
    got = {(r["c"], r["s"]) for r in ma.within_radius(rows(centers, "c int, c_ra double, c_dec double"), rows(stars, "s int, ra_deg double, dec_deg double"), 8.0).collect()}

    def sep(a, b):
        (r1, d1), (r2, d2) = ((math.radians(x) for x in p) for p in (a, b))
        return math.degrees(2 * math.asin(min(1, math.sqrt(math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2))))

    assert got == {(c[0], s[0]) for c in centers for s in stars if sep(c[1:], s[1:]) <= 8}


def entry(target, status, t, attempt, **more):
    return json.dumps({"target_id": target, "mission": "Kepler", "status": status, "timestamp_utc": t, "attempt": attempt} | more)


def test_ledger_file(spark, tmp_path):
    lines = [entry("KIC 1", "success", "t1", 1), "", entry("KIC 3", "failed", "t1", 3, error="x"), '{"target_id": "KIC 9"', entry("KIC 4", "failed", "t2", 1), entry("KIC 4", "success", "t3", 2), json.dumps({"target_id": "KIC 8"}), entry("KIC 7", "success", "t1", 1, unknown=1), entry("KIC 5", "failed", "t0", 1), entry("KIC 2", "success", "t1", 1)]
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines) + '\n{"target_id": "torn')
    ledger = le.read_ledger(spark, str(tmp_path / "ledger.jsonl"))
    assert ledger.count() == 6
    state = {r["target_id"]: (r["status"], r["attempt"]) for r in le.latest(ledger).collect()}
    assert state == {"KIC 1": ("success", 1), "KIC 2": ("success", 1), "KIC 3": ("failed", 3), "KIC 4": ("success", 2), "KIC 5": ("failed", 1)}
    targets = spark.createDataFrame([("KIC 5", "Kepler", 0), ("KIC 6", "Kepler", 1), ("KIC 3", "Kepler", 2), ("KIC 0", "Kepler", 3), ("KIC 4", "Kepler", 4)], "target_id string, mission string, place int")
    queue = le.next_targets(targets, ledger).orderBy("is_retry", "retry_time", "place")
    assert [r["target_id"] for r in queue.collect()] == ["KIC 6", "KIC 0", "KIC 5"]
    results = spark.createDataFrame([("KIC 1", "Kepler", True), ("KIC 1", "Kepler", False), ("KIC 4", "Kepler", False)], "target_id string, mission string, flagged boolean")
    have = spark.createDataFrame([(f"KIC {k}", "Kepler") for k in (1, 2, 4)], "target_id string, mission string")
    view = {r["target_id"]: tuple(r)[2:] for r in le.targets_view(ledger, results, have).collect()}
    assert view == {"KIC 1": ("success", 1, 2, 1, None), "KIC 2": ("success", 1, 0, 0, None), "KIC 3": ("failed", 3, None, None, 0), "KIC 4": ("success", 2, 1, 0, None), "KIC 5": ("failed", 1, None, None, 2)}
    le.append(ledger.limit(2), str(tmp_path / "again"))
    assert le.read_ledger(spark, str(tmp_path / "again")).count() == 2


def test_ledger_of_several_files(spark, tmp_path):
    # the newer file is small and comes first by name; lines without seq are older than those with one
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "b.json").write_text("\n".join([entry("KIC X", "failed", "t1", 1)] + [entry(f"KIC {k}", "failed", "t1", 1) for k in range(500)]))
    (tmp_path / "l" / "a.json").write_text("\n".join([entry("KIC X", "success", "t2", 2), entry("KIC Y", "success", "t2", 1)]))
    (tmp_path / "l" / "c.json").write_text(entry("KIC Y", "failed", "t3", 1, seq=0))
    for name, t in (("b", 1_000_000_000), ("a", 1_000_000_100), ("c", 999_999_999)):
        os.utime(tmp_path / "l" / f"{name}.json", (t, t))
    got = {r["target_id"]: r["status"] for r in le.latest(le.read_ledger(spark, str(tmp_path / "l"))).collect()}
    assert got["KIC X"] == "success" and got["KIC Y"] == "failed" and got["KIC 7"] == "failed"


def test_shared_folder(spark):
    from dipweave.sources.shared import kept, scratch, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    with scratch(spark) as keep:
        df = keep(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and df.dtypes == spark.range(5).dtypes and os.path.exists(path)
    assert not os.path.exists(path)
    assert kept(spark.range(0)).count() == 0


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace

    from dipweave.sources.shared import shared_folder

    on = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="x", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_folder(on("spark://host:7077"))
    assert shared_folder(on("local[2]")) == shared_folder(on("local[2]"))


def test_lists_and_caches(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\nKIC 1  # note\n\n  KIC 2\nKIC 1\n#KIC 3\n")
    assert [r["target_id"] for r in le.target_list(spark, str(tmp_path / "list.txt")).orderBy("place").collect()] == ["KIC 1", "KIC 2"]
    cache = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-10 00:00:00'), (2, timestamp'2023-12-01 00:00:00'), (3, null) AS t(k, fetched_at)")
    assert [r["k"] for r in le.fresh(cache, "2024-01-20 00:00:00", 14).collect()] == [1]
    schema = "target_id string, mission string, n_products int"
    known, archive = spark.createDataFrame([("a", "M", 3), ("b", "M", 5)], schema), spark.createDataFrame([("a", "M", 4), ("b", "M", 5), ("c", "M", 1), ("d", "M", -1)], schema)
    assert {r["target_id"] for r in le.new_products(known, archive).collect()} == {"a", "c"}
    ex.save_list(cache.select(F.lit("KIC 7").alias("target_id"), F.lit("note").alias("why")).limit(1), str(tmp_path / "out"), note="why")
    assert [r["target_id"] for r in le.target_list(spark, str(tmp_path / "out")).collect()] == ["KIC 7"]


def test_extracts(spark, tmp_path):
    schema = "target_id string, mission string, quarter_no int, idx bigint, time double, flux double, flux_err double"
    a = spark.createDataFrame([("KIC 1", "Kepler", 1, 0, 1.5, 2.5, 0.1), ("TIC 2", "TESS", 3, 0, 1.0, 2.0, 0.2)], schema)
    ex.save_extract(a, str(tmp_path / "e"))
    ex.save_extract(a.where("mission = 'TESS'").withColumn("flux", F.lit(9.0)), str(tmp_path / "e"))
    assert {(r["target_id"], r["flux"]) for r in ex.load_extract(spark, str(tmp_path / "e")).collect()} == {("KIC 1", 2.5), ("TIC 2", 9.0)}
    t = pa.table({"time": [1.0, 2.0], "flux": [3.0, 4.0], "flux_err": [0.1, 0.1]}).replace_schema_metadata({"target_id": "KIC 5", "mission": "Kepler", "meta_json": '{"quarter_no": 4}'})
    pq.write_table(t, tmp_path / "one.parquet")
    got = ex.series_files(spark, str(tmp_path / "*.parquet")).orderBy("idx").collect()
    assert [(r["target_id"], r["quarter_no"], r["idx"], r["flux"]) for r in got] == [("KIC 5", 4, 0, 3.0), ("KIC 5", 4, 1, 4.0)]
    ex.save_results(a.select("target_id", "flux"), str(tmp_path / "r"))
    (tmp_path / "r" / "part-x.json").write_text('{"target_id": "x", \n')
    assert ex.load_results(spark, str(tmp_path / "r"), "target_id string, flux double").count() == 2


def test_ingest_resumes(spark, tmp_path):
    schema = "target_id string, mission string, idx bigint, flux double, received_at timestamp"
    write = lambda n: spark.sql(f"SELECT 'KIC {n}' AS target_id, 'Kepler' AS mission, id AS idx, CAST(id AS DOUBLE) AS flux, timestamp'2024-01-01 00:00:00' AS received_at FROM range({n * 10})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def process(df):
        seen.append(df.count())
        return df.where("flux > 15").select("target_id", "mission", "idx")

    def run():
        stream = st.readings_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
        st.ingest(stream, process, str(tmp_path / "res"), str(tmp_path / "led"), str(tmp_path / "state")).awaitTermination()

    write(1)
    write(2)
    run()
    write(3)
    run()
    run()
    assert sorted(seen) == [10, 20, 30]
    got = {r["target_id"]: (r["n_readings"], r["n_results"]) for r in spark.read.parquet(str(tmp_path / "led")).collect()}
    assert got == {"KIC 1": (10, 0), "KIC 2": (20, 4), "KIC 3": (30, 14)}


def test_a_target_that_fails(spark, tmp_path):
    schema = "target_id string, mission string, quarter_no int, idx bigint, flux double"
    rows = [(f"KIC {k}", "Kepler", 1, n, float(n)) for k in range(6) for n in range(5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    bad = F.when(F.col("target_id") == "KIC 3", F.raise_error(F.lit("x" * 5000))).otherwise(F.col("flux"))
    process = lambda df: df.withColumn("flux", bad).where("flux > 2").select("target_id", "mission", "idx", "flux")
    read = lambda: st.readings_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    paths = dict(ledger=str(tmp_path / "led"), checkpoint=str(tmp_path / "state"))
    wanted = spark.createDataFrame(rows + [("KIC 9", "Kepler", 1, 0, 0.0)], schema)
    assert st.run(spark, read(), process, str(tmp_path / "res"), budget_seconds=0.0, targets=wanted, **paths) == {"succeeded": 0, "failed": 0, "left": 7}
    assert st.run(spark, read(), process, str(tmp_path / "res"), targets=wanted, **paths) == {"succeeded": 5, "failed": 1, "left": 1}
    ledger = spark.read.schema(st.LEDGER).option("recursiveFileLookup", True).parquet(str(tmp_path / "led"))
    row = ledger.where("status = 'failed'").first()
    assert row["target_id"] == "KIC 3" and 0 < len(row["error"]) <= 2000 and row["n_results"] is None
    assert le.next_targets(wanted.selectExpr("target_id", "mission", "idx AS place").where("place = 0"), ledger).where("is_retry").first()["target_id"] == "KIC 3"
    assert ledger.agg(F.sum("n_results")).first()[0] == 10


def test_series_in_two_files(spark, tmp_path):
    import numpy as np

    from dipweave.operators.spikes import flag_readings

    rng = np.random.default_rng(3)
    schema = "target_id string, mission string, quarter_no int, idx bigint, time double, flux double, flux_err double"
    # the second half is ten times as noisy; what stands off is for the whole series to say
    flux = 1000 + rng.normal(size=400) * np.where(np.arange(400) < 200, 1, 10)
    flux[[50, 150]] += 30
    df = spark.createDataFrame([("KIC 1", "Kepler", 1, n, n * 0.02 + 1, float(flux[n]), 1.0) for n in range(400)], schema)
    for low, high in ((0, 200), (200, 400)):
        df.where(f"idx >= {low} AND idx < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.readings_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    p = {k: str(tmp_path / k) for k in ("results", "ledger", "checkpoint", "store")}
    st.run(spark, stream, flag_readings, p["results"], ledger=p["ledger"], checkpoint=p["checkpoint"], store=p["store"])
    want = flag_readings(df)
    got = st.latest_results(spark, p["results"], p["ledger"], p["store"], want.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_deliveries(spark, tmp_path):
    df = spark.sql("SELECT 'KIC 1' AS target_id, 'Kepler' AS mission, 1 AS quarter_no, id % 5 AS idx, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS received_at FROM range(10)")
    df.write.parquet(str(tmp_path / "in"))
    stream = st.first_deliveries(st.readings_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("first_deliveries").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["idx"] for r in spark.table("first_deliveries").collect()) == [0, 1, 2, 3, 4]


def test_attempts_are_numbered_by_blocks(rows):
    import random

    from dipweave.operators import ledger

    r = random.Random(3)
    data = [(r.choice(["a", "a", "a", "b", None]), "M", r.choice(["failed", "failed", "success"]), r.choice([None, *(f"2024-0{m}-1{d}T00" for m in range(1, 5) for d in range(5))]), n) for n in range(200)]
    want, state = [], {}
    for k, m, status, t, n in sorted(data, key=lambda x: (x[3] or "", x[4])):
        attempt, seq = state.get(k, (0, 0))
        want.append((k, m, status, t, attempt + 1, seq + 1))
        state[k] = (0 if status == "success" else attempt + 1, seq + 1)
    df = rows(data, "target_id string, mission string, status string, timestamp_utc string, seq bigint")
    for digits in (4, 7, 10):
        assert sorted(map(repr, map(tuple, ledger.numbered(df, digits).collect()))) == sorted(map(repr, want))


def test_held_out_stars_go(rows):
    from dipweave.operators.hold_out import HoldOutError, check_held_out, without_held_out

    catalog = rows([(5, 2), (6, 8)], "tic_id bigint, kic bigint")
    held = rows([("KIC 2",), ("x",), (None,), ("tic 06",)], "target_id string")
    data = [("kic_002", 0), ("KIC 22", 1), ("TIC-5", 2), (None, 3), ("EPIC 2", 4), ("KIC 8", 5), ("TIC 2", 6), ("x", 7)]
    df = rows([(k, h, f"c{k}") for h, k in data], "label_id bigint, host_star string, _extra string")
    kept_rows = without_held_out(df, held, catalog).orderBy("label_id").collect()
    assert [r["label_id"] for r in kept_rows] == [1, 3, 4, 6, 7] and kept_rows[0]["_extra"] == "c1"
    assert check_held_out(without_held_out(df, held, catalog), held, catalog).count() == 5
    with pytest.raises(HoldOutError):
        check_held_out(df, held, catalog)
    assert without_held_out(df.limit(0), held, catalog).count() == 0


def test_relations_are_rebuilt(spark, rows, tmp_path):
    key = {"target_id": "string", "mission": "string"}
    schema = ", ".join(f"{k} {v}" for k, v in key.items())
    entries = rows([("a", "M", "failed", 1, 1), ("a", "M", "success", 1, 2), ("b", "M", "failed", 4, 3), ("c", "M", "success", 1, 4)], f"{schema}, status string, attempt int, seq bigint")
    results = rows([("a", "M", 1.0, True), ("a", "M", 2.0, False), ("b", "M", 3.0, True), ("x", "M", 4.0, True)], f"{schema}, t_min double, flagged boolean")
    for processed in ([("a", "M"), ("c", "M")], [("a", "M"), ("c", "M"), ("x", "M")]):
        le.rebuild(entries, results, rows(processed, schema), str(tmp_path / "db"))
        read = lambda t: spark.read.parquet(str(tmp_path / "db" / t))
        assert read("attempts").count() == 4
        got = {r["target_id"]: (r["status"], r["n_candidates"], r["n_flagged"], r["retries_left"]) for r in read("targets").collect()}
        assert got == {"a": ("success", 2, 1, None), "b": ("failed", None, None, 0), "c": ("success", 0, 0, None)}
        assert sorted(r["t_min"] for r in read("candidates").collect()) == [1.0, 2.0]


def test_united_lists(rows):
    schema = "target_id string, place bigint"
    got = le.united(rows([("b", 1), ("a", 2), ("b", 3)], schema), rows([("c", 1), ("a", 0)], schema), rows([], schema))
    assert [r["target_id"] for r in got.orderBy("list", "place").collect()] == ["b", "a", "c"]


def test_found_rows(rows):
    flags = [(1.0, True), (None, True), (float("nan"), True), (2.0, False), (3.0, None)]
    df = rows(flags, "depth_ppm double, flagged boolean").select("*", *(F.lit(0.5).alias(f) for f in tr.FEATURES if f != "depth_ppm"))
    got = tr.found_rows(df, "2024-05-06 07:08:09").collect()
    assert [r["features"]["depth_ppm"] for r in got] == [1.0, None, None] and {r["found_utc"] for r in got} == {"2024-05-06T07:08:09"}
    assert all(r["features"].keys() == set(tr.FEATURES) for r in got) and not tr.found_rows(df.where("false"), "2024-05-06").collect()


@pytest.mark.parametrize("block", [65536, 4])
def test_time_order(rows, monkeypatch, block):
    monkeypatch.setattr(se, "BLOCK", block)
    nan = float("nan")
    times = {"up": [1.0, 2.0, None, 3.0, 4.0, 5.0], "back": [1.0, 3.0, 2.0, nan, 2.0, 1.0, 4.0], "none": [None, nan]}
    data = [(k, n, t) for k, v in times.items() for n, t in enumerate(v)] + [("up", 1, 2.0)]
    got = se.time_order(rows(data, "name string, idx bigint, time double"), ("name",)).collect()
    assert {tuple(r) for r in got} == {("up", 5, 0), ("back", 6, 3)}


def test_specification_files(tmp_path):
    (tmp_path / "a.json").write_text('{"detrend": {"polyorder": 3}}')
    assert truth.read_spec(str(tmp_path / "a.json")) == {"detrend": {"polyorder": 3}}
    for name, text in (("b.json", "[1]"), ("c.json", "{"), ("d.yaml", "- 1")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            truth.read_spec(str(tmp_path / name))
    if truth.yaml:
        (tmp_path / "e.yml").write_text("targets:\n  - target_id: KIC 1\n")
        assert truth.read_spec(str(tmp_path / "e.yml")) == {"targets": [{"target_id": "KIC 1"}]}
