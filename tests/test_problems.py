"""Problems 2, 5 and 6 against plain versions and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipweave.operators.csv_rejects import exact_reason, load_lines
from dipweave.operators.regular_grid import regular_grid
from dipweave.operators.spikes import flag_readings

SCHEMA = "target_id string, mission string, quarter_no int, idx bigint, time double, flux double, flux_err double"
GOOD = "KIC 1,Kepler,100.5,200,1,0.1,2,3,1,1,0,0,,candidate,"


def line(**changes):
    fields = dict(zip("target_id mission t_min depth_ppm d a s b t signs flagged periodic p status reasons".split(), GOOD.split(",")))
    return ",".join((fields | changes).values())


LINES = {
    GOOD: None, GOOD + "\r": None, line(t_min=" 1e3 "): None, line(t_min="+.5"): None, line(t_min='"7."'): None, line(status="Flare "): None, line(status='" FLARE"'): None, line(reasons='"a, ""b""\nc"'): None, line(d="x", p="y"): None,
    line(t_min=""): "invalid t_min", line(t_min="0"): "invalid t_min", line(t_min="-1"): "invalid t_min", line(t_min="1_000"): "invalid t_min", line(t_min="inf"): "invalid t_min", line(t_min="nan"): "invalid t_min", line(t_min="1e400"): "invalid t_min", line(t_min="0x10"): "invalid t_min", line(t_min="１２"): "invalid t_min",
    line(depth_ppm="1,5"): "wrong column count", line(depth_ppm="1..5"): "invalid depth_ppm", line(depth_ppm="1e-400"): "invalid depth_ppm", line(status="comet"): "invalid vetting_status", line(status=""): "invalid vetting_status",
    GOOD + ",": "wrong column count", GOOD[:-1]: "wrong column count", "a": "wrong column count", line(reasons='"open'): "broken quoting", line(reasons='dip 3" wide'): "broken quoting", line(reasons='so-called "comet"'): "broken quoting", line(reasons='"a "b" c"'): "broken quoting", line(reasons='"a"?'): "broken quoting", line(reasons="a\nb"): "broken quoting", line(t_min='"5'): "broken quoting", line(reasons='"a \\"b\\" c"'): "broken quoting", GOOD + "\r\r": "broken quoting",
    line(target_id='"x'): "broken quoting", line(reasons='"' + "long, " * 50_000 + '"'): None, line(reasons="x" * 300_000): None, "\x1d\x1e" + GOOD: None,
}


def test_lines(rows):
    table = rows([(n, "f", n, x, "other") for n, x in enumerate(LINES)] + [(900, "f", 900, None, ""), (901, "f", 901, "", ""), (902, "f", 902, "  \t", ""), (903, "f", 903, "\r", "")], "line_id bigint, file_name string, line_no int, raw_line string, reason string")
    got = {r["line_id"]: r for r in load_lines(table).collect()}
    assert got.keys() == set(range(len(LINES)))
    for n, (x, reason) in enumerate(LINES.items()):
        assert got[n]["reason"] == reason, x[:200]
        assert got[n]["rejected_line"] == (None if reason is None else x.removesuffix("\r"))
        if reason is None:
            assert got[n]["t_min"] > 0 and got[n]["signs_agree"] is True and got[n]["vetting_status"] in ("candidate", "flare")
    assert got[7]["vetting_reasons"] == 'a, "b"\nc' and got[8]["duration_days"] is None


def test_the_reader_says_why():
    import pyarrow as pa

    from dipweave.operators.csv_rejects import REASONS, _Reader

    texts = [GOOD, line(t_min="x"), line(depth_ppm="y"), line(t_min="x", depth_ppm="y"), "a,b", GOOD + ",1", line(reasons="note")]
    rows_, why = _Reader().read(pa.array(texts))
    assert why == {1: REASONS[2], 2: REASONS[3], 3: REASONS[2], 4: REASONS[1], 5: REASONS[1]}
    assert sorted(rows_["record_no"].to_pylist()) == [0, 6] and set(rows_["depth_ppm"].to_pylist()) == {200.0}


def test_lines_around_broken_ones_survive(rows):
    bad = [line(reasons='"open'), line(reasons='"a"b,c"d"'), line(reasons='x"'), line(status='"candidate"\'')]
    table = [(n, "f", n, bad[n % 4] if n % 3 == 0 else line(reasons=f'"note {n}\nmore"')) for n in range(400)]
    got = {r["line_id"]: r["reason"] for r in load_lines(rows(table, "line_id bigint, file_name string, line_no int, raw_line string")).collect()}
    assert got == {n: exact_reason(x) for n, _, _, x in table}
    assert sum(r is None for r in got.values()) == sum(n % 3 != 0 for n in range(400))


def test_a_surplus_column_before_a_number(rows):
    table = [(1, "f", 1, GOOD.replace("KIC 1,", "KIC 1,A,")), (2, "f", 2, line(depth_ppm="x", t_min="-1")), (3, "f", 3, line(depth_ppm="x", status="none"))]
    got = {r["line_id"]: r["reason"] for r in load_lines(rows(table, "line_id bigint, file_name string, line_no int, raw_line string")).collect()}
    assert got == {1: "wrong column count", 2: "invalid t_min", 3: "invalid depth_ppm"}


def test_surplus_numbers_are_no_end(rows):
    table = [(n, "f", n, GOOD + (",{}", ",\ue000{}", ",{},x", "")[n % 4].format(n)) for n in range(200)]
    df = rows(table, "line_id bigint, file_name string, line_no int, raw_line string").coalesce(1)
    got = {r["line_id"]: r["reason"] for r in load_lines(df).collect()}
    assert got == {n: None if n % 4 == 3 else "wrong column count" for n in range(200)}


def test_no_lines(rows):
    assert load_lines(rows([], "line_id bigint, file_name string, line_no int, raw_line string")).count() == 0


def series(n, seed, faults=True):
    rng = np.random.default_rng(seed)
    t = 100 + np.arange(n) * 0.02
    f = 1000 + 3 * np.sin(t) + rng.normal(size=n)
    e = np.full(n, 1.0)
    if faults:
        f[40] += 30
        f[60:62] -= 25
        f[80:90] = f[80]
        f[100:104] += 40  # a longer excursion
        f[110], f[111], f[112] = -1, math.inf, math.nan
        f[120:127] = f[120]  # seven equal ones are no fault
        e[5], e[6], e[7], e[8] = 11, 0, math.inf, 9
        t[30], t[31], t[32], t[33] = -5, math.nan, t[29], 50000
    return t, f, e


EXPECTED = {40, 60, 61, *range(80, 90), 110, 111, 5, 6, 7, 30, 32, 33}


def table_of(rows, *many):
    data = []
    for name, (t, f, e) in many:
        data += [(name, "Kepler", 1, n, float(t[n]), float(f[n]), float(e[n])) for n in range(len(t))]
    return rows(data, SCHEMA)


@pytest.mark.parametrize("block", [16384, 64, 17])
def test_implausible_readings(rows, block):
    df = table_of(rows, ("KIC 1", series(300, 1)), ("KIC 2", series(200, 2, False)), (None, series(300, 3)))
    doubled = df.unionByName(df.where("idx % 7 = 0")).withColumn("block", F.lit("clash")).withColumn("series", F.lit(1))
    got = {}
    for r in flag_readings(doubled, block=block).collect():
        got.setdefault(r["target_id"], []).append(r["idx"])
    assert sorted(got["KIC 1"]) == sorted(EXPECTED) and sorted(got[None]) == sorted(EXPECTED) and "KIC 2" not in got


def test_runs_and_times_over_block_borders(rows):
    t, f, e = series(120, 4, False)
    f[10:50] = f[10]
    t[61] = t[60] = t[20]
    t[62] = math.nan
    t[63] = t[20]
    df = table_of(rows, ("KIC 1", (t, f, e)))
    for block in (1000, 8, 5):
        assert sorted(r["idx"] for r in flag_readings(df, block=block).collect()) == [*range(10, 50), 61, 63]


def test_blocks_keep_noise_and_error_exact(rows):
    rng = np.random.default_rng(11)
    t, f, e = series(301, 6, False)
    e = rng.uniform(0.9, 1.1, 301)
    f[130:150] = math.nan  # a whole block without readings
    # errors and a spike a millionth on either side of what is allowed, without another middle error
    low, high = np.argsort(e)[[0, 1]], np.argsort(e)[[-1, -2]]
    e[high] = 10 * np.median(e) * np.array([1 + 1e-6, 1 - 1e-6])
    e[low] = 0.5
    flat = {n: {r["idx"] for r in flag_readings(table_of(rows, ("KIC 1", (t, f, e))), block=n).collect()} for n in (16384, 10)}
    assert flat[10] == flat[16384] == {high[0]}
    # the factor at which a spike is just passed over is the same for one block and many
    f[40] += 30
    v = np.pad(u := f[np.isfinite(f)], 1, mode="reflect")
    noise = 1.4826 * np.median(np.abs(u - (v[:-2] + 2 * u + v[2:]) / 4)) / (6**0.5 / 4)
    side = [np.median(f[37:40]), np.median(f[41:44])]
    off = min(abs(f[40] - x) for x in side) / noise
    for factor, hit in ((off * (1 - 1e-6), True), (off * (1 + 1e-6), False)):
        for n in (16384, 10):
            got = {r["idx"] for r in flag_readings(table_of(rows, ("KIC 1", (t, f, e))), block=n, spike_factor=factor).collect() if r["spike"]}
            assert (40 in got) is hit


def test_few_and_odd_readings(rows):
    assert flag_readings(rows([], SCHEMA)).count() == 0
    df = rows([("a", "m", 1, 0, 1.0, 5.0, 1.0), ("b", "m", 1, 0, None, None, None), ("c", "m", None, None, -1.0, 2.0, 1.0), ("c", "m", None, None, 1.0, 2.0, None), ("d", None, 1, 0, 1.0, 0.0, -1.0)], SCHEMA)
    got = {(r["target_id"], r["idx"]): r for r in flag_readings(df).collect()}
    assert got.keys() == {("c", None), ("d", 0)} and got["c", None]["impossible_time"] and got["d", 0]["impossible_flux"] and got["d", 0]["impossible_error"]


def plain_grid(t, f, width=0.25, hold=0.25):
    ok = np.isfinite(t) & (t > 0) & (t < 40000) & np.isfinite(f) & (f > 0)
    order = np.argsort(t[ok], kind="stable")
    t, f = t[ok][order], f[ok][order]
    cells = np.floor(t / width).astype(int)
    out = {}
    for c in range(cells[0], cells[-1] + 1):
        length = area = 0.0
        for k in range(len(t)):
            end = min(t[k + 1] if k + 1 < len(t) else (cells[-1] + 1) * width, t[k] + hold)
            part = max(0.0, min(end, (c + 1) * width) - max(t[k], c * width))
            length, area = length + part, area + part * f[k]
        n = int((cells == c).sum())
        out[c] = (n, length / width, area / length if length > 0 else f[cells == c].mean() if n else None)
    return out


def test_grid(rows):
    rng = np.random.default_rng(5)
    t = np.sort(np.concatenate([rng.uniform(10, 13, 60), rng.uniform(15.1, 15.2, 3), [15.26, 15.75, 20.0]]))
    f = rng.uniform(1, 2, len(t))
    t[7], f[9], f[11] = math.nan, math.nan, -1
    t[20] = t[21]
    df = table_of(rows, ("KIC 1", (t, f, np.ones(len(t)))), (None, (t[:1], f[:1], [1.0])))
    twice = df.unionByName(df.where("idx % 3 = 0")).withColumn("cell", F.lit("clash"))
    got = {}
    for r in regular_grid(twice).collect():
        got.setdefault(r["target_id"], {})[r["cell"]] = r
    want = plain_grid(t, f)
    assert got["KIC 1"].keys() == want.keys() and len(got[None]) == 1
    for c, (n, coverage, mean) in want.items():
        r = got["KIC 1"][c]
        assert r["n_readings"] == n and r["coverage"] == pytest.approx(coverage, abs=1e-9) and r["observed"] == (n > 0)
        assert r["mean_flux"] is None and mean is None or r["mean_flux"] == pytest.approx(mean, rel=1e-9)
        assert r["state"] == ("observed" if n else "filled" if coverage > 0 else "missing")
    assert regular_grid(rows([], SCHEMA)).count() == 0


def test_gaps_come_from_intervals(rows):
    from dipweave.plans import problems

    made = {"light_curves": table_of(rows, ("KIC 1", (np.array([1.0, 1.1, 2.6]), np.ones(3), np.ones(3))))}
    old, problems.table = problems.table, lambda spark, folder, name: made[name]
    try:
        df = problems.p6_found(None, "")
        assert sorted(r["cell"] for r in df.collect()) == [5, 6, 7, 8, 9]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        problems.table = old
    # the next reading's time, the cut at the cells' borders and the coverage have a part in it
    assert "lead(time#" in plan and "lead(first#" in plan and "greatest(" in plan and "least(end#" in plan and "sum(length#" in plan
