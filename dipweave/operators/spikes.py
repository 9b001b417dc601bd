"""Implausible readings of many series, each against its own normal behaviour.

A series is cut into blocks of consecutive readings, so that no task ever holds a whole long series. Most series are one block and are
flagged in it. Each block of a longer series first gives a summary (its edges, histograms of its detail coefficients and errors); windows
over the few summaries of a series work out what runs on over block borders and the histogram bins of the middle detail and error; the values in those
bins are counted one by one for the exact medians; then each block is flagged with that at hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_finite, known
from ..sources.shared import kept

#: Standard deviation of the finest à trous detail (kernel 1/4, 1/2, 1/4) of unit white noise.
DETAIL_GAIN = 6**0.5 / 4
MAD_TO_SIGMA = 1.4826
#: Readings on either side that make the level around a spike.
SIDE = 3
#: Usable readings that a block gets from either neighbour: a spike's two readings, its sides and the reach of the second detail level.
EDGE = 2 * SIDE + 4
#: A histogram's bin holds the values that agree in the exponent and so many leading bits: 0.05 % wide.
BITS = 11

SUMMARY = "last_time double, n_usable bigint, head array<double>, tail array<double>, head_value double, head_run bigint, tail_value double, tail_run bigint, detail_bins array<int>, detail_counts array<bigint>, error_bins array<int>, error_counts array<bigint>"
FLAGS = "idx bigint, impossible_flux boolean, impossible_error boolean, large_error boolean, impossible_time boolean, repeated_time boolean, stuck_flux boolean, spike boolean"


def details(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two finest levels of the undecimated (à trous) wavelet decomposition; borders are mirrored."""

    def smooth(v: np.ndarray, step: int) -> np.ndarray:
        p = np.pad(v, step, mode="reflect" if len(v) > step else "edge")
        return (p[: -2 * step] + 2 * v + p[2 * step :]) / 4

    first = smooth(x, 1)
    return x - first, first - smooth(first, 2)


def _bins(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of values that aren't negative, by exponent and leading bits."""
    return np.unique((values.view(np.int64) >> (52 - BITS)).astype(np.int32), return_counts=True)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class _Block:
    """The readings of one block in order, each once."""

    def __init__(self, t: pa.Table, low: float, high: float) -> None:
        idx = t["idx"].to_numpy()
        cols = [np.array(t[c].to_numpy(zero_copy_only=False), np.float64) for c in ("time", "flux", "flux_err")]
        order = np.lexsort((cols[2], cols[1], cols[0], idx))
        idx = idx[order]
        keep = np.concatenate([[True], idx[1:] != idx[:-1]])  # rows delivered twice
        order = order[keep]
        self.idx = idx[keep]
        self.time, self.flux, self.error = (c[order] for c in cols)
        with np.errstate(invalid="ignore"):
            self.timed = (self.time > low) & (self.time < high)
            self.usable = np.isfinite(self.flux) & (self.flux > 0)
            self.error_ok = np.isfinite(self.error) & (self.error > 0)
            self.finite = np.isfinite(self.flux)


def _median(a: np.ndarray) -> np.ndarray:
    """Medians of rows; NaN entries don't count."""
    a, n = np.sort(a, axis=1), np.count_nonzero(a == a, axis=1)
    rows = np.arange(len(a))
    return (a[rows, np.maximum(n - 1, 0) // 2] + a[rows, np.minimum(n // 2, a.shape[1] - 1)]) / 2


def _spikes(x: np.ndarray, noise: float, many: float, near: float) -> np.ndarray:
    """True at readings that stand off alone, or two together, from the level on either side by more than many times the noise.

    Large detail coefficients at either level name the places. Each place is then held against the readings around it: it must stand off
    from the medians of up to three readings on each side, and the readings next to it must be at the level of those (within `near` times
    the noise), else the excursion is a longer one.
    """
    out, n = np.zeros(len(x), bool), len(x)
    if n < 3 or not noise >= 0:
        return out
    one, two = details(x)
    bound = many * noise
    # of a run of one or two with neighbours within half the bound, at least one reading has an eighth of the bound at the first level
    hot = (np.abs(one) >= 0.12 * bound) | (np.abs(two) >= 0.25 * bound)
    padded = np.concatenate([np.full(SIDE, np.nan), x, np.full(SIDE + 1, np.nan)])
    for m in (1, 2):
        at = np.flatnonzero(hot if m == 1 else hot | np.append(hot[1:], False))
        at = at[at + m <= n]
        if not len(at):
            continue
        left, run, right = (padded[at[:, None] + np.arange(a, b)] for a, b in ((0, SIDE), (SIDE, SIDE + m), (SIDE + m, 2 * SIDE + m)))
        level = _median(np.hstack([left, right]))
        with np.errstate(invalid="ignore"):
            # a comparison with NaN is false: a side without readings has no say
            close = [~(np.abs(run - _median(side)[:, None]) <= bound).any(axis=1) for side in (left, right)]
            longer = [np.abs(side - level) > near * noise for side in (left[:, -1], right[:, 0])]
        got = at[close[0] & close[1] & ~longer[0] & ~longer[1]]
        for k in range(m):
            out[got + k] = True
    return out


def _summarise(t: pa.Table, low: float, high: float) -> pa.Table:
    b = _Block(t, low, high)
    x, every, times = b.flux[b.usable], b.flux[b.finite], b.time[b.timed]
    starts = _runs(every)
    d_bins, d_counts = _bins(_sizes(x, None, None)[1:-1])  # those of the first and last reading depend on other blocks
    e_bins, e_counts = _bins(b.error[b.error_ok])
    row = {
        "last_time": times[-1] if len(times) else None, "n_usable": len(x), "head": x[:EDGE], "tail": x[-EDGE:],
        "head_value": every[0] if len(every) else None, "head_run": starts[1] if len(starts) > 1 else len(every),
        "tail_value": every[-1] if len(every) else None, "tail_run": len(every) - starts[-1] if len(starts) > 1 else 0,
        "detail_bins": d_bins, "detail_counts": d_counts, "error_bins": e_bins, "error_counts": e_counts,
    }
    kinds = {"array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "double": pa.float64(), "bigint": pa.int64()}
    return pa.table({"series": t["series"].slice(0, 1), "block": t["block"].slice(0, 1), **{c: pa.array([row[c]], kinds[kind]) for c, kind in (x.split() for x in SUMMARY.split(", "))}})


def _sizes(x: np.ndarray, left: float | None, right: float | None) -> np.ndarray:
    """The size of the finest detail at each of the readings x of a block between its neighbours, if there are any."""
    if not len(x):
        return np.zeros(0)
    v = np.concatenate([[] if left is None else [left], x, [] if right is None else [right]])
    start = int(left is not None)
    return np.abs(details(v)[0])[start : start + len(x)] + 0.0


def _border_bins(batches):
    """The bins of the details of each block's first and last usable reading."""
    for batch in batches:
        where, bins = [], []
        for k, row in enumerate(batch.select(["head", "tail", "n_usable", "left", "right"]).to_pylist()):
            n = row["n_usable"]
            # two readings at either end are all that the details of the outer ones need
            first, last = np.array(row["head"][:2], np.float64), np.array(row["tail"][-2:], np.float64)
            values = _sizes(first, row["left"], None if n > 1 else row["right"])[:1]
            if n > 1:
                values = np.append(values, _sizes(last, None, row["right"])[-1:])
            where += [k] * len(values)
            bins += (values.view(np.int64) >> (52 - BITS)).astype(np.int32).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("series").take(pa.array(where, pa.int64())), pa.array(bins, pa.int32())], names=["series", "bin"])


def _middle_bins(bins: DataFrame, name: str, least: int) -> DataFrame:
    """Of (series, bin, n) the bins of the two middle values of each series and their ranks from the beginning of the lower bin on; a series has a bounded number of bins."""
    w = Window.partitionBy("series")
    up = bins.groupBy("series", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w)).where(F.col("total") >= least)
    ranks = {"low": F.floor((F.col("total") + 1) / 2), "high": F.floor(F.col("total") / 2) + 1}
    reached = {k: F.min(F.when(F.col("upto") >= rank, F.struct("bin", (rank - F.col("upto") + F.col("n")).alias("rank"), rank.alias("of_all")))) for k, rank in ranks.items()}
    both = up.groupBy("series").agg(*(c.alias(k) for k, c in reached.items()))
    return both.select("series", F.col("low.bin").alias(f"{name}_low"), F.col("high.bin").alias(f"{name}_high"), F.col("low.rank").alias(f"{name}_rank"), (F.col("low.rank") + F.col("high.of_all") - F.col("low.of_all")).alias(f"{name}_next"))


def _flag(b: _Block, carry: dict, noise: float, error: float, limits: dict) -> dict[str, np.ndarray]:
    n = len(b.idx)
    large, repeated, stuck, spike = (np.zeros(n, bool) for _ in range(4))
    if error == error:
        large = b.error_ok & (b.error > limits["error_factor"] * error)
    if len(at := np.flatnonzero(b.timed)):
        before = np.concatenate([[np.nan if carry["time"] is None else carry["time"]], b.time[at][:-1]])
        repeated[at] = b.time[at] == before
    if len(at := np.flatnonzero(b.finite)):
        v = b.flux[at]
        with np.errstate(all="ignore"):
            flat = ~(np.abs(details(v)[0]) > 0)  # no detail at all; also where it can't be told
        flat[[0, -1]] = True  # runs that begin or end in other blocks
        if flat.any():
            # within a run of equal values there is no detail; nor is there on a slope, so the values have to confirm it
            starts = _runs(v)
            lengths = np.diff(np.append(starts, len(at)))
            total = lengths.copy()
            total[0] = max(total[0], carry["head_total"] or 0)
            total[-1] = max(total[-1], carry["tail_total"] or 0)
            inner = np.add.reduceat(flat.astype(np.int64), starts) >= np.maximum(lengths - 2, 1)
            stuck[at] = np.repeat((total >= limits["stuck_run"]) & inner, lengths)
    if len(at := np.flatnonzero(b.usable)):
        before, after = (np.array(carry[k] or [], np.float64) for k in ("before", "after"))
        x = np.concatenate([before, b.flux[at], after])
        spike[at] = _spikes(x, noise, limits["spike_factor"], limits["near_factor"])[len(before) : len(before) + len(at)]
    return {
        "impossible_flux": ~np.isnan(b.flux) & ~b.usable, "impossible_error": ~np.isnan(b.error) & ~b.error_ok, "large_error": large,
        "impossible_time": ~np.isnan(b.time) & ~b.timed, "repeated_time": repeated, "stuck_flux": stuck, "spike": spike,
    }


def flag_readings(readings: DataFrame, keys: tuple[str, ...] = ("target_id", "mission", "quarter_no"), block: int = 16384, time_bounds: tuple[float, float] = (0.0, 40000.0), error_factor: float = 10.0, stuck_run: int = 8, spike_factor: float = 10.0, near_factor: float = 5.0) -> DataFrame:
    """Readings that can't be right: one row (keys, idx, a boolean for each reason) for each reading with at least one reason.

    readings: keys, idx (the order within a series), time, flux, flux_err; further columns are left out, whatever their names. A
    reading delivered twice counts once. Reasons: flux or flux_err infinite or not positive; flux_err above error_factor times the
    series' median; time outside the bounds; time equal to the last time within the bounds before it; flux in a run of at least
    stuck_run equal finite values; a spike. Missing values (NULL or NaN) are no reason and are passed over. Rows without idx have no place in the
    order: only bounds and the median error apply to them, each such row is given by itself. NULL keys are a series like any other. An empty table gives an empty result. The
    noise is the robust scale of the finest wavelet detail. It and the median error are exact, however many blocks a series has.
    """
    low, high = time_bounds
    limits = {"error_factor": error_factor, "stuck_run": stuck_run, "spike_factor": spike_factor, "near_factor": near_factor}
    series = F.struct(*keys).alias("series")  # compared as a whole, so that NULL keys meet
    rows = readings.select(series, F.floor(F.col("idx") / block).alias("block"), F.col("idx").cast("bigint").alias("idx"), *(F.col(c).cast("double").alias(c) for c in ("time", "flux", "flux_err")))
    kind = rows.schema["series"].dataType.simpleString()
    placed = rows.where("idx IS NOT NULL")

    blocks = placed.groupBy("series").agg(F.max("block").alias("last")).where("last > 0").select("series", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("block"))
    parts = kept(placed.join(blocks, ["series", "block"], "left_semi").groupBy("series", "block").applyInArrow(lambda t: _summarise(t, low, high), f"series {kind}, block bigint, {SUMMARY}"))

    def flag(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        b = _Block(t, low, high)
        carry = c.to_pylist()[0] if c.num_rows else dict.fromkeys(c.column_names)
        x = b.flux[b.usable]
        if not c.num_rows:  # the whole series
            noise = float(np.median(np.abs(details(x)[0]))) if len(x) > 2 else np.nan
            error = float(np.median(b.error[b.error_ok])) if b.error_ok.any() else np.nan
        else:
            noise, error = (np.nan if carry[k] is None else carry[k] for k in ("detail", "error"))
        flags = _flag(b, carry, MAD_TO_SIGMA * noise / DETAIL_GAIN, error, limits)
        hit = np.flatnonzero(np.logical_or.reduce(list(flags.values())))
        return pa.table({"series": pa.array([key[0].as_py()] * len(hit), t.schema.field("series").type), "idx": pa.array(b.idx[hit], pa.int64()), **{k: pa.array(v[hit]) for k, v in flags.items()}})

    def counted(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        """How often each value in the middle bins occurs in a block of a long series."""
        what, values, counts = [], [], []
        if c.num_rows and t.num_rows:
            b, near = _Block(t, low, high), c.to_pylist()[0]
            for name, v in (("detail", _sizes(b.flux[b.usable], near["left"], near["right"])), ("error", b.error[b.error_ok])):
                if near[f"{name}_low"] is not None:
                    bins = v.view(np.int64) >> (52 - BITS)
                    each, n = np.unique(v[(bins >= near[f"{name}_low"]) & (bins <= near[f"{name}_high"])], return_counts=True)
                    what, values, counts = what + [name] * len(each), values + each.tolist(), counts + n.tolist()
        return pa.table({"series": pa.array([key[0].as_py()] * len(what), t.schema.field("series").type), "what": pa.array(what, pa.string()), "v": pa.array(values, pa.float64()), "n": pa.array(counts, pa.int64())})

    borders = _borders(parts)
    outer = borders.select("series", "head", "tail", "n_usable", "left", "right").where("n_usable > 0").mapInArrow(_border_bins, f"series {kind}, bin int").withColumn("n", F.lit(1).cast("bigint"))
    inner = {k: parts.select("series", F.explode(F.arrays_zip(f"{k}_bins", f"{k}_counts")).alias("x")).select("series", F.col(f"x.{k}_bins").alias("bin"), F.col(f"x.{k}_counts").alias("n")) for k in ("detail", "error")}
    middle = kept(_middle_bins(inner["detail"].unionByName(outer), "detail", 3).join(_middle_bins(inner["error"], "error", 1), "series", "full"))
    asked = borders.select("series", "block", "left", "right").join(middle, "series")
    counts = placed.groupBy("series", "block").cogroup(asked.groupBy("series", "block")).applyInArrow(counted, f"series {kind}, what string, v double, n bigint")
    upto = counts.groupBy("series", "what", "v").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("series", "what").orderBy("v")))
    at = lambda k, rank: F.min(F.when((F.col("what") == k) & (F.col("upto") >= F.col(f"{k}_{rank}")), F.col("v")))
    scales = upto.join(middle, "series").groupBy("series").agg(*(((at(k, "rank") + at(k, "next")) / 2).alias(k) for k in ("detail", "error")))

    flagged = placed.groupBy("series", "block").cogroup(_carry(parts, scales).groupBy("series", "block")).applyInArrow(flag, f"series {kind}, {FLAGS}")
    bad = lambda c: known(F.col(c)).isNotNull() & ~(is_finite(F.col(c)) & F.coalesce(F.col(c) > 0, F.lit(False)))
    bounds = {"impossible_flux": bad("flux"), "impossible_error": bad("flux_err"), "impossible_time": F.coalesce(~F.isnan("time") & ~((F.col("time") > low) & (F.col("time") < high)), F.lit(False))}
    names = [x.split()[0] for x in FLAGS.split(", ")[1:]]
    unplaced = rows.where("idx IS NULL").select("series", "idx", *(bounds.get(n, F.lit(False)).alias(n) for n in names)).where(" OR ".join(bounds))
    return flagged.unionByName(unplaced).select("series.*", "idx", *names)


def _borders(parts: DataFrame) -> DataFrame:
    """Summaries with the last usable reading before each block and the first one after it."""
    w = Window.partitionBy("series").orderBy("block")
    left = F.last(F.try_element_at("tail", F.lit(-1)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(F.try_element_at("head", F.lit(1)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return parts.select("series", "block", "head", "tail", "n_usable", left.alias("left"), right.alias("right"))


def _carry(parts: DataFrame, scales: DataFrame) -> DataFrame:
    """What each block of a long series has to know of the others: noise, median error, last time before it, readings beside it, runs over its borders."""
    w = Window.partitionBy("series").orderBy("block")
    around = parts.select("series", "block", F.last("last_time", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("time"), F.lag("tail").over(w).alias("before"), F.lead("head").over(w).alias("after"))
    # the first and last run of each block in order: neighbours belong to one run if they are equal and not the two ends of one block
    end = lambda k, name: F.struct(F.lit(k).alias("end"), F.col(f"{name}_value").alias("value"), F.col(f"{name}_run").alias("run"))
    ends = parts.select("series", "block", F.explode(F.array(end(0, "head"), end(1, "tail"))).alias("r")).select("series", "block", "r.*").where("value IS NOT NULL AND run > 0")
    e = Window.partitionBy("series").orderBy("block", "end")
    breaks = F.coalesce((F.col("value") != F.lag("value").over(e)) | (F.col("block") == F.lag("block").over(e)), F.lit(True))
    islands = ends.withColumn("island", F.sum(breaks.cast("int")).over(e)).withColumn("total", F.sum("run").over(Window.partitionBy("series", "island")))
    runs = islands.groupBy("series", "block").agg(F.max(F.when(F.col("end") == 0, F.col("total"))).alias("head_total"), F.max(F.when(F.col("end") == 1, F.col("total"))).alias("tail_total"))
    return around.join(runs, ["series", "block"], "left").join(scales, "series", "left")
