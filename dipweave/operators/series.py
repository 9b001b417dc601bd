"""Series of readings as a long table: cleaning, places, normalising, trends, local levels and noise.

A series is cut into blocks twice: by time for cleaning and counting, by place for filters, where each block comes with as many readings of its neighbours as the
filters reach. No task holds a whole long series; what is one number per series is worked out by combining blocks. A series that fits one block, as most do, takes one shuffle of its
readings from the scan to the end. Readings are never written: operators that need them again go back to the scan. Numbers of long series, one row for each, are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import is_finite, known
from ..sources.shared import kept
from .kernels import medians_again, rolling_median, savgol, savgol_again, spline_trend
from .medians import exact_medians

KEYS = ("target_id", "mission", "quarter_no")
MAD_TO_SIGMA = 1.4826
#: Days of a block by time, readings of a block by place.
BLOCK_DAYS = 8.0
BLOCK = 65536
NORMALISED = "block bigint, pos bigint, n bigint, time double, next_time double, flux double, flux_err double, level double, cadence double"
SMOOTHED = "block bigint, pos bigint, n bigint, time double, flux double, flux_err double, cadence double, trend double, baseline double, sigma double"


def cadences(days: float, cadence: Column) -> Column:
    """A duration in whole readings of a cadence, at least 1, halves to the even."""
    return F.greatest(F.bround(F.lit(days) / cadence).cast("bigint"), F.lit(1).cast("bigint"))


def odd_window(window: Column, n: Column) -> Column:
    """window, no larger than a series of n readings, made odd by taking one off."""
    size = F.least(window, n)
    return F.greatest(size - (size % 2 == 0).cast("bigint"), F.lit(1).cast("bigint"))


def loose(kind: pa.DataType) -> pa.DataType:
    """An Arrow type with all struct fields nullable, as a schema given by name has them."""
    return pa.struct([pa.field(f.name, loose(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def _usable(readings: DataFrame, keys: tuple[str, ...], bounds: tuple[float, float] | None) -> DataFrame:
    """(series, part, idx, time, flux, flux_err) of the readings that count; part is the block by idx."""
    usable = is_finite(F.col("time")) & is_finite(F.col("flux")) & is_finite(F.col("flux_err"))
    if bounds:
        usable = usable & F.coalesce((F.col("time") > bounds[0]) & (F.col("time") < bounds[1]) & (F.col("flux") > 0) & (F.col("flux_err") > 0), F.lit(False))
    rows = readings.select(F.struct(*keys).alias("series"), F.col("idx").cast("bigint").alias("idx"), *(F.col(c).cast("double").alias(c) for c in ("time", "flux", "flux_err"))).where(usable)
    return rows.withColumn("part", F.coalesce(F.floor(F.col("idx") / BLOCK), F.lit(-1).cast("bigint")))


def _long(rows: DataFrame) -> DataFrame | None:
    """(series, part): the blocks by idx of series that don't fit one block, or whose readings can't be told by idx; None if there is no such series. A small job over the keys."""
    each = rows.groupBy("series").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    found = kept(each.where((F.col("n") > 2 * BLOCK) | (F.col("low") != 0) | (F.col("high") != 0)).select("series", F.explode(F.sequence("low", "high")).alias("part")))
    return found if found.head(1) else None


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed readings from usable ones, and their blocks by time (series, block)."""
    rows = rows.withColumn("block", F.floor(F.greatest(F.least(F.col("time"), F.lit(1e12)), F.lit(-1e12)) / BLOCK_DAYS))
    w = Window.partitionBy("series", "block").orderBy("time", "idx", "flux", "flux_err")
    once = rows.withColumn("_before", F.lag("time").over(w)).where("_before IS NULL OR _before <> time").drop("_before")
    local = once.withColumn("_at", F.row_number().over(w)).withColumn("_next", F.lead("time").over(w))
    blocks = once.groupBy("series", "block").agg(F.count("*").alias("_count"), F.min("time").alias("_first"))
    s = Window.partitionBy("series")
    offsets = blocks.select("series", "block", (F.sum("_count").over(s.orderBy("block")) - F.col("_count")).alias("_offset"), F.sum("_count").over(s).alias("n"), F.lead("_first").over(s.orderBy("block")).alias("_beyond"))
    out = local.join(offsets, ["series", "block"]).select("series", "block", (F.col("_offset") + F.col("_at") - 1).alias("pos"), "n", "time", F.coalesce("_next", "_beyond").alias("next_time"), "flux", "flux_err")
    return out, offsets.select("series", "block")


def placed(readings: DataFrame, keys: tuple[str, ...] = KEYS, bounds: tuple[float, float] | None = (0.0, 40000.0)) -> DataFrame:
    """(series, block, pos, n, time, next_time, flux, flux_err): the usable readings of each series in time order, pos counting from 0.

    Readings with a missing or infinite time, flux or flux_err go, and with bounds also those with a time not strictly within them and flux or flux_err not positive; of several at one time the first by
    (idx, flux, flux_err) stays. n is the number that stay. series is the struct of the keys, so NULL keys are a series too.
    """
    return _placed(_usable(readings, keys, bounds))[0]


def series_medians(rows: DataFrame, **values: Column) -> DataFrame:
    """(series, the names of values): exact medians per series of rows (series, n, ...). Those of series of one block are taken from their values, those of longer ones from counts; the result is the same."""
    short = rows.where(F.col("n") <= BLOCK).groupBy("series").agg(*(F.percentile(v.cast("double"), F.lit(0.5)).alias(k) for k, v in values.items()))
    return short.unionByName(exact_medians(rows.where(F.col("n") > BLOCK), "series", **values))


def _by_block(rows: DataFrame, scalars: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """rows with the columns of scalars (one row per series), joined by series and block so that no long series is one hot key."""
    blocks = rows.select("series", "block").distinct() if blocks is None else blocks
    return rows.join(blocks.join(scalars, "series"), ["series", "block"])


def _whole(t: pa.Table) -> dict | None:
    """The readings of a series of one block in order, one for each time, in units of their median; None if that isn't positive."""
    idx, time, flux, err = (t[k].to_numpy() for k in ("idx", "time", "flux", "flux_err"))
    order = np.lexsort((err, flux, idx, time))
    time = time[order]
    first = np.concatenate([[True], time[1:] != time[:-1]])
    order, time = order[first], time[first]
    level = float(np.median(flux[order]))
    if not level > 0:
        return None
    return {"n": len(time), "time": time, "flux": flux[order] / level, "flux_err": err[order] / level, "level": level, "cadence": float(np.median(np.diff(time))) if len(time) > 1 else None}


def _table(series: pa.ChunkedArray, columns: dict, schema: str) -> pa.Table:
    """A table of one series, given by the first row of a column; single values are repeated."""
    n = len(columns["time"])
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    first = series.slice(0, 1).combine_chunks()
    repeated = first.take(pa.array(np.zeros(n, np.int64))).cast(loose(series.type))
    out = {"series": repeated}
    for name, kind in (x.split() for x in schema.split(", ")):
        v = columns[name]
        out[name] = pa.array(v, kinds[kind]) if isinstance(v, np.ndarray) else pa.array([v], kinds[kind]).take(pa.array(np.zeros(n, np.int64)))
    return pa.table(out)


def normalised(readings: DataFrame, keys: tuple[str, ...] = KEYS, bounds: tuple[float, float] | None = (0.0, 40000.0)) -> DataFrame:
    """placed readings with flux and flux_err in units of the series' median flux, and its level and cadence (median step, in days; NULL for a single reading). A series whose median isn't positive has no rows."""
    rows = _usable(readings, keys, bounds)
    long = _long(rows)
    days = BLOCK_DAYS

    def whole(t: pa.Table) -> pa.Table:
        s = _whole(t)
        s = s or {"n": 0, "time": np.zeros(0), "flux": np.zeros(0), "flux_err": np.zeros(0), "level": None, "cadence": None}
        after = pa.array(np.append(s["time"][1:], np.nan), from_pandas=True) if s["n"] else pa.array([], pa.float64())
        made = _table(t["series"], s | {"block": np.floor(s["time"] / days).astype(np.int64), "pos": np.arange(s["n"]), "next_time": s["time"]}, NORMALISED)
        return made.set_column(made.column_names.index("next_time"), "next_time", after)

    short = rows if long is None else rows.join(long, ["series", "part"], "left_anti")
    out = short.groupBy("series").applyInArrow(whole, f"series {rows.schema['series'].dataType.simpleString()}, {NORMALISED}")
    return out if long is None else out.unionByName(_normalised_long(rows.join(long, ["series", "part"], "left_semi")))


def _normalised_long(usable: DataFrame) -> DataFrame:
    rows, blocks = _placed(usable)
    scalars = kept(exact_medians(rows, "series", level=F.col("flux"), cadence=F.col("next_time") - F.col("time")).where("level > 0"))
    named = [x.split()[0] for x in NORMALISED.split(", ")]
    return _by_block(rows, scalars, blocks).withColumns({"flux": F.col("flux") / F.col("level"), "flux_err": F.col("flux_err") / F.col("level")}).select("series", *named)


def time_order(readings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per series n, the readings with a known time, each idx once with its least time, and n_back, those of them that aren't later than the one before by idx: 0 for times in order.

    A series is cut into blocks by idx, and the last time of a block is handed to the next. Readings without idx are one block, before the others, in no order but that of time.
    """
    once = readings.select(F.struct(*keys).alias("series"), "idx", known(F.col("time")).alias("time")).where("time IS NOT NULL")
    once = once.groupBy("series", "idx").agg(F.min("time").alias("time")).withColumn("part", F.floor(F.col("idx") / BLOCK))
    rows = once.withColumn("before", F.lag("time").over(Window.partitionBy("series", "part").orderBy("idx")))
    blocks = rows.groupBy("series", "part").agg(F.count("*").alias("n"), F.count_if(F.col("time") <= F.col("before")).alias("back"), F.min_by("time", "idx").alias("first"), F.max_by("time", "idx").alias("last"))
    border = F.col("first") <= F.lag("last").over(Window.partitionBy("series").orderBy("part"))
    return blocks.withColumn("back", F.col("back") + F.coalesce(border.cast("int"), F.lit(0))).groupBy("series").agg(F.sum("n").alias("n"), F.sum("back").alias("n_back")).select("series.*", "n", "n_back")


def series_stats(readings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per series: n_points, n_dropped (readings that aren't usable or repeat a time), level, cadence_days, baseline_days."""
    rows = normalised(readings, keys).groupBy("series").agg(F.max("n").alias("n_points"), F.max("level").alias("level"), F.max("cadence").alias("cadence_days"), (F.max("time") - F.min("time")).alias("baseline_days"))
    total = readings.groupBy(F.struct(*keys).alias("series")).agg(F.count("*").alias("_all"))
    return rows.join(total, "series").select("series.*", "n_points", (F.col("_all") - F.col("n_points")).alias("n_dropped"), "level", "cadence_days", "baseline_days")


def _spread(rows: DataFrame, value: str) -> DataFrame:
    """(series, median, mad) of a column."""
    mid = kept(series_medians(rows, median=F.col(value)))  # a number per series
    return mid.join(kept(series_medians(_by_block(rows, mid), mad=F.abs(F.col(value) - F.col("median")))), "series")


def clipped(rows: DataFrame, sigma: float, value: str = "flux") -> DataFrame:
    """normalised rows with `clipped`: the flux, or the series' median where it is more than sigma robust deviations above it. Dips stay as they are, and so does a series without scatter."""
    high = (F.col("mad") > 0) & (F.col(value) > F.col("median") + sigma * MAD_TO_SIGMA * F.col("mad"))
    return _by_block(rows, _spread(rows, value)).withColumn("clipped", F.when(high, F.col("median")).otherwise(F.col(value))).drop("mad", "median")


def has_long(rows: DataFrame) -> bool:
    """Whether any series of placed rows has more than one block."""
    return bool(rows.where(F.col("n") > BLOCK).head(1))


class _Smoother:
    """The arithmetic of smoothed() for one block of a series."""

    def __init__(self, c: Config, detrend: str) -> None:
        if detrend not in ("savgol", "spline", "none"):
            raise ValueError(f"unknown detrending: {detrend}")
        self.detrend, self.spacing, self.order, self.clip = detrend, c.detrend.spline_knot_spacing_days, c.detrend.polyorder, c.detrend.upper_sigma_clip
        self.days = (c.detrend.window_days, c.baseline.median_window_days, c.baseline.noise_window_days)

    def _sizes(self, n: int, cadence: float | None) -> list[int]:
        sizes = [min(max(round(d / (cadence or 1.0)), 1), n) for d in self.days]
        return [max(w - (w % 2 == 0), 1) for w in sizes]

    def many(self, time: np.ndarray, flux: np.ndarray, variants: np.ndarray, cadence: float | None) -> dict[str, np.ndarray]:
        """flux, baseline and sigma of a call for each row of variants, which are whole series that differ from flux in some readings; filters go over what is within their reach only."""
        n = len(time)
        if self.detrend == "spline":  # every reading has a part in all of the trend
            each = [self(time, v, n, cadence, (True, True), None) for v in variants]
            return {k: np.stack([x[k] for x in each]) for k in ("flux", "baseline", "sigma")}
        w_trend, w_base, w_noise = self._sizes(n, cadence)
        both = clean = np.concatenate([flux[None], variants])
        if self.detrend != "none":
            mid = np.median(both, axis=1, keepdims=True)
            mad = np.median(np.abs(both - mid), axis=1, keepdims=True)
            clean = np.where((mad > 0) & (both > mid + self.clip * MAD_TO_SIGMA * mad), mid, both)
        trend = np.ones(both.shape)
        if self.detrend == "savgol" and w_trend > self.order:
            trend = savgol_again(clean, clean[0], savgol(clean[0], w_trend, self.order, True, True), w_trend, self.order)
        flat = both / np.where(np.abs(trend) < 1e-12, 1.0, trend)
        level = medians_again(flat, flat[0], rolling_median(flat[0], w_base), w_base)
        apart = np.abs(flat - level)
        noise = MAD_TO_SIGMA * medians_again(apart, apart[0], rolling_median(apart[0], w_noise), w_noise)
        least = np.maximum(MAD_TO_SIGMA * np.median(apart, axis=1, keepdims=True) * 1e-3, float(np.finfo(float).tiny))
        return {"flux": flat[1:], "baseline": level[1:], "sigma": np.maximum(noise, least)[1:]}

    def __call__(self, time: np.ndarray, flux: np.ndarray, n: int, cadence: float | None, ends: tuple[bool, bool], about: dict | None) -> dict[str, np.ndarray]:
        """about: what belongs to the whole series; None if the block is the whole series."""
        w_trend, w_base, w_noise = self._sizes(n, cadence)
        clean, trend = flux, np.ones(len(flux))
        if self.detrend != "none":
            mid = about["median"] if about else float(np.median(flux))
            mad = about["mad"] if about else float(np.median(np.abs(flux - mid)))
            clean = np.where((mad > 0) & (flux > mid + self.clip * MAD_TO_SIGMA * mad), mid, flux)
        if self.detrend == "savgol" and w_trend > self.order:
            trend = savgol(clean, w_trend, self.order, *ends)
        elif self.detrend == "spline":
            first, last = (about["first_time"], about["last_time"]) if about else (time[0], time[-1])
            knots = int((last - first) / self.spacing) - 1
            if knots >= 1 and n >= 8:
                trend = spline_trend(time, clean, np.linspace(first, last, knots + 2)[1:-1])
        trend = np.where(np.abs(trend) < 1e-12, 1.0, trend)
        flat = flux / trend
        level = rolling_median(flat, w_base)
        apart = np.abs(flat - level)
        every = about.get("every", 0.0) if about else float(np.median(apart))
        noise = MAD_TO_SIGMA * rolling_median(apart, w_noise)
        return {"flux": flat, "trend": trend, "baseline": level, "sigma": np.maximum(noise, max(MAD_TO_SIGMA * every * 1e-3, float(np.finfo(float).tiny)))}


def smoothed(rows: DataFrame, config: Config | None = None, detrend: str = "savgol", long: bool | None = None) -> DataFrame:
    """(series, block, pos, n, time, flux, flux_err, cadence, trend, baseline, sigma): normalised rows with their trend divided out, the local level and the local noise.

    detrend: `savgol`, `spline` or `none`. The trend is fitted to the flux with high outliers clipped; a series too short for it keeps its flux. The level is a centred
    running median with fewer readings at the ends, the noise 1.4826 times that of the distance from the level, no less than a thousandth of the same over the whole series. A spline of a series of
    several blocks is fitted block by block with 20 knots beyond either end, whose pull has died out there. A series of one block has all that at hand; the blocks of longer ones get
    the numbers that belong to the whole series (clipping limit, extent, least noise) beside them, the last of which take a first round of smoothing. long: whether there are longer ones, looked up if not given.
    """
    c = config or Config()
    smoother, block_size, n = _Smoother(c, detrend), BLOCK, F.col("n")
    names = [x.split()[0] for x in SMOOTHED.split(", ")]
    schema = f"series {rows.schema['series'].dataType.simpleString()}, {SMOOTHED}"
    if long is None:
        long = has_long(rows)

    def smooth(key: tuple, t: pa.Table, about: pa.Table | None = None) -> pa.Table:
        t = t.sort_by("pos")
        own = np.ones(len(t), bool)
        if len(t):
            pos, time, flux = (t[k].to_numpy() for k in ("pos", "time", "flux"))
            n, cadence, block = (t[k][0].as_py() for k in ("n", "cadence", "block"))
            given = about.to_pylist()[0] if n > block_size else None
            new = smoother(time, flux, n, cadence, (pos[0] == 0, pos[-1] == n - 1), given)
            own = pos // block_size == block if given else own
            for k, v in new.items():
                t = t.set_column(t.column_names.index(k), k, pa.array(v)) if k in t.column_names else t.append_column(k, pa.array(v))
        return t.set_column(t.column_names.index("series"), "series", t["series"].cast(loose(t["series"].type))).select(["series", *names]).filter(pa.array(own))

    if not long:
        return rows.select("series", F.lit(0).cast("bigint").alias("block"), "pos", "n", "time", "flux", "flux_err", "cadence").groupBy("series").applyInArrow(lambda t: smooth((), t), schema)
    cadence = F.coalesce(F.col("cadence"), F.lit(1.0))
    size = {"trend": odd_window(cadences(c.detrend.window_days, cadence), n), "base": odd_window(cadences(c.baseline.median_window_days, cadence), n), "noise": odd_window(cadences(c.baseline.noise_window_days, cadence), n)}
    reach = {"savgol": size["trend"], "spline": F.bround(20 * c.detrend.spline_knot_spacing_days / cadence).cast("bigint"), "none": F.lit(0).cast("bigint")}[detrend] + size["base"] + size["noise"]
    copies = F.sequence(F.greatest(F.floor((F.col("pos") - reach) / BLOCK), F.lit(0).cast("bigint")), F.least(F.floor((F.col("pos") + reach) / BLOCK), F.floor((n - 1) / BLOCK)))
    spread = lambda df: df.select("series", F.explode(copies).alias("block"), "pos", "n", "time", "flux", "flux_err", "cadence")
    blocks = lambda df: df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last"))).withColumnRenamed("series", "_series").drop("_last")
    run = lambda df, beside: spread(df).groupBy("series", "block").cogroup(blocks(beside).groupBy("_series", "_block")).applyInArrow(smooth, schema)
    far = rows.where(n > BLOCK)
    about = far.groupBy("series").agg(F.floor((F.max("n") - 1) / BLOCK).alias("_last"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    if detrend != "none":
        about = about.join(_spread(far, "flux"), "series")
    about = kept(about)
    first_round = run(far, about).select("series", F.abs(F.col("flux") - F.col("baseline")).alias("r"))
    return run(rows, about.join(kept(exact_medians(first_round, "series", every=F.col("r"))), "series"))


def flattened(readings: DataFrame, config: Config | None = None, detrend: str = "savgol", keys: tuple[str, ...] = KEYS, bounds: tuple[float, float] | None = (0.0, 40000.0)) -> DataFrame:
    """smoothed(normalised(readings)) in one pass over series of one block."""
    rows = _usable(readings, keys, bounds)
    return _flattened(rows, _long(rows), config or Config(), detrend)


def _flattened(rows: DataFrame, long: DataFrame | None, c: Config, detrend: str) -> DataFrame:
    smoother = _Smoother(c, detrend)

    def whole(t: pa.Table) -> pa.Table:
        s = _whole(t)
        if s is None:
            return _table(t["series"], {k: np.zeros(0) if k not in ("block", "pos", "n") else np.zeros(0, np.int64) for k in (x.split()[0] for x in SMOOTHED.split(", "))}, SMOOTHED)
        return _table(t["series"], s | {"block": 0, "pos": np.arange(s["n"])} | smoother(s["time"], s["flux"], s["n"], s["cadence"], (True, True), None), SMOOTHED)

    short = rows if long is None else rows.join(long, ["series", "part"], "left_anti")
    out = short.groupBy("series").applyInArrow(whole, f"series {rows.schema['series'].dataType.simpleString()}, {SMOOTHED}")
    return out if long is None else out.unionByName(smoothed(_normalised_long(rows.join(long, ["series", "part"], "left_semi")), c, detrend, True))


def flattened_twice(readings: DataFrame, config: Config | None, detrend: str, keys: tuple[str, ...] = KEYS, bounds: tuple[float, float] | None = (0.0, 40000.0)) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """flattened readings, and a function that gives those of some series only, from the scan on."""
    rows, c = _usable(readings, keys, bounds), config or Config()
    long = _long(rows)

    def only(series: DataFrame) -> DataFrame:
        some = series.select("series").distinct()
        if long is None:
            return _flattened(rows.join(some, "series", "left_semi"), None, c, detrend)
        # by blocks, so that a long series isn't one hot key
        blocks = some.withColumn("part", F.lit(0).cast("bigint")).unionByName(long.join(some, "series", "left_semi")).distinct()
        return _flattened(rows.join(blocks, ["series", "part"], "left_semi"), long, c, detrend)

    return _flattened(rows, long, c, detrend), only
