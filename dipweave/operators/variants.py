"""Many variants of each series, such as one for each injection, smoothed where the series is.

A series and the list of its variants meet in one task, which makes some variants at a time, smooths them where they differ from the series, and measures their events there, so the readings
are shuffled once however many variants there are, and only events go on. Variants of series of several blocks are made as readings of their own and smoothed block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import series as se
from .events import EVENT, GEOMETRY, SCORES, Event, whole_periods, windows_of
from .kernels import compare_many
from .nearby import Dips
from .series import loose, smoothed


class Variant:
    """One variant of a whole series, smoothed: its windows, and the events in them."""

    def __init__(self, given: Mapping, time: np.ndarray, err: np.ndarray, cadence: float | None, new: dict[str, np.ndarray], c: Config) -> None:
        self.given, self.time, self.err, self.c = given, time, err, c
        self.flux, self.baseline = new["flux"], new["baseline"]
        self.windows = windows_of(time, (new["baseline"] - new["flux"]) / new["sigma"], cadence, c)

    def event(self, start: int, end: int) -> Event:
        pad = round((end - start + 1) * self.c.asymmetry.search_padding_factor)
        own = slice(max(start - pad, 0), min(end + pad, len(self.time) - 1) + 1)
        return Event(self.time[own], self.flux[own], self.err[own], self.baseline[own], own.start, start, end, self.c)

    def away(self, start: int, end: int, at: float, tolerance: float) -> bool:
        """Whether the minimum of a window can't be within the tolerance of a time: it is less than half its neighbours' distance from the deepest reading."""
        i = start + int(np.argmin(self.flux[start : end + 1]))
        step = 0.5 * (self.time[min(i + 1, len(self.time) - 1)] - self.time[max(i - 1, 0)])
        return abs(self.time[i] - at) > tolerance + step + 1e-9


def variant_events(rows: DataFrame, plan: DataFrame, change: Callable[[np.ndarray, np.ndarray, Mapping], np.ndarray], answers: Callable[[Variant], list[Event]], least: int = 1, config: Config | None = None, detrend: str = "savgol", periods: bool = False) -> DataFrame:
    """measured() rows of the events that answers() picks from the variants of normalised rows of one block each, with a_dur_sigma if it picks at least `least` of one variant; their series is the struct (series, trial).

    plan: series, trial and what change(time, flux, row of plan) needs to give the variant's flux. With periods, an answer has `periodic`, `period_days` and `_mad` of its variant too, what
    periodicity() and noise() give. Readings don't leave the task. Long series are left out: see long_variants.
    """
    c = config or Config()
    smoother, limit = se._Smoother(c, detrend), se.BLOCK
    kind = rows.schema["series"].dataType.simpleString()
    whole, real = ("n", "start", "end"), ("start_time", "end_time", *EVENT, *(("period_days", "_mad") if periods else ()))

    def make(t: pa.Table, variants: pa.Table) -> pa.Table:
        found: list[tuple[int, dict]] = []
        key = t["series"].slice(0, 1).combine_chunks()
        if len(t) and len(variants):
            t = t.sort_by("pos")
            time, flux, err = (t[k].to_numpy() for k in ("time", "flux", "flux_err"))
            n, cadence = len(time), t["cadence"][0].as_py()
            given, at_once = variants.drop_columns(["series"]).sort_by("trial").to_pylist(), max((1 << 20) // n, 1)
            for a in range(0, len(given), at_once):
                some = given[a : a + at_once]
                new = smoother.many(time, flux, np.stack([change(time, flux, v) for v in some]), cadence)
                part, fluxes = [], []
                for r, v in enumerate(some):
                    variant = Variant(v, time, err, cadence, {k: x[r] for k, x in new.items()}, c)
                    picked = answers(variant) if variant.windows else []
                    for e in picked:
                        part.append((v["trial"], {"n": n, "start": e.start, "end": e.end, "start_time": e.start_time, "end_time": e.end_time} | e.geometry | ({"a_dur_sigma": e.a_dur_sigma()} if len(picked) >= least else {}) | e.profiles()))
                        fluxes.append(variant.flux)
                if periods and part:
                    fluxes = np.stack(fluxes)
                    spread = np.median(np.abs(fluxes - np.median(fluxes, axis=1, keepdims=True)), axis=1)
                    for (_, row), mad, (periodic, days) in zip(part, spread.tolist(), whole_periods(time, fluxes, err, c)):
                        row |= {"_mad": mad, "periodic": periodic, "period_days": days}
                found += part
        inner = loose(t.schema.field("series").type)
        series = pa.StructArray.from_arrays([key.take(pa.array(np.zeros(len(found), np.int64))).cast(inner), pa.array([k for k, _ in found], pa.int64())], ["series", "trial"])
        number = lambda x: None if x is None or x != x else float(x)
        out = {"series": series} | {k: pa.array([x[k] for _, x in found], pa.int64()) for k in whole} | {k: pa.array([number(x.get(k)) for _, x in found], pa.float64()) for k in real}
        return pa.table(out | ({"periodic": pa.array([x["periodic"] for _, x in found], pa.bool_())} if periods else {}))

    short, tasks = _short(rows)
    more = ", period_days double, _mad double, periodic boolean" if periods else ""
    return short.groupBy("series").cogroup(plan.repartition(tasks, "series").groupBy("series")).applyInArrow(make, f"series struct<series:{kind},trial:bigint>, n bigint, start bigint, end bigint, start_time double, end_time double, {GEOMETRY}, {SCORES}{more}")


def _short(rows: DataFrame) -> tuple[DataFrame, int]:
    """Normalised rows of series of one block, in so many partitions by series. Variants cost time, not space, so their tasks aren't merged with others for being small."""
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where(F.col("n") <= se.BLOCK).select("series", "pos", "n", "time", "flux", "flux_err", "cadence").repartition(tasks, "series"), tasks


#: Columns of an event near a dip: what it is, and what its profiles are fitted to.
NEAR = ("t_min", "depth", "a_dur", "a_dur_sigma", "level", "start_time", "end_time")
FITTED = ("time", "flux", "err")


def near_events(rows: DataFrame, plan: DataFrame, ingress: float, egress: float, tolerance: float, config: Config | None = None, detrend: str = "savgol") -> DataFrame:
    """(series, t_min, a_dur, a_dur_sigma, delta_bic, tau_over_sigma): the events of trials (series, trial, t0, depth) of normalised rows of one block each whose minimum is within the tolerance of
    their dip, as variant_events() has them; their series is the struct (series, trial).

    A trial is worked out around its dip only (see nearby.py), and profiles are fitted many at once, over all the series of a task.
    """
    c = config or Config()
    kind = rows.schema["series"].dataType.simpleString()

    def make(t: pa.Table, given: pa.Table) -> pa.Table:
        found: list[dict] = []
        key = t["series"].slice(0, 1).combine_chunks()
        if len(t) and len(given):
            t, given = t.sort_by("pos"), given.sort_by("trial")
            time, flux, err = (t[k].to_numpy() for k in ("time", "flux", "flux_err"))
            trial, t0, depth = (given[k].to_numpy() for k in ("trial", "t0", "depth"))
            at_once = max((1 << 20) // len(time), 16)
            for a in range(0, len(t0), at_once):
                dips = Dips(time, flux, err, t["cadence"][0].as_py(), t0[a : a + at_once], depth[a : a + at_once], ingress, egress, tolerance, c, detrend)
                for e in dips.events():
                    begin, end = float(time[e["start"]]), float(time[e["end"]])
                    wide = 0.25 * max(end - begin, 1e-6)
                    own = time[e["low"] : e["low"] + len(e["flat"])]
                    low, high = np.searchsorted(own, begin - wide, "left"), np.searchsorted(own, end + wide, "right")
                    found.append(e | {"trial": int(trial[a + e["trial"]]), "start_time": begin, "end_time": end, "time": own[low:high], "flux": e["flat"][low:high], "err": err[e["low"] + low : e["low"] + high]})
        inner = loose(t.schema.field("series").type)
        series = pa.StructArray.from_arrays([key.take(pa.array(np.zeros(len(found), np.int64))).cast(inner), pa.array([e["trial"] for e in found], pa.int64())], ["series", "trial"])
        number = lambda x: None if x is None or x != x else float(x)
        lists = lambda k: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(e[k]) for e in found]), pa.int32()), pa.array(np.concatenate([e[k] for e in found]) if found else np.zeros(0)))
        return pa.table({"series": series} | {k: pa.array([number(e.get(k)) for e in found], pa.float64()) for k in NEAR} | {k: lists(k) for k in FITTED})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in NEAR}
            parts = {k: (batch.column(k).flatten().to_numpy(), batch.column(k).value_lengths().to_numpy()) for k in FITTED}
            ends = np.cumsum(parts["time"][1]).tolist()
            events = [{k: columns[k][i] for k in NEAR} | {k: parts[k][0][a:b] for k in FITTED} for i, (a, b) in enumerate(zip([0, *ends], ends))]
            scores = np.array(compare_many(events)).reshape(-1, 2)
            names = ("series", "t_min", "a_dur", "a_dur_sigma")
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names] + [pa.array(scores[:, k], from_pandas=True) for k in (0, 1)], [*names, "delta_bic", "tau_over_sigma"])

    short, tasks = _short(rows)
    shape = f"series struct<series:{kind},trial:bigint>"
    events = short.groupBy("series").cogroup(plan.repartition(tasks, "series").groupBy("series")).applyInArrow(make, ", ".join([shape, *(f"{k} double" for k in NEAR), *(f"{k} array<double>" for k in FITTED)]))
    return events.mapInArrow(fit, f"{shape}, t_min double, a_dur double, a_dur_sigma double, delta_bic double, tau_over_sigma double")


def long_variants(far: DataFrame, plan: DataFrame, flux: Column, config: Config | None = None, detrend: str = "savgol") -> DataFrame:
    """smoothed() rows of the variants of series of several blocks, all readings of them; flux: the flux of a variant, by columns of far and plan."""
    blocks = far.select("series", "block").distinct().join(plan, "series")
    varied = far.join(blocks, ["series", "block"]).withColumn("_flux", flux)
    return smoothed(varied.select(F.struct("series", "trial").alias("series"), "block", "pos", "n", "time", F.col("_flux").alias("flux"), "flux_err", "cadence"), config, detrend, True)
