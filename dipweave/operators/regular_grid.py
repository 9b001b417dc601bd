"""Irregular readings onto a regular grid, by validity intervals.

A reading holds from its time to that of the next one, though no longer than `hold`: a step function over intervals. The intervals are
cut at the borders of the grid's cells; a cell's value is the time-weighted mean over the pieces in it and its coverage is their length. Which cells have
nothing is read off the cells that have pieces. Readings are shuffled once, by series and cell, so a long series spreads over as many tasks as it has cells; what crosses a border is
worked out from one row per cell, of which a series has at most (high - low) / width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_finite


def regular_grid(readings: DataFrame, keys: tuple[str, ...] = ("target_id", "mission", "quarter_no"), width: float = 0.25, hold: float = 0.25, time_bounds: tuple[float, float] = (0.0, 40000.0)) -> DataFrame:
    """One row (keys, cell, observed, n_readings, coverage, mean_flux, state) for each cell of each series from its first to its last usable reading.

    cell = floor(time / width). A reading is usable if time lies strictly within the bounds and flux is finite and positive; others
    are passed over, NULL and NaN among them. A reading delivered twice (same idx and time) counts once; of several readings at one
    time the one with the largest idx holds on. state is `observed` for a cell with readings, `filled` for one without that a
    reading before it still holds in, else `missing` with a NULL mean. The last reading of a series holds in its own cell only. mean_flux of a
    cell whose readings cover no time (a single reading on its last moment) is the mean of the readings. Further columns are left out, whatever their names; NULL keys are a series like any other; an empty table gives an empty result.
    """
    low, high = time_bounds
    cell = F.floor(F.col("time") / width)
    usable = readings.select(F.struct(*keys).alias("series"), F.col("idx"), F.col("time").cast("double").alias("time"), F.col("flux").cast("double").alias("flux")).where((F.col("time") > low) & (F.col("time") < high) & is_finite(F.col("flux")) & (F.col("flux") > 0)).withColumn("cell", cell)

    w = Window.partitionBy("series", "cell").orderBy("time", F.col("idx").asc_nulls_first(), "flux")
    copy = F.coalesce((F.lag("idx").over(w) == F.col("idx")) & (F.lag("time").over(w) == F.col("time")), F.lit(False))
    span = F.least(F.coalesce(F.lead("time").over(w) - F.col("time"), F.lit(0.0)), F.lit(hold))
    steps = usable.select("series", "cell", "time", "flux", copy.alias("copy"), span.alias("span"), F.row_number().over(w).alias("place"))
    # by time, then by place, the last reading of a cell is the one that holds beyond it
    cells = steps.groupBy("series", "cell").agg(F.count_if(~F.col("copy")).alias("n"), F.min("time").alias("first"), F.max(F.struct("place", "time", "flux")).alias("last"), F.sum(F.col("flux") * F.col("span")).alias("area"), F.sum("span").alias("length"), F.sum(F.when(~F.col("copy"), F.col("flux"))).alias("total"))

    s = Window.partitionBy("series").orderBy("cell")
    start_of = lambda c: c * width
    within = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    # what the last reading of a cell holds for: up to the next one's time; the last of all in its own cell only
    end = F.least(F.coalesce(F.lead("first").over(s), start_of(F.col("cell") + 1)), F.col("last.time") + hold)
    intervals = cells.withColumn("end", end)
    # its interval is cut at the borders it crosses, and the pieces join what cells have of their own
    pieces = intervals.withColumn("at", F.explode(F.sequence("cell", F.floor(F.col("end") / width))))
    own = F.col("at") == F.col("cell")
    part = within(F.greatest(F.col("last.time"), start_of(F.col("at"))), F.least(F.col("end"), start_of(F.col("at") + 1)))
    mine = lambda c, other: F.when(own, F.col(c)).otherwise(F.lit(other))
    grid = pieces.select("series", "at", mine("n", 0).alias("n"), (mine("length", 0.0) + part).alias("length"), (mine("area", 0.0) + part * F.col("last.flux")).alias("area"), F.when(own, F.col("total")).alias("total"))
    grid = grid.groupBy("series", "at").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.sum("area").alias("area"), F.max("total").alias("total"))
    # cells with readings or coverage, each followed by those without any up to the next one
    covered = grid.where("n > 0 OR length > 0").withColumn("next", F.lead("at").over(Window.partitionBy("series").orderBy("at")))
    every = covered.withColumn("cell", F.explode(F.sequence("at", F.coalesce(F.col("next") - 1, F.col("at")))))
    here = F.col("cell") == F.col("at")
    n, length = F.when(here, F.col("n")).otherwise(F.lit(0)), F.when(here, F.col("length")).otherwise(F.lit(0.0))
    return every.select(
        "series.*", "cell", (n > 0).alias("observed"), n.alias("n_readings"), (length / width).alias("coverage"),
        F.when(length > 0, F.col("area") / F.col("length")).when(n > 0, F.col("total") / F.col("n")).alias("mean_flux"),
        F.when(n > 0, "observed").when(length > 0, "filled").otherwise("missing").alias("state"),
    )
