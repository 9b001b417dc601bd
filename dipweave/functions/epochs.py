"""Times of several missions in one epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

#: What to add to a time of a mission for BJD - 2454833.
EPOCH = {"Kepler": 0.0, "K2": 0.0, "TESS": 2457000.0 - 2454833.0}


def common_time(time: Column, mission: Column) -> Column:
    """A time in BJD - 2454833; NULL without a finite time or a known mission (in any letter case, blanks around it not counting)."""
    name = F.upper(F.trim(mission))
    shift = F.coalesce(*(F.when(name == k.upper(), F.lit(v)) for k, v in EPOCH.items()))
    return finite(time) + shift
