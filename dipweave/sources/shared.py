"""Intermediate results in the folder that all executors share.

They are Parquet tables: compressed, read by column, and, unlike a checkpoint, gone as soon as whoever made them says so.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir or was given with setCheckpointDir. Where none is named, one of our own, but only if
    all executors are this machine; RuntimeError on a cluster, whose executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _OWN.setdefault(app, _OWN.get(app) or tempfile.mkdtemp(prefix="dipweave-"))


def new_folder(spark: SparkSession) -> str:
    """The path of a folder that isn't there yet, below the shared one."""
    return f"{shared_folder(spark)}/dipweave-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, computed once and written to the shared folder."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, keep(df) is kept(df) below a folder that is deleted at the end; what leaves the block must not read from it any more."""
    folder = new_folder(spark)
    try:
        yield lambda df: kept(df, f"{folder}/{uuid.uuid4().hex}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
