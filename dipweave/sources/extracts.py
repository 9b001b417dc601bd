"""Series, results and lists as files: written whole or not at all, read back as tables."""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTRACT = "target_id string, mission string, quarter_no int, idx bigint, time double, flux double, flux_err double, meta_json string"


def save_extract(series: DataFrame, path: str) -> None:
    """Writes series by mission; missions that are in `series` replace what was there, others stay."""
    series.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mission").parquet(path)


def load_extract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_results(candidates: DataFrame, path: str) -> None:
    """Adds candidates as JSON lines. That a target was searched and has none is for the ledger to say."""
    candidates.write.mode("append").option("ignoreNullFields", "false").json(path)


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Candidates of JSON lines; malformed lines go."""
    lines = spark.read.text(path).select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return lines.where("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")


def save_list(rows: DataFrame, path: str, line: str = "target_id", note: str | None = None) -> None:
    """Writes a text list of targets, each with its note behind `#`."""
    value = F.col(line) if note is None else F.concat_ws("  # ", line, note)
    rows.select(value.alias("value")).write.mode("overwrite").text(path)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        f = pq.ParquetFile(partition.path)
        meta = {k.decode(): v.decode() for k, v in (f.schema_arrow.metadata or {}).items()}
        about = json.loads(meta.get("meta_json", "{}"))
        start = 0
        for batch in f.iter_batches(columns=["time", "flux", "flux_err"], batch_size=65536):
            n = batch.num_rows
            fixed = [pa.array([v] * n, t) for v, t in ((meta.get("target_id"), pa.string()), (meta.get("mission"), pa.string()), (about.get("quarter_no"), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(start, start + n), pa.int64()), *(batch.column(k).cast(pa.float64()) for k in range(3)), pa.array([meta.get("meta_json")] * n, pa.string())], names=[c.split()[0] for c in EXTRACT.split(", ")])
            start += n


class SeriesFiles(DataSource):
    """Parquet files of one series each whose target, mission and description are in the file's metadata; option `path` is a pattern. One partition per file."""

    @classmethod
    def name(cls) -> str:
        return "series_files"

    def schema(self) -> str:
        return EXTRACT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def series_files(spark: SparkSession, pattern: str) -> DataFrame:
    spark.dataSource.register(SeriesFiles)
    return spark.read.format("series_files").option("path", pattern).load()
