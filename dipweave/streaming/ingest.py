"""Incremental processing: micro-batches of new readings, each finished by its ledger entries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TARGET = ["target_id", "mission"]
SERIES = [*TARGET, "quarter_no"]
#: Characters of an error that the ledger keeps.
ERROR_LENGTH = 2000
LEDGER = "target_id string, mission string, status string, timestamp_utc string, attempt int, error string, n_readings bigint, n_results bigint, seq bigint"
_OVER = "the time budget is used up"


def readings_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream of readings."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def first_deliveries(stream: DataFrame, keys: tuple[str, ...] = ("target_id", "mission", "quarter_no"), delay: str = "30 days") -> DataFrame:
    """Each reading once: a repeated delivery within the delay is dropped, and what is known of older ones is forgotten."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark([*keys, "idx"])


def daily_counts(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Readings per mission and day of arrival; a day is final once the watermark has passed it."""
    return stream.withWatermark("received_at", delay).groupBy(F.window("received_at", "1 day"), "mission").agg(F.count("*").alias("n"), F.count_if(F.col("flux") > 0).alias("n_positive"))


def daily_table(stream: DataFrame, path: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Keeps daily_counts as a Parquet table, written anew by each batch, and stops when all that is there is counted. The counts stay with the executors."""

    def write(df: DataFrame, number: int) -> None:
        df.select(F.col("window.start").alias("day"), "mission", "n", "n_positive").write.mode("overwrite").parquet(path)

    return daily_counts(stream, delay).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _apart(process: Callable[[DataFrame], DataFrame], df: DataFrame, folder: str, bit: int = 0) -> list[DataFrame]:
    """Writes process(df) below a folder. If that fails, the targets are halved by the bits of a hash until those that fail stand alone; (target_id, mission, error) of these."""
    try:
        process(df).write.mode("overwrite").parquet(f"{folder}/part=0")
        return []
    except Exception as e:  # noqa: BLE001 - whatever goes wrong with one target must not stop the others
        targets = df.select(*TARGET).distinct()
        if bit > 62 or len(targets.limit(2).collect()) < 2:
            return [targets.withColumn("error", F.lit(str(e)[:ERROR_LENGTH]))]
    side = F.getbit(F.xxhash64(*TARGET), F.lit(bit))
    return _apart(process, df.where(side == 0), f"{folder}/half=0", bit + 1) + _apart(process, df.where(side == 1), f"{folder}/half=1", bit + 1)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet files anywhere below a path; an empty table if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def ingest(stream: DataFrame, process: Callable[[DataFrame], DataFrame], results: str, ledger: str, checkpoint: str, store: str | None = None, budget_seconds: float | None = None) -> StreamingQuery:
    """Runs all that is there through `process`, batch by batch, and stops.

    Each batch writes its results into a folder of its own number, replacing what a broken-off attempt left, and then, last, its ledger entries: one per
    target and mission, `success` with the number of results, 0 too, or `failed` with the beginning of the error. A target that fails doesn't stop the others. After a batch has its entries it isn't repeated.

    With `store`, readings are added to a table there and each series that got new ones is processed as a whole, so that results don't depend on how readings fall into files and batches: see latest_results.
    With budget_seconds, no batch is begun after that time; what is left is there for the next call. See run.
    """
    began = time.monotonic()

    def batch(df: DataFrame, number: int) -> None:
        if budget_seconds is not None and time.monotonic() - began >= budget_seconds:
            raise TimeoutError(_OVER)
        spark = df.sparkSession
        work = df = df.persist()
        try:
            if store:
                df.write.mode("overwrite").parquet(f"{store}/batch={number}")
                before = [f"{store}/batch={k}" for k in range(number + 1)]
                touched = df.select(*SERIES).distinct()
                match = F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in SERIES))
                work = spark.read.schema(df.schema).parquet(*before).alias("a").join(touched.alias("b"), match, "left_semi")
            failed = None
            for part in _apart(process, work, f"{results}/batch={number}"):
                failed = part if failed is None else failed.unionByName(part)
            found = _read(spark, f"{results}/batch={number}", "target_id string, mission string")
            counts = found.groupBy(*TARGET).agg(F.count("*").alias("n_results"))
            seen = df.groupBy(*TARGET).agg(F.count("*").alias("n_readings"))
            wrong = failed.groupBy(*TARGET).agg(F.first("error").alias("error")) if failed is not None else spark.createDataFrame([], "target_id string, mission string, error string")
            prior = _read(spark, ledger, LEDGER).groupBy(*TARGET).agg(F.max(F.struct("seq", "status", "attempt")).alias("last"))
            both = seen
            for other in (counts, wrong, prior):
                both = both.alias("a").join(other.alias("b"), F.expr("a.target_id <=> b.target_id AND a.mission <=> b.mission"), "left").select("a.*", *(f"b.{c}" for c in other.columns if c not in TARGET))
            attempt = F.when(F.col("last.status") == "failed", F.col("last.attempt") + 1).otherwise(1)
            bad = F.col("error").isNotNull()
            entries = both.select(*TARGET, F.when(bad, "failed").otherwise("success").alias("status"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_utc"), attempt.cast("int").alias("attempt"), "error", "n_readings", F.when(~bad, F.coalesce("n_results", F.lit(0))).alias("n_results"), F.lit(number).cast("bigint").alias("seq"))
            entries.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, *args, ledger: str, budget_seconds: float | None = None, targets: DataFrame | None = None, **more) -> dict[str, int]:
    """ingest(..., ledger=..., budget_seconds=...) to its end or until the budget is used up: how many targets succeeded and failed, by their latest entry, and of `targets` how many have none yet."""
    query = ingest(*args, ledger=ledger, budget_seconds=budget_seconds, **more)
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _OVER not in str(e):
            raise
    done = _read(spark, ledger, LEDGER).groupBy(*TARGET).agg(F.max(F.struct("seq", "status")).alias("last"))
    n = done.agg(F.count_if(F.col("last.status") == "success").alias("succeeded"), F.count_if(F.col("last.status") == "failed").alias("failed")).first().asDict()
    return n | ({"left": targets.select(*TARGET).distinct().join(done, TARGET, "left_anti").count()} if targets is not None else {})


def latest_results(spark: SparkSession, results: str, ledger: str, store: str, schema) -> DataFrame:
    """Of an ingestion with a store, the results of the last batch that each series was in."""
    last = spark.read.option("basePath", store).parquet(store).groupBy(*SERIES).agg(F.max("batch").alias("last"))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint")
    found = _read(spark, results, schema).withColumn("batch", number)
    return found.alias("r").join(last.alias("l"), F.expr(" AND ".join(f"r.{c} <=> l.{c}" for c in SERIES) + " AND r.batch = l.last")).select(*(F.col(f"r.{c}") for c in found.columns if c != "batch"))
