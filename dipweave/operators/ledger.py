"""The append-only ledger of processing attempts: reading it, latest states, the work queue and the relational views over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["target_id", "mission"]
ENTRY = "target_id string, mission string, status string, timestamp_utc string, attempt int, error string, extract_path string, results_path string, seq bigint"
REQUIRED = ("target_id", "mission", "status", "timestamp_utc", "attempt")


def numbered(entries: DataFrame, digits: int = 10) -> DataFrame:
    """(target_id, mission, status, timestamp_utc, attempt, seq): entries in order of (timestamp_utc, seq), numbered per target; attempt counts from the last success before.

    A target is cut into blocks of time by the first digits of its timestamps (10: a day), and the blocks' counts are added up, so no task holds all entries of a target.
    """
    e = entries.withColumn("_k", F.struct(*KEY, F.substring("timestamp_utc", 1, digits).alias("block")))
    w = Window.partitionBy("_k").orderBy("timestamp_utc", "seq")
    won = F.col("status") == "success"
    local = e.withColumn("_at", F.row_number().over(w)).withColumn("_won", F.max(F.when(won, F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = e.withColumn("_at", F.row_number().over(w)).groupBy("_k").agg(F.count("*").alias("n"), F.max(F.when(won, F.col("_at"))).alias("last"))
    s = Window.partitionBy("_k.target_id", "_k.mission").orderBy("_k.block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_offset", F.coalesce(F.sum("n").over(s), F.lit(0))).withColumn("_before", F.coalesce(F.max(F.col("_offset") + F.col("last")).over(s), F.lit(0))).select("_k", "_offset", "_before")
    seq = F.col("_offset") + F.col("_at")
    return local.join(starts, "_k").select(*KEY, "status", "timestamp_utc", (seq - F.coalesce(F.col("_offset") + F.col("_won"), "_before")).cast("int").alias("attempt"), seq.cast("bigint").alias("seq"))


def _place() -> Column:
    """Where a line is in a folder that was added to: the file's time, its name, the place in it."""
    return F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The valid entries of JSON lines: blank, torn and malformed lines, lines without a required field and lines with a key that isn't one of an entry's go.

    Entries come in the order of (seq, place). Lines of a ledger written by append() have a seq; those of others have none and come first, in the order of place: the file's time, its name, the place in it.
    """
    lines = spark.read.text(path).select("value", _place().alias("place")).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{ENTRY}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"), F.json_object_keys("value").alias("keys"), "place")
    names = [x.split()[0] for x in ENTRY.split(", ")]
    whole = F.col("e._corrupt").isNull() & F.col("keys").isNotNull() & (F.size(F.array_except("keys", F.array(*map(F.lit, names)))) == 0)
    for c in REQUIRED:
        whole = whole & F.col(f"e.{c}").isNotNull()
    return parsed.where(whole & F.col("e.status").isin("success", "failed")).select(*(f"e.{c}" for c in names), "place")


def append(entries: DataFrame, path: str) -> None:
    """Adds entries as new files of JSON lines; a torn job leaves no part behind. Entries of one target that are added at once must have a seq or be in one partition, in order."""
    entries.drop("place").write.mode("append").json(path)


def latest(ledger: DataFrame) -> DataFrame:
    """The last entry of each target and mission, by seq and, if there is one, place."""
    order = [c for c in ("seq", "place") if c in ledger.columns]
    rest = [c for c in ledger.columns if c not in (*KEY, *order)]
    return ledger.groupBy(*KEY).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*KEY, "m.*")


def next_targets(targets: DataFrame, ledger: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(target_id, mission, place, is_retry, retry_time) of what is to be done: never attempted ones by their place in the list, then failed ones with attempts left by the time of the last one.

    targets: target_id, mission, place. Order by (is_retry, retry_time, place).
    """
    joined = targets.join(latest(ledger).select(*KEY, "status", "attempt", "timestamp_utc"), KEY, "left")
    retry = (F.col("status") == "failed") & (F.col("attempt") < max_attempts)
    return joined.where(F.col("status").isNull() | retry).select(*KEY, "place", F.col("status").isNotNull().alias("is_retry"), F.when(F.col("status").isNotNull(), F.col("timestamp_utc")).alias("retry_time"))


def targets_view(ledger: DataFrame, results: DataFrame, processed: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One row per target and mission: last status and attempt, numbers of candidates and of flagged ones, retries left.

    results: keys and flagged, one row per candidate; processed: keys of those that have a results file. Without one the numbers are NULL, with an empty one 0. retries_left is NULL after a success.
    """
    counts = results.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("flagged").alias("f"))
    have = processed.select(*KEY).distinct().withColumn("_has", F.lit(True))
    joined = latest(ledger).join(counts, KEY, "left").join(have, KEY, "left")
    number = lambda c: F.when(F.col("_has"), F.coalesce(c, F.lit(0)))
    return joined.select(*KEY, "status", "attempt", number("n").alias("n_candidates"), number("f").alias("n_flagged"), F.when(F.col("status") == "failed", F.greatest(max_attempts - F.col("attempt"), F.lit(0))).alias("retries_left"))


def candidates_view(ledger: DataFrame, results: DataFrame, processed: DataFrame) -> DataFrame:
    """The results of targets that have an entry and a results file; a target without one has none here, as in targets_view."""
    return results.join(latest(ledger).select(*KEY).join(processed.select(*KEY).distinct(), KEY, "left_semi"), KEY, "left_semi")


def rebuild(ledger: DataFrame, results: DataFrame, processed: DataFrame, folder: str, max_attempts: int = 3) -> None:
    """Writes the tables attempts, targets and candidates below a folder anew, each in place of the one that was there."""
    tables = {"attempts": ledger, "targets": targets_view(ledger, results, processed, max_attempts), "candidates": candidates_view(ledger, results, processed)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def united(*lists: DataFrame) -> DataFrame:
    """(target_id, list, place): targets of several lists (target_id, place), each once, in the first list that has it, at its first place there. Order by (list, place); places of all lists have one type."""
    tagged = [x.select("target_id", F.struct(F.lit(k).alias("list"), "place").alias("at")) for k, x in enumerate(lists)]
    return reduce(DataFrame.unionByName, tagged).groupBy("target_id").agg(F.min("at").alias("at")).select("target_id", "at.*")


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, place): the lines of a text list, without comments (from `#` on) and blanks around; empty lines go, repeated ones count once. Their order is that of place: the file's time, its name, the place in it."""
    lines = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("target_id"), _place().alias("place")).where("target_id <> ''")
    return lines.groupBy("target_id").agg(F.min("place").alias("place"))


def fresh(cache: DataFrame, now, ttl_days: float, fetched_at: str = "fetched_at") -> DataFrame:
    """The rows of a cache that are no older than the time to live."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col(fetched_at).cast("timestamp").cast("double")
    return cache.where(age <= ttl_days * 86400)


def new_products(known: DataFrame, archive: DataFrame) -> DataFrame:
    """(target_id, mission, n_known, n_products): where the archive has more products than were processed; -1 is an archive that couldn't be asked."""
    joined = archive.join(known.select(*KEY, F.col("n_products").alias("n_known")), KEY, "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))
    return joined.where((F.col("n_products") >= 0) & (F.col("n_known") < F.col("n_products"))).select(*KEY, "n_known", "n_products")
