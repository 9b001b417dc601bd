"""Queries that run as streams over all that is there; and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spikes import flag_readings
from ..sources.shared import new_folder
from ..sources.tables import table
from ..streaming import ingest as st
from .problems import _FLAGS


def _path(folder: str) -> str:
    """A pattern that only the table matches: a stream takes a table of one file only as a pattern."""
    return f"{folder}/light_curves.parque[t]"


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of an incremental run that flags implausible readings of whole series: status, readings and flagged ones per target."""
    where = new_folder(spark)
    stream = st.readings_stream(spark, _path(folder), table(spark, folder, "light_curves").schema)
    st.run(spark, stream, flag_readings, f"{where}/results", ledger=f"{where}/ledger", checkpoint=f"{where}/state", store=f"{where}/store")
    return spark.read.parquet(f"{where}/ledger").groupBy("target_id", "mission").agg(F.sum("n_readings").alias("n_readings"), F.sum("n_results").alias("n_flagged"), F.max("status").alias("status"))


def stream_first(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per target once those delivered again are dropped."""
    where = new_folder(spark)
    stream = st.readings_stream(spark, _path(folder), table(spark, folder, "light_curves").schema)
    once = st.first_deliveries(stream).select("target_id", "mission", "quarter_no", "idx")
    once.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{where}/rows").groupBy("target_id", "mission").agg(F.count("*").alias("n_readings"))


def stream_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per day of arrival and mission."""
    where = new_folder(spark)
    stream = st.readings_stream(spark, _path(folder), table(spark, folder, "light_curves").schema)
    st.daily_table(stream, f"{where}/days", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/days").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "mission", "n", "n_positive")


QUERIES = {f.__name__: f for f in (stream_ingest, stream_first, stream_daily)}
SQL = {
    "stream_ingest": f"WITH flags AS ({_FLAGS}), f AS (SELECT target_id, mission, count(*) AS n FROM flags GROUP BY ALL), r AS (SELECT target_id, mission, count(*) AS n FROM light_curves GROUP BY ALL) SELECT r.target_id, r.mission, r.n AS n_readings, coalesce(f.n, 0) AS n_flagged, 'success' AS status FROM r LEFT JOIN f ON r.target_id IS NOT DISTINCT FROM f.target_id AND r.mission IS NOT DISTINCT FROM f.mission",
    "stream_first": "SELECT target_id, mission, count(DISTINCT (quarter_no, idx)) AS n_readings FROM light_curves GROUP BY ALL",
    "stream_daily": "SELECT strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, mission, count(*) AS n, count(*) FILTER (flux > 0) AS n_positive FROM light_curves GROUP BY ALL",
}
