"""Stored events: parsed once, read by every operator.

Parquet by source and date, with the pattern of every signal and its total position. A read that
names sources, days or a pattern prunes partitions and pushes the rest into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, is_signal
from ..plans.scale import path_exists

# Columns of the store. The last three are folders; declared, so that names are not
# read as numbers.
EVENTS_DDL = ("seq bigint, event_ts timestamp, ingest_ts timestamp, ts timestamp, level string, "
              "message string, pattern string, batch string, source string, date string")
#: Folder of events without any time.
NO_DATE = "none"


def write_events(events: DataFrame, path: str, batch: str = "0") -> None:
    """Write what `parse_logs` returns; writing a batch again replaces it.

    Rows are rebalanced by source and date, so a busy day of one source becomes several files and
    quiet ones share a task.
    """
    for name in ("event_ts", "ingest_ts"):
        if name not in events.columns:
            events = events.withColumn(name, F.col("ts") if name == "event_ts" else F.lit(None).cast("timestamp"))
    rows = events.select(
        "source", F.coalesce(F.to_date("ts").cast("string"), F.lit(NO_DATE)).alias("date"),
        "seq", "event_ts", "ingest_ts", "ts", "level", "message",
        F.when(is_signal("level"), fingerprint("message")).alias("pattern"))
    (rows.hint("rebalance", "source", "date").sortWithinPartitions("source", "date", "pattern", "seq")
     .write.mode("overwrite").partitionBy("source", "date").parquet(f"{path.rstrip('/')}/batch={batch}"))


def read_events(spark: SparkSession, path: str, source: str | list[str] | None = None,
                since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored events of some sources (all by default) and days (``yyyy-MM-dd``, both included)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], EVENTS_DDL).drop("batch", "date")
    rows = spark.read.schema(EVENTS_DDL).parquet(path)
    if source is not None:
        rows = rows.filter(F.col("source").isin(*([source] if isinstance(source, str) else source)))
    if since is not None:
        rows = rows.filter(F.col("date") >= since)
    if until is not None:
        rows = rows.filter(F.col("date") <= until)
    return rows.drop("batch", "date")
