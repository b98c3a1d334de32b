"""Counters that survive a restart, as mergeable partial aggregates.

A run saves what it counted; a later run adds its own part. Reading sums the parts, which are merged
by levels meanwhile (sources.parts).
Each part carries an epoch, so `seq` of a later run never sorts before an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, is_signal
from ..plans.scale import path_exists
from .parts import Parts

# The persisted columns. `message` is null for rows that only count lines.
STATE_DDL = ("source string, level string, message string, count bigint, "
             "first_epoch bigint, first_seq bigint, last_epoch bigint, last_seq bigint, "
             "last_ts timestamp")


def partials(events: DataFrame, epoch: int = 0) -> DataFrame:
    """Counts per (source, level, signal message): all a saved session needs."""
    return (events.withColumn("message", F.when(is_signal("level"), F.col("message")))
                  .groupBy("source", "level", "message")
                  .agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"),
                       F.max("seq").alias("last_seq"), F.max_by("ts", "seq").alias("last_ts"))
                  .select("source", "level", "message", "count",
                          F.lit(epoch).cast("bigint").alias("first_epoch"), "first_seq",
                          F.lit(epoch).cast("bigint").alias("last_epoch"), "last_seq", "last_ts"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of several parts; merging is associative, so order does not matter."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = F.struct("first_epoch", "first_seq")
    last = F.struct("last_epoch", "last_seq")
    return (rows.groupBy("source", "level", "message")
                .agg(F.sum("count").alias("count"), F.min(first).alias("f"),
                     F.max(last).alias("l"), F.max_by("last_ts", last).alias("last_ts"))
                .select("source", "level", "message", "count", "f.first_epoch", "f.first_seq",
                        "l.last_epoch", "l.last_seq", "last_ts"))


def save_state(state: DataFrame, path: str, epoch: int = 0) -> None:
    """Write one part; saving the same epoch again replaces it, so a retry cannot double counts.

    Epochs that were merged with others since are closed: saving them again is an error.
    """
    Parts(state.sparkSession, path, merge, ddl=STATE_DDL).commit(
        state.select(*[c.split()[0] for c in STATE_DDL.split(", ")]), epoch)


def load_state(spark: SparkSession, path: str, reset: bool = False) -> DataFrame:
    """All saved parts merged; an empty state when nothing was saved or on reset."""
    if reset or not path_exists(spark, path):
        return spark.createDataFrame([], STATE_DDL)
    return merge(Parts(spark, path, ddl=STATE_DDL).read())


def compact_state(spark: SparkSession, path: str, into: str, epoch: int = 0) -> None:
    """Write all parts of a state as one part of a new state."""
    save_state(load_state(spark, path), into, epoch)


def state_level_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("source", "level").agg(F.sum("count").alias("count"))


def state_last_seen(state: DataFrame) -> DataFrame:
    """(source, last_error_ts, last_warn_ts) of the saved session."""
    def last(level):
        order = F.when(F.col("level") == level, F.struct("last_epoch", "last_seq"))
        return F.max_by("last_ts", order)
    return state.groupBy("source").agg(last("ERROR").alias("last_error_ts"),
                                       last("WARN").alias("last_warn_ts"))


def state_patterns(state: DataFrame) -> DataFrame:
    """(source, pattern, level, count, last_ts) of the saved session."""
    rows = state.filter(F.col("message").isNotNull()).withColumn("pattern", fingerprint("message"))
    return rows.groupBy("source", "pattern").agg(
        F.min_by("level", F.struct("first_epoch", "first_seq")).alias("level"),
        F.sum("count").alias("count"),
        F.max_by("last_ts", F.struct("last_epoch", "last_seq")).alias("last_ts"))
