"""Alert throttling over the signal stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, micros
from ..plans.cooldown import cooldown_picks
from ..plans.scale import join_small, materialize
from .filters import signals
from .rates import rate_table, tick_index


def _timeline(rows: DataFrame, cool: int, *keys: str) -> DataFrame:
    return rows.select(*keys, F.unix_micros("ts").alias("t"),
                       F.lit(cool).cast("bigint").alias("cool"), F.lit(False).alias("reset"))


def throttle(events: DataFrame, gap: str = "10 seconds", entry: DataFrame | None = None) -> DataFrame:
    """Signals of all sources thinned so that more than `gap` lies between two of them.

    Of the signals at a picked time the first to arrive is taken. `entry` may hold
    the last time taken before, as (last) in microseconds.
    """
    width = micros(gap)
    rows = signals(events)
    # "More than" the gap is "at least" one microsecond beyond it.
    picks = cooldown_picks(_timeline(rows, width + 1), [], max(width // 4, 1), entry)
    taken = join_small(rows.withColumn("t", F.unix_micros("ts")), picks.select("t"), ["t"])
    first = F.min(F.struct("seq", "source", "level", "message")).alias("e")
    return (taken.groupBy("t").agg(first)
                 .select(F.timestamp_micros("t").alias("ts"), "e.source", "e.seq", "e.level",
                         "e.message"))


def notify(taken: DataFrame, cooldown: str = "20 seconds", entry: DataFrame | None = None) -> DataFrame:
    """Mark throttled signals NOTIFIED or LOGGED; warnings and the rest cool down separately."""
    width = micros(cooldown)
    keyed = (taken.withColumn("alert_key", F.when(F.col("level") == "WARN", "WARN")
                                            .otherwise("ERROR"))
                  .withColumn("t", F.unix_micros("ts")))
    picks = cooldown_picks(_timeline(keyed, width, "alert_key"), ["alert_key"],
                           max(width // 4, 1), entry)
    return (keyed.join(picks.select("alert_key", "t", F.lit(True).alias("picked")),
                       ["alert_key", "t"], "left")
                 .withColumn("status", F.when(F.col("picked"), "NOTIFIED").otherwise("LOGGED"))
                 .drop("picked", "t", "alert_key"))


def alerts(events: DataFrame, cooldown: str = "20 seconds", gap: str = "10 seconds",
           tick: str = "1 second", topic: str | None = None,
           config: Config = DEFAULT) -> DataFrame:
    """(ts, source, seq, level, message, status, push).

    `push` holds for notified errors when a topic is set and the mean error rate of
    the source stands at or above the alert threshold.
    """
    marked = materialize(notify(materialize(throttle(events, gap)), cooldown))
    return with_push(marked, rate_table(events, tick, config), tick, topic, config)


def with_push(marked: DataFrame, rates: DataFrame, tick: str, topic: str | None,
              config: Config) -> DataFrame:
    """Add push eligibility from the rate that stood when the alert came up."""
    standing = rates.select("source", "idx", F.col("last_eps").alias("eps"))
    push = (F.lit(bool(topic)) & (F.col("status") == "NOTIFIED") & (F.col("level") == "ERROR")
            & (F.col("eps") >= config.alert_eps))
    return (join_small(standing, marked.withColumn("idx", tick_index(tick)), ["source", "idx"])
            .select("ts", "source", "seq", "level", "message", "status", push.alias("push")))


def format_alert(rows: DataFrame) -> DataFrame:
    """(ts, line) with lines like ``[2026-03-08 15:00:00] [NOTIFIED] ERROR: message``."""
    return rows.select("ts", F.format_string(
        "[%s] [%s] %s: %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "status", "level", "message").alias("line"))
