"""Counts, heartbeat, snapshot and situation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, micros
from ..functions.text import is_signal
from .cluster import recent_summary, top_patterns
from .filters import history
from .rates import current_rates, rate_table, status, trend_arrays

# The columns of the statistics panel.
PANEL_LEVELS = ["ERROR", "WARN", "INFO", "DEBUG"]


def totals(events: DataFrame) -> DataFrame:
    """(source, total_lines)."""
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("total_lines"))


def level_counts(events: DataFrame) -> DataFrame:
    """(source, level, count) for every level that occurs."""
    return events.groupBy("source", "level").agg(F.count(F.lit(1)).alias("count"))


def level_pivot(events: DataFrame) -> DataFrame:
    """One row per source with the counts of the four usual levels and the total."""
    return events.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_lines"),
        *[F.count_if(F.col("level") == level).alias(level.lower()) for level in PANEL_LEVELS])


def last_seen(events: DataFrame) -> DataFrame:
    """(source, last_error_ts, last_warn_ts): times of the last arrived error and warning."""
    def last(level):
        mine = F.col("level") == level
        return F.max_by(F.when(mine, F.col("ts")), F.when(mine, F.col("seq")))
    return events.groupBy("source").agg(last("ERROR").alias("last_error_ts"),
                                        last("WARN").alias("last_warn_ts"))


def window_messages(events: DataFrame, every: str) -> DataFrame:
    """Counts per source, window and signal message; all other rows share a null message.

    The level of a message is that of its last occurrence; 1 stands for ERROR.
    """
    signal = is_signal("level")
    return (events.select("source", F.window("ts", every).alias("window"),
                          F.when(signal, F.col("message")).alias("message"),
                          F.when(signal, F.col("seq")).alias("seq"), "level", "ts")
                  .groupBy("source", "window", "message")
                  .agg(F.count(F.lit(1)).alias("count"),
                       F.count_if(F.col("level") == "ERROR").alias("errors"),
                       F.count_if(F.col("level") == "WARN").alias("warns"),
                       F.count_if(F.col("level") == "INFO").alias("infos"),
                       F.max_by(F.when(F.col("level") == "ERROR", 1).otherwise(0), "seq")
                        .alias("is_error"),
                       F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"))
                  .withColumn("window_start", F.col("window.start")).drop("window"))


def merged_window_messages(parts: DataFrame) -> DataFrame:
    """Sum of several parts of `window_messages`."""
    return parts.groupBy("source", "window_start", "message").agg(
        *[F.sum(c).alias(c) for c in ("count", "errors", "warns", "infos")],
        F.max_by("is_error", "last_seq").alias("is_error"), F.max("last_seq").alias("last_seq"),
        F.max("last_ts").alias("last_ts"))


def heartbeat(events: DataFrame, every: str = "60 minutes") -> DataFrame:
    """Periodic report per source: counts, the top issue and the report text.

    The top issue is the most frequent error message, else the most frequent
    warning message, else ``None``.
    """
    return heartbeat_of(window_messages(events, every), every)


def heartbeat_of(counts: DataFrame, every: str) -> DataFrame:
    """Heartbeat of message counts per window."""
    seen = F.col("message").isNotNull()
    rank = F.struct(1 - F.col("is_error"), -F.col("count"), F.col("message"))
    top = F.min(F.when(seen, F.struct(rank.alias("rank"), F.col("count")))).alias("top")
    rows = counts.groupBy("source", "window_start").agg(
        F.sum("errors").alias("errors"), F.sum("warns").alias("warns"),
        F.sum("infos").alias("infos"), top)
    issue = (F.when(F.col("top").isNull(), "None (0 times)")
              .otherwise(F.format_string("[%s] %s (%d times)",
                                         F.when(F.col("top.rank.col1") == 0, "ERROR").otherwise("WARN"),
                                         F.col("top.rank.message"), F.col("top.count"))))
    minutes = round(micros(every) / 60_000_000)
    span = f"{minutes // 60}h{minutes % 60}m0s" if minutes >= 60 else (
        f"{minutes}m0s" if minutes else "0s")
    text = F.format_string(
        f"HEARTBEAT [%s]\nDuration: {span}\nErrors: %d | Warns: %d | Info: %d\nTop Issue: %s\n",
        F.date_format("window_start", "HH:mm"), F.col("errors"), F.col("warns"), F.col("infos"),
        F.col("top_issue"))
    return (rows.withColumn("top_issue", issue)
                .select("source", "window_start", "errors", "warns", "infos", "top_issue",
                        text.alias("report")))


def top_issue(events: DataFrame, every: str = "60 minutes") -> DataFrame:
    """(source, window_start, top_issue)."""
    return heartbeat(events, every).select("source", "window_start", "top_issue")


def heartbeat_lines(events: DataFrame, every: str = "60 minutes") -> DataFrame:
    """Heartbeats as alert-log lines, stamped with the end of their window."""
    end = F.timestamp_micros(F.unix_micros("window_start") + micros(every))
    return heartbeat(events, every).select("source", F.format_string(
        "[%s] System Heartbeat: %s", F.date_format(end, "yyyy-MM-dd HH:mm:ss"),
        F.col("report")).alias("line"))


def snapshot_row(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT) -> DataFrame:
    """One row per source with everything that has a bounded size."""
    return (level_pivot(events).join(last_seen(events), "source")
            .join(status(current_rates(events, tick, config), config), "source")
            .join(trend_arrays(events, config.rolling_ticks, tick), "source"))


def snapshot(events: DataFrame, tick: str = "1 second",
             config: Config = DEFAULT) -> dict[str, DataFrame]:
    """All parts of the live view: the row per source, levels, patterns and the newest rows."""
    return {"summary": snapshot_row(events, tick, config),
            "levels": level_counts(events),
            "top_patterns": top_patterns(events),
            "sample": history(events, config.sample_rows)}


def situation_report(events: DataFrame, every: str = "60 seconds", tick: str = "1 second",
                     config: Config = DEFAULT) -> DataFrame:
    """Rates and patterns of every window with signals, as text for whoever analyses it.

    Rates are those at the last tick of the window.
    """
    step = micros(every) // micros(tick)
    if step * micros(tick) != micros(every):
        raise ValueError("a report window must be a whole number of ticks")
    summary = recent_summary(events, every)
    last = F.floor((F.unix_micros("window_start") + micros(every)) / micros(tick)) - 1
    marked = summary.withColumn("idx", last.cast("bigint"))
    rates = rate_table(events, tick, config, marks=marked.select("source", "idx"))
    text = F.format_string(
        "[TELEMETRY]\n- Errors/sec: %.2f avg | %.1f peak\n- Warns/sec:  %.2f avg | %.1f peak\n\n"
        "[ERROR PATTERNS]\n%s\n\n[WARNING PATTERNS]\n%s",
        "eps", "peak_eps", "wps", "peak_wps", "errors", "warns")
    return (marked.join(rates.select("source", "idx", "eps", "wps", "peak_eps", "peak_wps"),
                        ["source", "idx"])
                  .select("source", "window_start", "eps", "peak_eps", "wps", "peak_wps",
                          text.alias("report")))
