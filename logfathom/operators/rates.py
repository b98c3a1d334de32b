"""Error and warning rates on event-time ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, micros
from ..functions.text import health
from ..plans.running import rolling_ticks
from ..plans.scale import join_small


def tick_index(tick: str, c="ts") -> Column:
    """Number of whole ticks since the epoch."""
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(value) / micros(tick)).cast("bigint")


def tick_time(tick: str, c="idx") -> Column:
    return F.timestamp_micros(F.col(c) * micros(tick))


def tick_counts(events: DataFrame, tick: str = "1 second") -> DataFrame:
    """(source, idx, errors, warns) of every tick that has an event of any level.

    Events without a time belong to no tick.
    """
    return (events.filter(F.col("ts").isNotNull()).select("source", tick_index(tick).alias("idx"),
                          (F.col("level") == "ERROR").alias("e"),
                          (F.col("level") == "WARN").alias("w"))
                  .groupBy("source", "idx")
                  .agg(F.count_if("e").alias("errors"), F.count_if("w").alias("warns")))


def ticks(events: DataFrame, tick: str = "1 second") -> DataFrame:
    """(source, tick, errors, warns) per tumbling tick."""
    return tick_counts(events, tick).select("source", tick_time(tick).alias("tick"),
                                            "errors", "warns")


def trend(events: DataFrame, n: int = 60, tick: str = "1 second") -> DataFrame:
    """The last n ticks of every source up to its last event, quiet ticks as zeros."""
    counts = tick_counts(events, tick)
    ends = counts.groupBy("source").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    frame = ends.select("source", F.explode(F.sequence(
        F.greatest(F.col("low"), F.col("high") - (n - 1)), F.col("high"))).alias("idx"))
    return (frame.join(counts, ["source", "idx"], "left")
                 .select("source", tick_time(tick).alias("tick"),
                         F.coalesce("errors", F.lit(0)).alias("errors"),
                         F.coalesce("warns", F.lit(0)).alias("warns")))


def trend_arrays(events: DataFrame, n: int = 60, tick: str = "1 second") -> DataFrame:
    """(source, trend_error, trend_warn) with at most n entries, oldest first."""
    rows = F.array_sort(F.collect_list(F.struct("tick", "errors", "warns")))
    return (trend(events, n, tick).groupBy("source").agg(rows.alias("rows"))
            .select("source", F.col("rows.errors").alias("trend_error"),
                    F.col("rows.warns").alias("trend_warn")))


def rate_table(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT,
               marks: DataFrame | None = None) -> DataFrame:
    """Ticks with rolling means, running peaks and the values before each tick.

    `marks` adds (source, idx) rows at which the values are wanted although nothing
    may have happened there.
    """
    counts = tick_counts(events, tick)
    if marks is not None:
        zero = marks.select("source", "idx", F.lit(0).alias("errors"), F.lit(0).alias("warns"))
        counts = (counts.unionByName(zero).groupBy("source", "idx")
                        .agg(F.sum("errors").alias("errors"), F.sum("warns").alias("warns")))
    return (rolling_ticks(counts, config.rolling_ticks)
            .withColumn("tick", tick_time(tick)))


def rolling_rate(events: DataFrame, n: int = 60, tick: str = "1 second") -> DataFrame:
    """(source, tick, eps, wps): mean counts of the last n ticks, fewer at the start."""
    return (rolling_ticks(tick_counts(events, tick), n)
            .select("source", tick_time(tick).alias("tick"), "eps", "wps"))


def running_peak(events: DataFrame, tick: str = "1 second") -> DataFrame:
    """(source, tick, peak_eps, peak_wps): the highest tick so far."""
    return (rolling_ticks(tick_counts(events, tick), 1)
            .select("source", tick_time(tick).alias("tick"), "peak_eps", "peak_wps"))


def peak_rate(events: DataFrame, tick: str = "1 second") -> DataFrame:
    """(source, peak_eps, peak_wps) over everything."""
    return tick_counts(events, tick).groupBy("source").agg(
        F.max("errors").cast("double").alias("peak_eps"),
        F.max("warns").cast("double").alias("peak_wps"))


def current_rates(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT) -> DataFrame:
    """(source, eps, wps, peak_eps, peak_wps) as of the last tick of every source."""
    counts = tick_counts(events, tick)
    ends = counts.groupBy("source").agg(
        F.min("idx").alias("low"), F.max("idx").alias("high"),
        F.max("errors").cast("double").alias("peak_eps"),
        F.max("warns").cast("double").alias("peak_wps"))
    n = config.rolling_ticks
    span = F.least(F.lit(n), F.col("high") - F.col("low") + 1)
    # A join on the source alone would gather all ticks of a source in one task.
    return (join_small(counts, ends, ["source"])
                  .filter(F.col("idx") > F.col("high") - n)
                  .groupBy("source", "low", "high", "peak_eps", "peak_wps")
                  .agg((F.sum("errors")).alias("errors"), F.sum("warns").alias("warns"))
                  .select("source", (F.col("errors") / span).alias("eps"),
                          (F.col("warns") / span).alias("wps"), "peak_eps", "peak_wps"))


def status(rates: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add the health label to a table with eps and wps."""
    return rates.withColumn("status", health("eps", "wps", config))


def normalize_trend(series: DataFrame, value: str = "errors") -> DataFrame:
    """Scale a short series per source to 0..1 on a log axis, with the axis labels.

    Nearly flat series are scaled from zero, so that noise is not blown up.
    """
    whole = Window.partitionBy("source")
    log = F.log1p(F.col(value).cast("double"))
    flat = (F.col("_max") - F.col("_min")) < 0.01
    low = F.when(flat, 0.0).otherwise(F.col("_min"))
    span = (F.when(~flat, F.col("_max") - F.col("_min"))
             .when(F.col("_max") == 0, 1.0).otherwise(F.col("_max")))
    return (series.withColumn("_log", log)
                  .withColumn("_max", F.max("_log").over(whole))
                  .withColumn("_min", F.min("_log").over(whole))
                  .select("source", "tick", ((F.col("_log") - low) / span).alias("scaled"),
                          F.round(F.expm1("_max")).cast("bigint").alias("axis_max"),
                          F.round(F.expm1(low)).cast("bigint").alias("axis_min")))
