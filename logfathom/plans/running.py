"""Rolling sums and running peaks over per-source tick series.

A tick series is cut into runs of consecutive ticks. Each run also receives the
last ticks of the run before it, so a rolling frame never leaves its run, and the
peaks of earlier runs are carried in from a one-row-per-run summary. One long
series is therefore spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_ticks(ticks: DataFrame, n: int, run: int = 3600,
                  carry: DataFrame | None = None) -> DataFrame:
    """Add rates and peaks to (source, idx, errors, warns), one row per tick.

    eps / wps            mean of the last n ticks up to and including this one
    last_errors          errors in the tick just before (0 when it had no rows)
    last_eps / last_wps  the means as they stood when the tick before completed
    peak_eps / peak_wps  running maximum up to this tick
    last_peak_eps / _wps running maximum before this tick
    age                  number of ticks of the source completed before this one

    Ticks without rows count as zero; they need not be present. `carry` may give
    (source, low, top_errors, top_warns) for ticks before the series: the index of
    the first one and the peaks.
    """
    run = max(run, 8 * n)
    block = F.floor(F.col("idx") / run).cast("bigint")
    summary = (ticks.withColumn("block", block)
                    .groupBy("source", "block")
                    .agg(F.max("errors").alias("top_errors"), F.max("warns").alias("top_warns"),
                         F.min("idx").alias("low")))
    if carry is not None:
        before_all = F.lit(-(1 << 62)).cast("bigint").alias("block")
        summary = summary.unionByName(
            carry.select("source", before_all, "top_errors", "top_warns", "low"))
    earlier = (Window.partitionBy("source").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("source")
    summary = summary.select(
        "source", "block",
        F.coalesce(F.max("top_errors").over(earlier), F.lit(0)).alias("carry_errors"),
        F.coalesce(F.max("top_warns").over(earlier), F.lit(0)).alias("carry_warns"),
        F.min("low").over(whole).alias("first_idx"))

    own = ticks.withColumn("own", block)
    spill = F.pmod(F.col("idx"), F.lit(run)) >= run - n
    halo = own.withColumn("block", F.explode(
        F.when(spill, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))))
    joined = halo.join(summary, ["source", "block"])

    order = Window.partitionBy("source", "block").orderBy("idx")
    recent = order.rangeBetween(-(n - 1), 0)
    before = order.rangeBetween(-n, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    age = F.col("idx") - F.col("first_idx")

    def total(name, frame):
        return F.coalesce(F.sum(name).over(frame), F.lit(0))

    def peak(name, frame):
        return F.greatest(F.coalesce(F.max(name).over(frame), F.lit(0)), F.col(f"carry_{name}"))

    return (joined
            .withColumn("age", age)
            .withColumn("eps", total("errors", recent) / F.least(F.lit(n), F.col("age") + 1))
            .withColumn("wps", total("warns", recent) / F.least(F.lit(n), F.col("age") + 1))
            .withColumn("last_errors", total("errors", order.rangeBetween(-1, -1)))
            .withColumn("last_eps", total("errors", before)
                        / F.greatest(F.least(F.lit(n), F.col("age")), F.lit(1)))
            .withColumn("last_wps", total("warns", before)
                        / F.greatest(F.least(F.lit(n), F.col("age")), F.lit(1)))
            .withColumn("peak_eps", peak("errors", upto).cast("double"))
            .withColumn("peak_wps", peak("warns", upto).cast("double"))
            .withColumn("last_peak_eps", peak("errors", past).cast("double"))
            .withColumn("last_peak_wps", peak("warns", past).cast("double"))
            .filter(F.col("block") == F.col("own"))
            .drop("block", "own", "first_idx", "carry_errors", "carry_warns"))
