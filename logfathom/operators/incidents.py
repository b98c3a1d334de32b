"""Spike detection and incident reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, LEVEL_WEIGHTS, SIGNAL_LEVELS, Config, micros
from ..functions.text import is_signal, level_weight
from ..plans.cooldown import cooldown_picks
from ..plans.position import count_until, kind_counts, kind_ranks, rows_before
from ..plans.running import rolling_ticks
from ..plans.scale import join_small, materialize
from .filters import min_level, signals
from .rates import rate_table, tick_counts, tick_index


def trigger_ticks(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT) -> DataFrame:
    """Rate table with the rule outcome that holds during each tick.

    critical   the mean error rate stands at or above the critical threshold
    spike      otherwise: the last tick reached the minimum and a multiple of the mean
    recovered  both means stand below the minimum, which forgets the last report
    All are judged on completed ticks, so nothing holds in the first tick of a source.
    """
    return trigger_rules(rate_table(events, tick, config), config)


def trigger_rules(rates: DataFrame, config: Config) -> DataFrame:
    ran = F.col("age") >= 1
    critical = ran & (F.col("last_eps") >= config.eps_critical)
    spike = (ran & ~critical & (F.col("last_errors") >= config.eps_warn)
             & (F.col("last_errors") > config.spike_factor * F.col("last_eps")))
    recovered = ran & (F.col("last_eps") < config.eps_warn) & (F.col("last_wps") < config.eps_warn)
    return (rates.withColumn("critical", critical).withColumn("spike", spike)
                 .withColumn("recovered", recovered))


def _flagged(rules: DataFrame) -> DataFrame:
    return rules.filter("critical or spike").select("source", "idx", "critical")


def spike_candidates(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT,
                     levels=SIGNAL_LEVELS) -> DataFrame:
    """Signals that meet the trigger rule: (source, seq, ts, level, message, rule)."""
    rows = signals(events, levels).withColumn("idx", tick_index(tick))
    return (join_small(rows, _flagged(trigger_ticks(events, tick, config)), ["source", "idx"])
            .select("source", "seq", "ts", "level", "message",
                    F.when(F.col("critical"), "critical").otherwise("spike").alias("rule")))


def incidents(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT,
              levels=SIGNAL_LEVELS, counts: DataFrame | None = None) -> DataFrame:
    """One row per report: the candidates that pass the cooldown.

    (source, incident_ts, trigger_seq, level, window_start, after_recovery, peak_eps,
    peak_wps). `window_start` is the time of the report before, null when there is
    none or the source recovered since. `counts` are the tick counts of the events, where known.
    """
    counts = tick_counts(events, tick) if counts is None else counts
    rules = materialize(trigger_rules(rolling_ticks(counts, config.rolling_ticks), config).select(*RULE_COLUMNS))
    rows = signals(events, levels).select("source", "seq", F.unix_micros("ts").alias("t"),
                                          level_code(levels).alias("code"),
                                          tick_index(tick).alias("idx"))
    return report_times(rules, rows, tick, config, levels)


RULE_COLUMNS = ("source", "idx", "critical", "spike", "recovered", "last_peak_eps", "last_peak_wps")


def level_code(levels=SIGNAL_LEVELS):
    return F.array_position(F.array(*[F.lit(level) for level in levels]), F.col("level"))


def report_times(rules: DataFrame, rows: DataFrame, tick: str, config: Config,
                 levels=SIGNAL_LEVELS, entry: DataFrame | None = None) -> DataFrame:
    """Fold of trigger rules (per tick) and signals (source, idx, t, seq, code) into reports.

    `entry` holds the last report time per source, as (source, last) in microseconds.
    """
    slow = micros(config.spike_cooldown)
    fast = micros(config.critical_cooldown)
    # One row per distinct time: the first signal to arrive at that time is the trigger.
    found = materialize(
        join_small(rows, _flagged(rules), ["source", "idx"])
        .groupBy("source", "idx", "critical", "t")
        .agg(F.min("seq").alias("trigger_seq"), F.min_by("code", "seq").alias("code")))
    timeline = (found.select("source", "t",
                             F.when(F.col("critical"), fast).otherwise(slow)
                              .cast("bigint").alias("cool"), F.lit(False).alias("reset"))
                .unionByName(rules.filter("recovered").select(
                    "source", (F.col("idx") * micros(tick)).alias("t"),
                    F.lit(None).cast("bigint").alias("cool"), F.lit(True).alias("reset"))))
    picks = cooldown_picks(timeline, ["source"], max(min(slow, fast) // 4, 1), entry)
    in_order = Window.partitionBy("source").orderBy("t")
    name = F.element_at(F.array(*[F.lit(level) for level in levels]), F.col("code").cast("int"))
    return (picks.join(found, ["source", "t"])
                 .join(rules.select("source", "idx", "last_peak_eps", "last_peak_wps"),
                       ["source", "idx"])
                 .withColumn("before", F.lag("t").over(in_order))
                 .select("source", F.timestamp_micros("t").alias("incident_ts"), "trigger_seq",
                         name.alias("level"), F.timestamp_micros("last").alias("window_start"),
                         (F.col("last").isNull() & F.col("before").isNotNull())
                         .alias("after_recovery"),
                         F.col("last_peak_eps").alias("peak_eps"),
                         F.col("last_peak_wps").alias("peak_wps"), "idx"))


def _marks(found: DataFrame) -> DataFrame:
    return found.select("source", F.unix_micros("incident_ts").alias("mark"),
                        F.col("trigger_seq").alias("mark_seq"))


def incident_signals(found: DataFrame, events: DataFrame,
                     cap: int | None = DEFAULT.signal_rows, placed: tuple = ()) -> DataFrame:
    """Signals of each incident: of the last `cap` before the trigger, those after the last report.

    Without a cap these are all signals since the last report. Incidents and signals then meet by
    source and day, so a long period is spread over its days. `placed` are the counts and ranks of
    signals for `rows_before`, where known.
    """
    starts = found.select("source", F.unix_micros("incident_ts").alias("mark"),
                          "incident_ts", "window_start")
    if cap is None:
        begun = events.groupBy("source").agg(F.min("ts").alias("begun"))
        frames = (found.join(begun, "source")
                  .select("source", "incident_ts", "window_start", "trigger_seq", F.explode(F.sequence(
                      F.to_date(F.least("incident_ts", F.coalesce("window_start", "begun"))),
                      F.to_date("incident_ts"))).alias("day")))
        recent = signals(events).withColumn("day", F.to_date("ts")).join(frames, ["source", "day"]).filter(
            F.col("seq") <= F.col("trigger_seq"))
    else:
        recent = join_small(rows_before(_marks(found), signals(events), cap, *placed), starts, ["source", "mark"])
    return (recent.filter(F.col("window_start").isNull() | (F.col("ts") > F.col("window_start")))
            .select("source", "incident_ts", "seq", "ts", "level", "message"))


def incident_context(found: DataFrame, events: DataFrame, n: int = DEFAULT.context_rows,
                     level: str | None = None, placed: tuple = ()) -> DataFrame:
    """The last n history rows up to the trigger of each incident.

    `placed` are the counts and ranks of history rows for `rows_before`, where known.
    """
    rows = rows_before(_marks(found), min_level(events, level), n, *placed)
    return rows.select("source", F.timestamp_micros("mark").alias("incident_ts"),
                       "seq", "ts", "level", "message")


def incident_trends(found: DataFrame, events: DataFrame, tick: str = "1 second",
                    n: int = DEFAULT.hourly_ticks, counts: DataFrame | None = None) -> DataFrame:
    """(source, incident_ts, tick index, errors, warns): the n ticks completed before each trigger."""
    counts = tick_counts(events, tick) if counts is None else counts
    starts = counts.groupBy("source").agg(F.min("idx").alias("low"))
    frame = (found.select("source", "incident_ts", "idx").join(starts, "source")
                  .select("source", "incident_ts", F.explode(F.sequence(
                      F.greatest(F.col("low"), F.col("idx") - n), F.col("idx") - 1)).alias("idx")))
    return (frame.join(counts, ["source", "idx"], "left")
                 .select("source", "incident_ts", "idx",
                         F.coalesce("errors", F.lit(0)).alias("errors"),
                         F.coalesce("warns", F.lit(0)).alias("warns")))


def incident_summaries(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT,
                       found: DataFrame | None = None, lines: DataFrame | None = None,
                       begun: DataFrame | None = None) -> DataFrame:
    """Report headers: reason, peaks, total lines and the period covered.

    `lines` (source, mark, total) and `begun` (source, begun) are made here where they are not known.
    """
    found = materialize(incidents(events, tick, config)) if found is None else found
    lines = count_until(_marks(found), events) if lines is None else lines
    if begun is None:
        begun = events.groupBy("source").agg(F.min_by("ts", "seq").alias("begun"))
    stamp = "yyyy-MM-dd'T'HH:mm:ssXXX"
    keyed = found.withColumn("mark", F.unix_micros("incident_ts"))
    return (keyed.join(lines, ["source", "mark"]).join(begun, "source")
            .select("source", "incident_ts",
                    F.concat(F.lit("incident_"), F.date_format("incident_ts", "yyyy-MM-dd_HH-mm-ss"))
                     .alias("incident_id"),
                    F.format_string("Anomaly: %s Spike Detected", "level").alias("reason"),
                    F.round("peak_eps", 2).alias("peak_eps"),
                    F.round("peak_wps", 2).alias("peak_wps"),
                    F.col("total").alias("total_lines"),
                    F.date_format(F.coalesce("window_start", "begun"), stamp).alias("started_at"),
                    F.date_format("incident_ts", stamp).alias("ended_at")))


def incident_reports(events: DataFrame, tick: str = "1 second", config: Config = DEFAULT,
                     level: str | None = None) -> DataFrame:
    """Complete reports, one row per incident.

    The arrays have fixed upper sizes (trend ticks, signals and context rows of the
    configuration), so a report is a bounded row.

    Events are passed over for their ticks, the candidates, the counts of all kinds of rows per stretch of
    positions, the ranks of the triggers, and the signals and rows of context in the stretches that hold some.
    """
    ticks = materialize(tick_counts(events, tick))
    found = materialize(incidents(events, tick, config, counts=ticks))
    kinds = {"lines": F.lit(True), "signals": is_signal("level", SIGNAL_LEVELS),
             "context": level_weight("level") >= LEVEL_WEIGHTS.get((level or "").upper(), 0)}
    stretches = materialize(kind_counts(events, kinds))
    ranks = materialize(kind_ranks(_marks(found), events, stretches, kinds))

    def placed(kind):
        return (stretches.filter(F.col(kind) > 0).select("source", "stretch", F.col(kind).alias("n"),
                                                         F.col(f"before_{kind}").alias("before")),
                ranks.select("source", "mark", F.col(kind).alias("total")))

    begun = stretches.groupBy("source").agg(F.min_by("first_ts", "stretch").alias("begun"))
    heads = incident_summaries(events, tick, config, found, placed("lines")[1], begun)
    key = ["source", "incident_ts"]
    event = F.struct("seq", F.col("ts").alias("timestamp"), "level", "message", "source")

    def listed(rows, name):
        lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(event)).alias("rows"))
        return lists.select(*key, F.transform(
            "rows", lambda r: r.dropFields("seq")).alias(name))

    order = F.array_sort(F.collect_list(F.struct("idx", "errors", "warns")))
    trends = (incident_trends(found, events, tick, config.hourly_ticks, ticks)
              .groupBy(*key).agg(order.alias("rows"))
              .select(*key, F.col("rows.errors").alias("hourly_trend_errors"),
                      F.col("rows.warns").alias("hourly_trend_warns")))
    empty = F.array().cast("array<struct<timestamp: timestamp, level: string, "
                           "message: string, source: string>>")
    return (heads.join(trends, key, "left")
            .join(listed(incident_signals(found, events, config.signal_rows, placed("signals")),
                         "signal_history"), key, "left")
            .join(listed(incident_context(found, events, config.context_rows, level, placed("context")),
                         "full_context"), key, "left")
            .withColumn("signal_history", F.coalesce("signal_history", empty))
            .withColumn("full_context", F.coalesce("full_context", empty)))
