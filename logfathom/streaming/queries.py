"""Streaming forms of the operators.

Files of different sources reach a stream in any order, so nothing here depends on one watermark
for all of them. Counts of windows are additive: each batch writes its part under its own number,
and readers add the parts up, so late rows correct their window. Parts are merged by levels as the
stream goes on (sources.parts). A window is closed when its own
source has moved on; readers tell closed windows from open ones.

Alerts look across sources and are judged anew from where a batch begins. Incidents are judged source
by source: a batch goes on from what is known after the last tick before its own, or goes back to it
when rows come late, and what was reported after that tick is replaced. Every batch writes under its own number, so a repeated batch replaces its output
instead of adding to it. Memories older than the last batch are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, SIGNAL_LEVELS, Config, micros
from ..functions.text import is_signal
from ..operators import alerts as A
from ..operators import cluster as C
from ..operators import incidents as I
from ..operators import parse as R
from ..operators import reports as G
from ..operators.filters import signals
from ..operators.rates import tick_counts, tick_index, tick_time
from ..plans.running import rolling_ticks
from ..plans.scale import delete_path, join_small, last_number, materialize, path_exists, temporary_tables
from ..sources.logs import detect_sources, stream_logs
from ..sources.parts import Parts
from ..sources.state import partials, save_state

# Columns of the tables remembered between batches.
TICKS_DDL = "source string, idx bigint, errors bigint, warns bigint"
JUDGED_DDL = ("source string, since bigint, upto bigint, last bigint, reported bigint, low bigint, "
              "top_errors bigint, top_warns bigint")
ALERTS_DDL = ("ts timestamp, source string, seq bigint, level string, message string, status string, "
              "push boolean")
SIGNALS_DDL = "source string, seq bigint, ts timestamp, level string, message string"
OPEN_DDL = ("source string, idx bigint, t bigint, errors bigint, warns bigint, seq bigint, "
            "code bigint")
MARKS_DDL = "source string, mark bigint"
OPEN_COLUMNS = ("source", "idx", "t", "errors", "warns", "seq", "code")
#: Stands before every tick.
BEFORE_ALL = -(1 << 62)
#: Batches whose last states are kept; a source that goes back further is judged from its beginning.
JUDGED_BATCHES = 64

AVAILABLE_NOW = {"availableNow": True}


def stream_events(spark: SparkSession, path: str, formats: DataFrame | str | None = None, source=None,
                  start_after: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Events of a folder of rotated log files, ordered by time.

    `source` may be a function from the file path column to the source name. Without `formats`
    the sources present at the start are detected by their first lines; in later ones a line
    that begins with a brace is JSON.
    """
    raw = stream_logs(spark, path, start_after, max_files_per_trigger)
    if source is not None:
        raw = raw.withColumn("source", source("source"))
    if formats is None:
        known = detect_sources(spark, path, source).withColumnRenamed("format", "known")
        raw = raw.join(known, "source", "left").withColumn("format", F.coalesce(
            "known", F.when(F.startswith("line", F.lit("{")), "json").otherwise("text")))
    return R.order_by_time(R.parse_logs(raw, formats or R.IN_ROWS))


def timed(batch: DataFrame) -> DataFrame:
    """Rows of a batch, lines without a time at the last time their source has in the batch.

    A file's own time of change, which may be far from what it tells of, is used only where a
    source has no timed line at all.
    """
    latest = batch.groupBy("source").agg(F.max("event_ts").alias("_latest"))
    return batch.join(latest, "source").withColumn(
        "ts", F.coalesce("event_ts", "_latest", "ingest_ts")).drop("_latest")


def _start(rows: DataFrame, step, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (rows.writeStream.foreachBatch(step).outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def _write(rows: DataFrame, path: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _remembered(spark: SparkSession, path: str, epoch: int, name: str, ddl: str) -> DataFrame:
    """A table the batch before left behind. Only the first batch has nothing to remember;
    a table missing later is an error, not an empty memory."""
    if epoch == 0:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/epoch={epoch - 1}/{name}")


def _before(spark: SparkSession, path: str, epoch: int, ddl: str) -> DataFrame:
    """What the batches before this number wrote, with the number of each as ``epoch``."""
    if last_number(spark, path) is None:
        return spark.createDataFrame([], f"{ddl}, epoch bigint")
    return spark.read.schema(f"{ddl}, epoch bigint").parquet(path).filter(F.col("epoch") < epoch)


def start_counts(events: DataFrame, path: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Running totals, levels, patterns and variants as a saved state (see sources.state)."""
    return _start(events, lambda batch, epoch: save_state(partials(timed(batch), epoch), path, epoch),
                  checkpoint, trigger)


def _start_parts(events: DataFrame, path: str, checkpoint: str, part, merge, trigger) -> StreamingQuery:
    def step(batch: DataFrame, epoch: int) -> None:
        Parts(batch.sparkSession, path, merge).commit(part(timed(batch)), epoch)

    return _start(events, step, checkpoint, trigger)


def _closed(windows: DataFrame, end, delay: str | None) -> DataFrame:
    """Windows that their own source has left behind by `delay`; all of them without a delay.

    `windows` has the time of its last row as ``last_ts``.
    """
    if delay is None:
        return windows
    marks = windows.groupBy("source").agg(F.max("last_ts").alias("_mark"))
    over = F.unix_micros(end) + micros(delay) <= F.unix_micros("_mark")
    return windows.join(marks, "source").filter(over).drop("_mark")


def start_ticks(events: DataFrame, path: str, checkpoint: str, tick: str = "1 second",
                trigger=None) -> StreamingQuery:
    def part(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("source", tick_index(tick).alias("idx"))
                .agg(F.count_if(F.col("level") == "ERROR").alias("errors"),
                     F.count_if(F.col("level") == "WARN").alias("warns"), F.max("ts").alias("last_ts")))

    return _start_parts(events, path, checkpoint, part, _merged_ticks, trigger)


def _merged_ticks(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source", "idx").agg(
        F.sum("errors").alias("errors"), F.sum("warns").alias("warns"), F.max("last_ts").alias("last_ts"))


def read_ticks(spark: SparkSession, path: str, tick: str = "1 second",
               delay: str | None = None) -> DataFrame:
    """(source, tick, errors, warns): all ticks so far, or with a delay those that are closed."""
    rows = _merged_ticks(Parts(spark, path).read())
    end = F.timestamp_micros((F.col("idx") + 1) * micros(tick))
    return _closed(rows, end, delay).select("source", tick_time(tick).alias("tick"), "errors", "warns")


def start_heartbeat(events: DataFrame, path: str, checkpoint: str, every: str = "60 minutes",
                    trigger=None) -> StreamingQuery:
    """Parts of the heartbeats of each source and window."""
    return _start_parts(events, path, checkpoint, lambda rows: G.window_messages(rows, every),
                        G.merged_window_messages, trigger)


def read_heartbeat(spark: SparkSession, path: str, every: str = "60 minutes",
                   delay: str | None = None) -> DataFrame:
    """A heartbeat per source and window: of all windows, or with a delay of closed ones."""
    counts = G.merged_window_messages(Parts(spark, path).read())
    return G.heartbeat_of(_closed(counts, _window_end(every), delay), every)


def start_recent_summary(events: DataFrame, path: str, checkpoint: str, every: str = "60 seconds",
                         trigger=None) -> StreamingQuery:
    """Parts of the message counts of each source and window."""
    return _start_parts(events, path, checkpoint,
                        lambda rows: C.all_window_message_counts(rows, every), C.merged_window_counts, trigger)


def read_recent_summary(spark: SparkSession, path: str, every: str = "60 seconds", k: int = 3,
                        delay: str | None = None) -> DataFrame:
    """The top patterns of every window, or with a delay of closed ones."""
    counts = _closed(C.merged_window_counts(Parts(spark, path).read()), _window_end(every), delay)
    return C.recent_summary_of(counts.filter("message is not null"), k)


def _window_end(every: str):
    return F.timestamp_micros(F.unix_micros("window_start") + micros(every))


def _forget(spark: SparkSession, path: str, epoch: int) -> None:
    """Delete memories that no batch reads again; the one before stays for a repeated batch."""
    if epoch > 1:
        delete_path(spark, f"{path}/epoch={epoch - 2}")


def signal_times(events: DataFrame, tick: str) -> DataFrame:
    """Ticks, reduced to one row per distinct signal time (and one for the rest)."""
    signal = is_signal("level")
    return (events.select("source", tick_index(tick).alias("idx"),
                          F.when(signal, F.unix_micros("ts")).alias("t"), "seq", "level",
                          I.level_code().alias("code"))
                  .groupBy("source", "idx", "t")
                  .agg(F.count_if(F.col("level") == "ERROR").alias("errors"),
                       F.count_if(F.col("level") == "WARN").alias("warns"),
                       F.min("seq").alias("seq"),
                       F.min_by("code", "seq").cast("bigint").alias("code")))


def _merged_times(parts: DataFrame, *more: str) -> DataFrame:
    """Sum of several parts of `signal_times`."""
    return parts.groupBy("source", *more, "idx", "t").agg(
        F.sum("errors").alias("errors"), F.sum("warns").alias("warns"),
        F.min_by("code", "seq").alias("code"), F.min("seq").alias("seq"))


def _incident_step(spark: SparkSession, path: str, epoch: int, rows: DataFrame | None,
                   tick: str, config: Config, delay: str) -> None:
    """Judge the ticks that their own source has left behind; all of them without new rows.

    Counts of ticks and signal times are kept as parts. A source whose rows come late is judged anew
    from the last tick before them after which its state is known, and what it reported after that
    tick is taken back.
    """
    state = f"{path}/state"
    here = f"{state}/epoch={epoch}"
    waiting = _remembered(spark, state, epoch, "open", OPEN_DDL)
    marks = _remembered(spark, state, epoch, "marks", MARKS_DDL)
    if rows is None:
        closed, still = waiting, waiting.limit(0)
    else:
        new = materialize(signal_times(rows, tick))
        # Only times that lines tell of move a source on.
        now = rows.groupBy("source").agg(F.unix_micros(F.max("event_ts")).alias("mark"))
        marks = materialize(marks.unionByName(now).groupBy("source").agg(F.max("mark").alias("mark")))
        limit = F.floor((F.col("mark") - micros(delay)) / micros(tick))
        found = materialize(
            _merged_times(waiting.unionByName(new.select(*waiting.columns)))
            .join(marks.select("source", limit.alias("limit")), "source", "left"))
        over = F.coalesce(F.col("idx") < F.col("limit"), F.lit(False))
        closed, still = found.filter(over).drop("limit"), found.filter(~over).drop("limit")
    parts = Parts(spark, f"{path}/parts", _merged_times, F.col("idx"), OPEN_DDL)
    judged = _before(spark, f"{path}/judged", epoch, JUDGED_DDL).filter(F.col("epoch") >= epoch - JUDGED_BATCHES)
    begin = materialize(_entries(closed, judged))
    # Ticks from there on, and as many before as a rolling rate looks back.
    back = 2 * config.rolling_ticks
    lowest = begin.agg(F.coalesce(F.min("since"), F.lit(-BEFORE_ALL))).first()[0]
    earlier = materialize(join_small(parts.read(lowest - back, epoch).filter(F.col("idx") > F.lit(lowest - back)),
                                     begin.select("source", "since"), ["source"])
                          .filter(F.col("idx") > F.col("since") - back))
    rows = earlier.select(*OPEN_COLUMNS, "since").unionByName(
        join_small(closed, begin.select("source", "since"), ["source"]).select(*OPEN_COLUMNS, "since"))
    rows = materialize(_merged_times(rows, "since"))
    series = materialize(rows.groupBy("source", "idx").agg(
        F.sum("errors").alias("errors"), F.sum("warns").alias("warns"),
        F.bool_or(F.col("idx") > F.col("since")).alias("new")))
    carry = begin.filter("low IS NOT NULL").select("source", "low", "top_errors", "top_warns")
    rules = materialize(I.trigger_rules(rolling_ticks(series, config.rolling_ticks, carry=carry), config)
                        .filter("new").select(*I.RULE_COLUMNS))
    found = I.report_times(rules, rows.filter("t IS NOT NULL AND idx > since").drop("since"), tick, config,
                           SIGNAL_LEVELS, begin.select("source", "last"))
    found = materialize(
        found.join(begin.select("source", "reported"), "source", "left")
        .withColumn("after_recovery", F.col("after_recovery") | (
            F.col("window_start").isNull() & F.col("reported").isNotNull()))
        .drop("reported"))
    _write(found, f"{path}/incidents", epoch)
    _write(earlier.filter("idx > since").select("source", "since").distinct(), f"{path}/rewound", epoch)
    newest = found.groupBy("source").agg(F.unix_micros(F.max("incident_ts")).alias("newest"))
    recovered = rules.filter("recovered").groupBy("source").agg((F.max("idx") * micros(tick)).alias("reset"))
    seen = series.filter("new").groupBy("source").agg(
        F.max("idx").alias("upto"), F.min("idx").alias("low_now"), F.max("errors").alias("errors_now"),
        F.max("warns").alias("warns_now"))
    last = F.greatest("newest", "last")
    _write(begin.join(seen, "source").join(newest, "source", "left").join(recovered, "source", "left").select(
        "source", "since", "upto",
        F.when(F.col("reset").isNull() | (F.col("reset") <= last), last).alias("last"),
        F.greatest("newest", "reported").alias("reported"), F.least("low", "low_now").alias("low"),
        F.greatest("top_errors", "errors_now").alias("top_errors"),
        F.greatest("top_warns", "warns_now").alias("top_warns")), f"{path}/judged", epoch)
    parts.commit(closed.select(*OPEN_COLUMNS), epoch)
    still.select(*OPEN_COLUMNS).write.mode("overwrite").parquet(f"{here}/open")
    marks.write.mode("overwrite").parquet(f"{here}/marks")
    delete_path(spark, f"{path}/judged/epoch={epoch - JUDGED_BATCHES - 1}")
    _forget(spark, state, epoch)


def _entries(closed: DataFrame, judged: DataFrame) -> DataFrame:
    """Per source of these ticks what was known after the last tick before them: since (that tick),
    last, reported, low, top_errors, top_warns; from before all ticks where nothing is known.

    ``judged`` has what each batch knew after its last tick (upto), and from where it had judged. A
    batch that went back behind a tick has taken back what was known there.
    """
    later = Window.partitionBy("source").orderBy(F.desc("epoch")).rowsBetween(Window.unboundedPreceding, -1)
    holds = judged.withColumn("back", F.min("since").over(later)).filter("back IS NULL OR back >= upto")
    first = closed.groupBy("source").agg(F.min("idx").alias("first"))
    known = ("upto", "last", "reported", "low", "top_errors", "top_warns")
    best = holds.join(first, "source").filter("upto < first").groupBy("source").agg(
        F.max_by(F.struct(*known), "upto").alias("known"))
    return first.join(best, "source", "left").select(
        "source", F.coalesce("known.upto", F.lit(BEFORE_ALL)).alias("since"), *[f"known.{c}" for c in known[1:]])


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incidents that hold: those that no later batch has judged anew."""
    rows = spark.read.parquet(f"{path}/incidents")
    rewound = spark.read.parquet(f"{path}/rewound").groupBy("source", F.col("epoch").alias("by")).agg(
        F.min("since").alias("since"))
    return rows.join(rewound, (rows["source"] == rewound["source"]) & (F.col("epoch") < F.col("by"))
                     & (F.col("idx") > F.col("since")), "left_anti")


def start_incidents(events: DataFrame, path: str, checkpoint: str, tick: str = "1 second",
                    config: Config = DEFAULT, delay: str = "10 seconds", trigger=None) -> StreamingQuery:
    """Incidents, found when their source has left their tick behind by `delay`; rows that come later
    than that have their source judged anew from there. `read_incidents` has those that hold, and
    `finish_incidents` judges the ticks that are open when a stream has ended."""
    def step(batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):
            rows = materialize(timed(batch).select("source", "event_ts", "ts", "seq", "level"))
            _incident_step(batch.sparkSession, path, epoch, rows, tick, config, delay)

    return _start(events, step, checkpoint, trigger)


def finish_incidents(spark: SparkSession, path: str, tick: str = "1 second",
                     config: Config = DEFAULT) -> None:
    """End of input: judge what is still open, as a batch of its own after the last one.

    The stream is not to be resumed afterwards.
    """
    newest = last_number(spark, f"{path}/state")
    if newest is not None:
        with temporary_tables(spark):
            _incident_step(spark, path, newest + 1, None, tick, config, "0 seconds")


def _summed_ticks(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source", "idx").agg(F.sum("errors").alias("errors"), F.sum("warns").alias("warns"))


def start_alerts(events: DataFrame, path: str, checkpoint: str, cooldown: str = "20 seconds",
                 gap: str = "10 seconds", tick: str = "1 second", topic: str | None = None,
                 config: Config = DEFAULT, trigger=None) -> StreamingQuery:
    """Throttled alerts under ``path/alerts``: at any time those of all rows so far.

    The cooldowns run across sources, so a row that arrives late, as those of a source that lags
    behind, can change every alert after it. Signals and tick counts are kept as parts, of which those
    that end before a batch begins are not read for their signals, and alerts
    from the first tick of a batch on are judged anew. The folder of the batch then replaces those of
    earlier batches that held some of them.
    """
    width = micros(tick)

    def step(batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):
            judge(batch, epoch)

    def judge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = materialize(timed(batch).select("source", "seq", "ts", "level", "message"))
        began = rows.agg(F.unix_micros(F.min("ts"))).first()[0]
        if began is None and epoch:
            return
        start = (began or 0) // width * width
        done = (_before(spark, f"{path}/alerts", epoch, ALERTS_DDL)
                .withColumn("late", F.unix_micros("ts") >= start))
        # Few: batches that come in the order of time overlap with the one before at most.
        replaced = [r["epoch"] for r in done.filter("late").select("epoch").distinct().collect()]
        # A repeated batch that was already written only has to finish the replacement.
        if not path_exists(spark, f"{path}/alerts/epoch={epoch}/_SUCCESS"):
            kept = Parts(spark, f"{path}/signals", span=F.unix_micros("ts"), ddl=SIGNALS_DDL)
            kept.commit(signals(rows), epoch)
            counted = Parts(spark, f"{path}/ticks", _summed_ticks, F.col("idx"), TICKS_DDL)
            counted.commit(tick_counts(rows, tick), epoch)
            before = done.filter("NOT late")
            again = kept.read(start, epoch + 1).filter(F.col("ts") >= F.timestamp_micros(F.lit(start)))
            last = F.max(F.unix_micros("ts")).alias("last")
            taken = materialize(A.throttle(again, gap, before.agg(last)))
            key = F.when(F.col("level") == "WARN", "WARN").otherwise("ERROR").alias("alert_key")
            marked = materialize(A.notify(taken, cooldown, before.filter("status = 'NOTIFIED'")
                                          .groupBy(key).agg(last)))
            _write(A.with_push(marked, rates(counted, epoch, start // width), tick, topic, config)
                   .unionByName(before.filter(F.col("epoch").isin(replaced)).drop("epoch", "late")),
                   f"{path}/alerts", epoch)
        for number in replaced:
            delete_path(spark, f"{path}/alerts/epoch={number}")

    def rates(counted: Parts, epoch: int, first: int) -> DataFrame:
        """Rate table of the ticks from `first` on, over the parts of all batches."""
        edge = first - config.rolling_ticks
        reach = F.col("idx") >= edge
        carry = _summed_ticks(counted.read(before=epoch + 1).filter(~reach)).groupBy("source").agg(
            F.min("idx").alias("low"), F.max("errors").alias("top_errors"), F.max("warns").alias("top_warns"))
        series = materialize(_summed_ticks(counted.read(edge, epoch + 1).filter(reach)))
        return rolling_ticks(series, config.rolling_ticks, carry=carry).filter(F.col("idx") >= first)

    return _start(events, step, checkpoint, trigger)
