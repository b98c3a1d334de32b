"""One query per operator, over the whole driver tables.

Times leave as text with microseconds, so that engines compare alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfathom.config import Config
from logfathom.functions import parsing as P
from logfathom.functions import text as X
from logfathom.operators import alerts as A
from logfathom.operators import cluster as C
from logfathom.operators import filters as L
from logfathom.operators import incidents as I
from logfathom.operators import parse as R
from logfathom.operators import rates as V
from logfathom.operators import reports as G
from logfathom.plans.scale import compute_once, spread, work_path
from logfathom.sources import events as store
from logfathom.sources import logs, reports, state, tables
from logfathom.streaming import queries as S

HOUR = "1 hour"

# The table has a few events per hour, so ticks are hours and thresholds follow suit.
CONFIG = Config(eps_critical=1.6, eps_warn=0.9, critical_cooldown="6 hours",
                spike_cooldown="24 hours", hourly_ticks=48, context_rows=300, signal_rows=100,
                alert_eps=0.9)
IP_PATTERN = "Door code rejected | door=*.*.*.*"


def stamp(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def plain(df: DataFrame) -> DataFrame:
    """Times as text and ints as bigints."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = stamp(c)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(field.name))
    return df.select(*out)


def listing(c) -> Column:
    """An array as comma-separated text."""
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def stamps(c) -> Column:
    return F.array_join(F.transform(c, lambda v: stamp(v)), ",")


def ev(spark, sf):
    return tables.events(spark, sf)


def parsed(spark, sf, layout="logfmt"):
    """Events that went through text: every line is rendered and parsed again."""
    return R.parse_logs(tables.raw_lines(spark, sf, layout))


def _fields(df, struct):
    return compute_once(df, e=struct).select(
        "source", "seq", F.col("e.event_ts").alias("ts"), "e.level", "e.message")


def parser_query(layout, parser):
    def run(spark, sf):
        rows = tables.raw_lines(spark, sf, layout)
        return _fields(rows, parser(F.col("line")))
    return run


def written_lines(spark, sf) -> str:
    """Rendered lines as text files, one folder per source, padded and with blank lines between."""
    path = work_path(spark, "lines")
    lines = tables.raw_lines(spark, sf, "mixed")
    (lines.select("source", F.concat(F.lit(" \t"), "line", F.lit("  \n \t ")).alias("value"))
          .write.partitionBy("source").text(path))
    return path


def scan_lines(spark, sf):
    lines = logs.read_logs(spark, written_lines(spark, sf))
    return lines.select(logs.source_folder().alias("source"), "line")


def multi_source(spark, sf):
    path = written_lines(spark, sf)
    names = [f"svc-{i}-{j}" for i in range(3) for j in range(5)]
    paths = " , ,".join(f"{path}/source={name}" for name in names)
    return (logs.read_logs(spark, paths).groupBy(logs.source_folder().alias("source"))
            .agg(F.count(F.lit(1)).alias("lines")))


def clean_line(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    # Pages are cleaned as well: they hold tabs and line ends that prose does not.
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
                       F.concat(F.lit("\t\r\n\u00a0 "), "text", F.lit(" \u2003\t\r\n")).alias("text")
                       ).unionByName(
        pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
                     F.col("html").alias("text")))
    cleaned = X.clean_line("text")
    return rows.select("id", F.length(cleaned).cast("bigint").alias("n"),
                       F.md5(cleaned).alias("digest"))


def parse_docker(spark, sf):
    rows = R.parse_logs(tables.raw_lines(spark, sf, "container"))
    return rows.select("source", "seq", "ts", "level", "message")


def parse_json_extras(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    line = F.concat(F.lit('{"lvl":"warn","user":'), F.col("user_id").cast("string"),
                    F.lit(',"err":"'), F.col("event_type"), F.lit('","props":'), F.col("props"),
                    F.lit(',"none":null,"ok":true}'))
    return (compute_once(events, fields=P.json_fields(line))
            .select("event_id", P.extra_fields("fields").alias("extras"),
                    P.json_message("fields").alias("message")))


def parse_ts(spark, sf):
    rows = tables.events(spark, sf)
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSSSSS")
    ahead = F.expr("ts + interval 2 hours 30 minutes")
    forms = F.array(
        F.concat(day, F.lit("T"), clock, F.lit("Z")), F.concat(day, F.lit(" "), clock),
        F.concat(day, F.lit(" "), F.replace(clock, F.lit("."), F.lit(","))),
        F.date_format(ahead, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:30'"),
        F.concat(day, F.lit("T"), clock), day, F.unix_micros("ts").cast("string"))
    return (rows.select("seq", F.posexplode(forms).alias("form", "text"))
                .select("seq", "form", P.parse_ts("text").alias("ts")))


def parse_all(spark, sf):
    return parsed(spark, sf, "mixed").select("source", "seq", "ts", "level", "message")


def inspect(spark, sf):
    return C.inspect(ev(spark, sf), IP_PATTERN).withColumn("times", stamps("times"))


def age_label(spark, sf):
    rows = ev(spark, sf)
    newest = rows.agg(F.unix_micros(F.max("ts"))).first()[0]
    return rows.select("seq", X.age_label("ts", F.timestamp_micros(F.lit(newest))).alias("age"))


def fingerprint_docs(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return docs.select("doc_id", F.md5(X.fingerprint("text")).alias("digest"))


def state_merge(spark, sf):
    """Two sessions, the second one resuming the first, give the counts of one."""
    path = work_path(spark, "state")
    rows = ev(spark, sf)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    state.save_state(state.partials(rows.filter(early), 1), path, 1)
    state.save_state(state.partials(rows.filter(~early), 2), path, 2)
    return state.state_patterns(state.load_state(spark, path))


def snapshot(spark, sf):
    rows = G.snapshot_row(ev(spark, sf), HOUR)
    return (rows.withColumn("trend_error", listing("trend_error"))
                .withColumn("trend_warn", listing("trend_warn")))


def incident_reports(spark, sf):
    rows = I.incident_reports(ev(spark, sf), HOUR, CONFIG)
    return rows.select(
        "source", "incident_ts", "incident_id", "reason", "peak_eps", "peak_wps", "total_lines",
        "started_at", "ended_at", listing("hourly_trend_errors").alias("hourly_trend_errors"),
        listing("hourly_trend_warns").alias("hourly_trend_warns"),
        F.size("signal_history").alias("n_signals"), F.size("full_context").alias("n_context"),
        F.array_join(F.col("signal_history.message"), ",").alias("signal_messages"))


def incident_list(spark, sf):
    path = work_path(spark, "incidents")
    reports.write_incidents(I.incident_reports(ev(spark, sf), HOUR, CONFIG), path)
    return reports.list_incidents(spark, path)


def incident_fetch(spark, sf):
    """The documents of all listed incidents, as the fields that an incident page shows first."""
    path = work_path(spark, "incidents")
    reports.write_incidents(I.incident_reports(ev(spark, sf), HOUR, CONFIG), path)
    found = reports.fetch_incidents(reports.list_incidents(spark, path), path)
    row = "struct<message: string>"
    body = F.from_json("document", f"total_lines long, signal_history array<{row}>, full_context array<{row}>")
    return found.select("source", "filename", body.alias("d")).select(
        "source", "filename", "d.total_lines",
        F.array_join("d.signal_history.message", ",").alias("signal_messages"),
        F.array_join("d.full_context.message", ",").alias("context_messages"))


def incident_part(part):
    def run(spark, sf):
        rows = ev(spark, sf)
        found = I.materialize(I.incidents(rows, HOUR, CONFIG))
        return part(found, rows)
    return run


def incidents(spark, sf):
    return I.incidents(ev(spark, sf), HOUR, CONFIG).drop("idx")


def alert_rows(spark, sf):
    return A.alerts(ev(spark, sf), "2 hours", "1 hour", HOUR, "topic", CONFIG)


def _segments(spark, sf, newest_first=False) -> str:
    """Log files of three sources, two segments each, one source wholly before the other; with
    ``newest_first`` the later segment of each source comes first.

    Every first segment ends with a line without a time.
    """
    files = work_path(spark, "segments")
    rows = tables.raw_lines(spark, sf).persist()
    middle = rows.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0]
    for number in range(3):
        for late in ((True, False) if newest_first else (False, True)):
            own = rows.filter((F.col("source") == f"svc-{number}") & ((F.col("seq") > middle) == late))
            text = own.select(F.col("line").alias("value"))
            if not late:
                text = text.union(spark.range(1).select(F.lit("a line without a time").alias("value")))
            text.coalesce(1).write.text(f"{files}/source=svc-{number}/part={int(late)}")
    rows.unpersist()
    return files


def _all_files(spark, sf) -> str:
    files = work_path(spark, "days")
    lines = tables.raw_lines(spark, sf)
    (lines.select("source", F.substring("line", 7, 10).alias("day"), F.col("line").alias("value"))
          .write.partitionBy("source", "day").text(files))
    return files


def _streamed(spark, sf, start, one_by_one=False, newest_first=False):
    """Run a stream over written log files to its end and return where it wrote."""
    files = _segments(spark, sf, newest_first) if one_by_one else _all_files(spark, sf)
    events = S.stream_events(
        spark, files, "text", source=lambda c: F.regexp_extract(c, "source=([^/]*)/", 1),
        max_files_per_trigger=1 if one_by_one else None)
    out = work_path(spark, "stream")
    start(events, out, f"{out}-checkpoint").awaitTermination()
    return out


def stream_totals(spark, sf):
    return state.state_level_counts(state.load_state(spark, _streamed(spark, sf, S.start_counts)))


def stream_patterns(spark, sf):
    return state.state_patterns(state.load_state(spark, _streamed(spark, sf, S.start_counts)))


def stream_ticks(spark, sf, one_by_one=False):
    out = _streamed(spark, sf, lambda e, o, c: S.start_ticks(e, o, c, HOUR), one_by_one)
    return S.read_ticks(spark, out, HOUR)


def stream_ticks_segments(spark, sf):
    return stream_ticks(spark, sf, True)


def stream_heartbeat(spark, sf, one_by_one=False):
    out = _streamed(spark, sf, lambda e, o, c: S.start_heartbeat(e, o, c, "1 day"), one_by_one)
    return S.read_heartbeat(spark, out, "1 day").drop("report")


def stream_heartbeat_segments(spark, sf):
    return stream_heartbeat(spark, sf, True)


def stream_recent_summary(spark, sf):
    out = _streamed(spark, sf, lambda e, o, c: S.start_recent_summary(e, o, c, "1 day"))
    return S.read_recent_summary(spark, out, "1 day")


def stream_incidents(spark, sf, one_by_one=False, newest_first=False):
    out = _streamed(spark, sf, lambda e, o, c: S.start_incidents(e, o, c, HOUR, CONFIG), one_by_one, newest_first)
    S.finish_incidents(spark, out, HOUR, CONFIG)
    return S.read_incidents(spark, out).drop("epoch", "idx", "trigger_seq")


def stream_incidents_segments(spark, sf):
    return stream_incidents(spark, sf, True)


def stream_incidents_late(spark, sf):
    return stream_incidents(spark, sf, True, True)


def stream_alerts(spark, sf, one_by_one=False):
    out = _streamed(spark, sf, lambda e, o, c: S.start_alerts(
        e, o, c, "2 hours", "1 hour", HOUR, "topic", CONFIG), one_by_one)
    return spark.read.parquet(f"{out}/alerts").drop("epoch", "seq")


def stream_alerts_segments(spark, sf):
    return stream_alerts(spark, sf, True)


# Lines that test the parsers, made from every event: the same key twice, several wrappers around
# a line, and lines without a time between timed ones.
def parse_json_duplicates(spark, sf):
    rows = tables.load_events(spark, sf)
    line = F.format_string(
        '{"level":"trace","%s":"first","msg":"x","level":"%s","msg":"%s","%s":"%s"}',
        "key", F.lower("level"), "head", "key", "value")
    return R.parse_logs(rows.select("source", "seq", line.alias("line")), "json").select(
        "source", "seq", "level", "message")


def parse_docker_deep(spark, sf):
    rows = tables.raw_lines(spark, sf, "logfmt")
    line = F.col("line")
    for depth in range(5):
        line = F.when(depth < 3 + F.col("seq") % 3, F.to_json(F.struct(
            F.concat(line, F.lit("\n")).alias("log"), F.lit("stdout").alias("stream")))).otherwise(line)
    return R.parse_logs(rows.withColumn("line", line), "json").select(
        "source", "seq", "ts", "level", "message")


def parse_untimed(spark, sf):
    rows = tables.raw_lines(spark, sf, "logfmt")
    line = F.when(F.col("seq") % 3 == 1, F.col("line")).otherwise(
        F.regexp_replace("line", '^time="[^"]*" ', ""))
    events = R.parse_logs(rows.withColumn("line", line), "text")
    return R.times_from_neighbours(events).select("source", "seq", "ts", "level", "message", "timed")


def inspect_map(spark, sf):
    rows = C.inspect_map(ev(spark, sf).withColumn("level", F.lit("ERROR")), "Shelf opened | shopper=*")
    return rows.select("source", "total", "n_variants", F.explode("variants").alias("message", "v")) \
        .select("source", "total", "n_variants", "message", F.col("v.count").alias("count"))


def event_store(spark, sf):
    """Events written twice (a retry), then one source, some days and one pattern read back."""
    path = work_path(spark, "events")
    rows = parsed(spark, sf)
    for _ in range(2):
        store.write_events(rows, path)
    found = store.read_events(spark, path, ["svc-0", "svc-2"], since="1000-01-01")
    return found.filter(F.col("pattern") == IP_PATTERN).select("source", "seq", "ts", "level", "message", "pattern")


def detect_sources(spark, sf):
    files = written_lines(spark, sf)
    return logs.detect_sources(spark, f"{files}/*", logs.source_folder)


def incident_signals_all(spark, sf):
    return incident_part(lambda f, e: I.incident_signals(f, e, None))(spark, sf)


def heartbeat_lines(spark, sf):
    return G.heartbeat_lines(ev(spark, sf), "1 day")


def alert_log(spark, sf):
    """Alert lines written to the log and read again."""
    path = work_path(spark, "alert-log")
    reports.write_alerts(A.format_alert(alert_rows(spark, sf)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def own_parser(spark, sf):
    """Lines in a format of their own: level|message|seconds."""
    rows = tables.events(spark, sf)
    line = F.concat_ws("|", "level", F.replace("message", F.lit("|"), F.lit("/")),
                       F.unix_seconds("ts").cast("string"))

    def bars(c):
        parts = F.split(c, "[|]")
        return F.struct(F.timestamp_seconds(parts[2].cast("bigint")).alias("event_ts"),
                        parts[0].alias("level"), parts[1].alias("message"))

    return R.parse_logs(rows.select("source", "seq", line.alias("line")), "bars", {"bars": bars}).select(
        "source", "seq", "ts", "level", "message")


def queries() -> dict:
    q = {
        "scan_lines": scan_lines,
        "multi_source": multi_source,
        "detect_format": lambda s, d: R.detect_format(tables.raw_lines(s, d, "mixed")),
        "clean_line": clean_line,
        "parse_logfmt": parser_query("logfmt", P.parse_logfmt),
        "parse_bracket": parser_query("bracket", P.parse_bracket),
        "parse_simple": parser_query("simple", P.parse_simple),
        "parse_json": parser_query("json", P.parse_json),
        "parse_docker": parse_docker,
        "parse_json_extras": parse_json_extras,
        "parse_ts": parse_ts,
        "parse_all": parse_all,
        "signals": lambda s, d: L.signals(ev(s, d)),
        "min_level": lambda s, d: L.min_level(ev(s, d), "info"),
        "search_logs": lambda s, d: L.search(ev(s, d), "CODE rejected | DOOR", "warn", 500),
        "filter_logs": lambda s, d: L.filter_logs(ev(s, d), "Error"),
        "by_source": lambda s, d: L.for_source(ev(s, d), "svc-1", ["svc-0", "svc-1", "svc-2"])
            .select(X.source_name(F.concat(F.lit("C:\\logs/"), "source")).alias("name"),
                    "source", "seq", "message"),
        "format_events": lambda s, d: L.format_events(ev(s, d)),
        "truncate": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(
            "doc_id", X.truncate("text", 90).alias("short")),
        "age_label": age_label,
        "fingerprint": lambda s, d: ev(s, d).select(
            "seq", X.fingerprint("message").alias("pattern")),
        "fingerprint_docs": fingerprint_docs,
        "patterns": lambda s, d: C.patterns(parsed(s, d)),
        "variants": lambda s, d: C.variants(ev(s, d)),
        "top_patterns": lambda s, d: C.top_patterns(parsed(s, d, "mixed"))
            .select("source", "pattern", "level", "count"),
        "representative": lambda s, d: C.representative(ev(s, d)),
        "pattern_cap": lambda s, d: C.patterns(ev(s, d), max_patterns=2),
        "variant_times": lambda s, d: C.variant_times(ev(s, d)),
        "pattern_times": lambda s, d: C.pattern_times(ev(s, d))
            .withColumn("times", stamps("times")),
        "inspect": inspect,
        "variant_list": lambda s, d: C.variant_list(ev(s, d), IP_PATTERN),
        "recent_summary": lambda s, d: C.recent_summary(ev(s, d), "1 day"),
        "totals": lambda s, d: G.totals(ev(s, d)),
        "level_counts": lambda s, d: G.level_counts(ev(s, d)),
        "level_pivot": lambda s, d: G.level_pivot(ev(s, d)),
        "last_seen": lambda s, d: G.last_seen(ev(s, d)),
        "top_issue": lambda s, d: G.top_issue(ev(s, d), HOUR),
        "heartbeat": lambda s, d: G.heartbeat(ev(s, d), "1 day"),
        "snapshot": snapshot,
        "situation_report": lambda s, d: G.situation_report(ev(s, d), "1 day", HOUR),
        "ticks": lambda s, d: V.ticks(ev(s, d), HOUR),
        "trend": lambda s, d: V.trend(ev(s, d), 60, HOUR),
        "rolling_rate": lambda s, d: V.rolling_rate(ev(s, d), 60, HOUR),
        "running_peak": lambda s, d: V.running_peak(ev(s, d), HOUR),
        "peak_rate": lambda s, d: V.peak_rate(ev(s, d), HOUR),
        "status": lambda s, d: V.status(V.rolling_rate(ev(s, d), 60, HOUR)),
        "normalize_trend": lambda s, d: V.normalize_trend(V.trend(ev(s, d), 60, HOUR)),
        "spike_candidates": lambda s, d: I.spike_candidates(ev(s, d), HOUR, CONFIG),
        "incidents": incidents,
        "incident_signals": incident_part(
            lambda f, e: I.incident_signals(f, e, CONFIG.signal_rows)),
        "incident_context": incident_part(
            lambda f, e: I.incident_context(f, e, CONFIG.context_rows)),
        "incident_reports": incident_reports,
        "incident_list": incident_list,
        "throttle": lambda s, d: A.throttle(ev(s, d), HOUR),
        "alerts": alert_rows,
        "alert_lines": lambda s, d: A.format_alert(alert_rows(s, d)),
        "history": lambda s, d: L.history(ev(s, d), 500, "WARN"),
        "tail": lambda s, d: L.tail(ev(s, d)),
        "signal_history": lambda s, d: L.signal_history(ev(s, d), 1000),
        "state_merge": state_merge,
    }
    q.update({f.__name__: f for f in (
        stream_totals, stream_patterns, stream_ticks, stream_heartbeat, stream_recent_summary,
        stream_incidents, stream_alerts, stream_ticks_segments, stream_heartbeat_segments,
        stream_incidents_segments, stream_incidents_late, stream_alerts_segments, parse_json_duplicates, parse_docker_deep, parse_untimed, inspect_map,
        heartbeat_lines, alert_log, own_parser, event_store, detect_sources, incident_signals_all,
        incident_fetch)})

    def run(query):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(query(spark, sf_dir))
        return call

    return {name: run(query) for name, query in q.items()}
