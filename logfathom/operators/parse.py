"""Raw lines to events: format detection and parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.text import clean_line, strip
from ..plans.position import TURNS, carried_values, stretch, top_per_key, turns
from ..plans.scale import compute_once, join_small
from ..sources.logs import SAMPLE_LINES

# Stands for formats that the rows have themselves, in a column `format`.
IN_ROWS = "format column"


def detect_format(raw: DataFrame) -> DataFrame:
    """(source, format): json when most of the first ten lines of a source start with ``{``.

    This reads all rows; `sources.logs.detect_sources` reads only the heads of files.
    """
    start = strip("line")
    lines = (raw.select("source", "seq", F.substring(start, 1, 1).alias("mark"))
                .filter(F.col("mark") != ""))
    sample = top_per_key(lines, ["source"], [F.col("seq")], SAMPLE_LINES)
    votes = F.count_if(F.col("mark") == "{")
    return sample.groupBy("source").agg(
        F.when(votes > F.floor(F.count(F.lit(1)) / 2), "json").otherwise("text").alias("format"))


def parse_logs(raw: DataFrame, formats: DataFrame | str | None = None,
               parsers: dict[str, Callable[[Column], Column]] | None = None,
               unwrap_depth: int | None = None) -> DataFrame:
    """Events of raw lines, one row per non-blank line.

    formats  a (source, format) table, one format name for all sources, or None to detect.
    parsers  extra formats by name: a function from the line column to
             ``struct<event_ts, level, message>``; may be a pandas UDF.
    unwrap_depth  most container wrappers to take off a line; all of them by default.
    `ts` is the time in the line, or `ingest_ts` where the line has none.
    """
    parsers = parsers or {}
    if isinstance(formats, str) and formats == IN_ROWS:
        lines = raw
    elif isinstance(formats, str):
        lines = raw.withColumn("format", F.lit(formats))
    else:
        table = detect_format(raw) if formats is None else formats.select("source", "format")
        lines = join_small(raw, table, ["source"], "left")
    if "ingest_ts" not in raw.columns:
        lines = lines.withColumn("ingest_ts", F.lit(None).cast("timestamp"))

    # Every stage below adds columns the next one uses several times.
    as_json = F.coalesce(F.col("format") == "json", F.lit(False))
    staged = compute_once(lines, _json=as_json,
                          _text=F.when(as_json, strip("line")).otherwise(clean_line("line")))
    staged = staged.filter(F.col("_text") != "")
    text_only = isinstance(formats, str) and formats == "text"
    if not text_only:
        staged = compute_once(staged, _inner=F.when(F.col("_json"), P.unwrapped("_text", unwrap_depth)))
        staged = compute_once(staged, _text=F.coalesce("_inner.text", "_text"),
                              _json=F.coalesce("_inner.json", F.lit(False))).drop("_inner")
        staged = staged.filter(F.col("_text") != "")
        staged = compute_once(staged, _docs=F.when(F.col("_json"), P.json_documents("_text")))
        staged = compute_once(staged, _fields=P.single_document("_docs")).drop("_docs")
    kind = P.text_kind("_text")
    staged = compute_once(staged, _kind=kind if text_only else
                          F.when(F.col("_json"), "unknown").otherwise(kind))

    def either(from_fields, from_text):
        """Value of a line: from its JSON fields where it has some, else from its text."""
        text = from_text("_text", "_kind")
        return text if text_only else F.when(F.col("_fields").isNotNull(),
                                             from_fields("_fields")).otherwise(text)

    staged = compute_once(staged, _time=either(lambda f: P.first_field(f, P.TIME_KEYS), P.text_time))
    staged = staged.select(
        *lines.columns, P.parse_ts("_time").alias("event_ts"),
        either(P.json_level, P.text_level).alias("level"),
        either(P.json_message, P.text_message).alias("message"))
    for name, parser in parsers.items():
        mine = F.col("format") == name
        staged = (staged.withColumn("_own", F.when(mine, parser(F.col("line"))))
                        .withColumn("event_ts", F.when(mine, F.col("_own.event_ts"))
                                                 .otherwise(F.col("event_ts")))
                        .withColumn("level", F.when(mine, F.col("_own.level"))
                                              .otherwise(F.col("level")))
                        .withColumn("message", F.when(mine, F.col("_own.message"))
                                                .otherwise(F.col("message"))))
    return staged.select("source", "seq", "event_ts", "ingest_ts",
                         F.coalesce("event_ts", "ingest_ts").alias("ts"), "level", "message")


def order_by_time(events: DataFrame) -> DataFrame:
    """Take the arrival position from the event time, for streams and rotated segments.

    In batch positions are total up to 1,024 rows a microsecond: rows of the same time follow each other
    by their position in the file. A stream has no such positions; there the hash of the message decides,
    so that the order does at least not depend on how rows are dealt to tasks, and rows may tie.
    """
    if events.isStreaming:
        placed = events.withColumn("turn", F.pmod(F.xxhash64("message"), F.lit(TURNS)))
    else:
        placed = turns(events)
    return placed.withColumn("seq", F.unix_micros("ts") * F.lit(TURNS) + F.col("turn")).drop("turn")


def times_from_neighbours(events: DataFrame) -> DataFrame:
    """Give lines without a time of their own that of the last timed line before them.

    Lines before the first timed line of a source get the time of that one; a source without any
    keeps the time of its file. `timed` tells which lines had a time. Stretches of arrival
    positions are filled each by itself, and what a stretch begins with comes from a table with
    one row per stretch.
    """
    rows = events.withColumn("stretch", stretch())
    ends = rows.groupBy("source", "stretch").agg(
        F.max_by("event_ts", F.when(F.col("event_ts").isNotNull(), F.col("seq"))).alias("last"),
        F.min_by("event_ts", F.when(F.col("event_ts").isNotNull(), F.col("seq"))).alias("first"))
    upto = Window.partitionBy("source", "stretch").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, 0)
    return (rows.join(carried_values(ends), ["source", "stretch"])
            .withColumn("near", F.last("event_ts", ignorenulls=True).over(upto))
            .select(*[c for c in events.columns if c not in ("ts", "timed")],
                    F.coalesce("near", "before", "after", "ingest_ts").alias("ts"),
                    F.col("event_ts").isNotNull().alias("timed")))
