"""Clustering of signal messages by fingerprint, with drill-down.

Counting happens per (source, message) first. Every aggregate there has a
fixed-width buffer, so Spark hashes and combines on the map side; the fingerprint
then runs once per distinct message and patterns are a roll-up of variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SIGNAL_LEVELS
from ..functions.text import fingerprint, is_signal
from ..plans.position import edge_rows, top_per_key
from ..plans.scale import join_small
from .filters import signals

VARIANT_TIMES = 20
VARIANTS_WITH_TIMES = 50
PATTERN_TIMES = 100


def _level_code(levels):
    """Levels as positions in the list: fixed-width, so aggregates on them stay hash-based."""
    return F.array_position(F.array(*[F.lit(level) for level in levels]), F.col("level"))


def _level_name(code, levels):
    return F.element_at(F.array(*[F.lit(level) for level in levels]), code.cast("int"))


def message_counts(events: DataFrame, *extra: str, levels=SIGNAL_LEVELS) -> DataFrame:
    """Signals counted per source and message (and any extra key columns), with their pattern.

    The level is that of the first occurrence, `last_ts` the time of the last arrival.
    """
    return _count_messages(signals(events, levels), *extra, levels=levels)


def _count_messages(events: DataFrame, *extra: str, levels=SIGNAL_LEVELS) -> DataFrame:
    return (events.groupBy("source", *extra, "message")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.min_by(_level_code(levels), "seq").alias("_code"),
                 F.min("seq").alias("first_seq"),
                 F.max("seq").alias("last_seq"),
                 F.max_by("ts", "seq").alias("last_ts"))
            .withColumn("pattern", fingerprint("message")))


def variants(events: DataFrame, max_patterns: int | None = None,
             levels=SIGNAL_LEVELS) -> DataFrame:
    """(source, pattern, message, count, first_seq, last_ts): occurrences of each raw message."""
    found = message_counts(events, levels=levels)
    if max_patterns is not None:
        kept = _first_patterns(_patterns(found, levels=levels), max_patterns).select("source", "pattern")
        found = join_small(found, kept, ["source", "pattern"], "left_semi")
    return found.select("source", "pattern", "message", "count", "first_seq", "last_ts")


def _patterns(found: DataFrame, *extra: str, levels=SIGNAL_LEVELS, more=()) -> DataFrame:
    return (found.groupBy("source", *extra, "pattern")
                 .agg(F.min_by("_code", "first_seq").alias("_code"),
                      F.sum("count").alias("count"),
                      F.min("first_seq").alias("first_seq"),
                      F.max_by("last_ts", "last_seq").alias("last_ts"), *more)
                 .withColumn("level", _level_name(F.col("_code"), levels))
                 .drop("_code"))


def _first_patterns(found: DataFrame, max_patterns: int) -> DataFrame:
    return edge_rows(found, max_patterns, newest=False, position="first_seq")


def patterns(events: DataFrame, max_patterns: int | None = None,
             levels=SIGNAL_LEVELS) -> DataFrame:
    """(source, pattern, level, count, first_seq, last_ts); the level is that of the first event.

    `max_patterns` keeps only the patterns of a source that appeared first.
    """
    found = _patterns(message_counts(events, levels=levels), levels=levels)
    return found if max_patterns is None else _first_patterns(found, max_patterns)


def top_patterns(events: DataFrame, n: int | None = None) -> DataFrame:
    """Patterns, errors before everything else, then most frequent first."""
    found = patterns(events).orderBy((F.col("level") == "ERROR").desc(), F.col("count").desc(),
                                     F.col("pattern"), F.col("source"))
    return found if n is None else found.limit(n)


def _best(name: str = "message"):
    """The most frequent message; the smallest one of equals."""
    return F.min_by("message", F.struct(-F.col("count"), F.col("message"))).alias(name)


def representative(events: DataFrame) -> DataFrame:
    """(source, pattern, message, count): the most frequent variant of each pattern."""
    return (message_counts(events).groupBy("source", "pattern")
            .agg(_best(), F.max("count").alias("count")))


def _of_pattern(events: DataFrame, pattern: str) -> DataFrame:
    """Events of a pattern as far as the rows know theirs (stored events do): a pushed-down filter."""
    return events.filter(F.col("pattern") == pattern) if "pattern" in events.columns else events


def _hits(events: DataFrame) -> DataFrame:
    return signals(events).select("source", fingerprint("message").alias("pattern"),
                                  "message", "seq", "ts")


def variant_times(events: DataFrame, k: int = VARIANT_TIMES,
                  max_variants: int | None = VARIANTS_WITH_TIMES,
                  pattern: str | None = None) -> DataFrame:
    """(source, pattern, message, rank, ts): the last k hits of a variant, newest first.

    Only the `max_variants` variants of a pattern that appeared first are tracked.
    """
    if pattern is not None:
        events = _of_pattern(events, pattern)
    hits = _hits(events)
    found = message_counts(events)
    if pattern is not None:
        hits = hits.filter(F.col("pattern") == pattern)
        found = found.filter(F.col("pattern") == pattern)
    if max_variants is not None:
        tracked = top_per_key(found.select("source", "pattern", "message", "first_seq"),
                              ["source", "pattern"], [F.col("first_seq")], max_variants)
        hits = join_small(hits, tracked.select("source", "message"), ["source", "message"],
                          "left_semi")
    return (top_per_key(hits, ["source", "pattern", "message"], [F.col("seq").desc()], k)
            .select("source", "pattern", "message", "rank", "ts"))


def pattern_times(events: DataFrame, k: int = PATTERN_TIMES) -> DataFrame:
    """(source, pattern, times): the last k hits of a pattern, oldest first."""
    last = top_per_key(_hits(events).drop("message"), ["source", "pattern"],
                       [F.col("seq").desc()], k)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "ts")))
    return (last.groupBy("source", "pattern").agg(ordered.alias("hits"))
                .select("source", "pattern", F.col("hits.ts").alias("times")))


def inspect(events: DataFrame, pattern: str) -> DataFrame:
    """One row per variant of a pattern: its counts and last hit times, newest first.

    A pattern nobody has seen gives no rows.
    """
    events = _of_pattern(events, pattern)
    found = message_counts(events).filter(F.col("pattern") == pattern)
    head = _patterns(found).select("source", "pattern", "level", F.col("count").alias("total"))
    times = (variant_times(events, pattern=pattern).groupBy("source", "message")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "ts"))).alias("hits"))
             .select("source", "message", F.col("hits.ts").alias("times")))
    return (join_small(found.select("source", "pattern", "message", "count"), head,
                       ["source", "pattern"])
                 .join(times, ["source", "message"], "left")
                 .select("source", "pattern", "level", "total", "message", "count", "times"))


def inspect_map(events: DataFrame, pattern: str, max_variants: int | None = None) -> DataFrame:
    """Drill-down as one row per source with a map from variant to its counts and times.

    A map is a single value; `inspect` has the same as rows. On request it lists only the first
    `max_variants` variants by count; `n_variants` tells how many there are.
    """
    rows = inspect(events, pattern)
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_variants"))
    listed = rows if max_variants is None else top_per_key(
        rows, ["source"], [F.col("count").desc(), F.col("message")], max_variants)
    entry = F.struct(F.col("message"), F.struct("count", F.col("times").alias("timestamps")))
    return (listed.groupBy("source", "pattern", "level", "total")
                  .agg(F.map_from_entries(F.collect_list(entry)).alias("variants"))
                  .join(sizes, "source"))


def variant_list(events: DataFrame, pattern: str) -> DataFrame:
    """Variants of a pattern, most frequent first, then most recently hit."""
    return (variants(_of_pattern(events, pattern)).filter(F.col("pattern") == pattern)
            .select("source", "message", "count", "last_ts")
            .orderBy(F.col("count").desc(), F.col("last_ts").desc(), F.col("message"),
                     F.col("source")))


def window_message_counts(events: DataFrame, every: str) -> DataFrame:
    """Message counts per source and tumbling window."""
    return _framed_counts(signals(events), every)


def all_window_message_counts(events: DataFrame, every: str) -> DataFrame:
    """Like `window_message_counts`, with all other rows counted under a null message.

    In a stream every row has to reach the aggregate, or quiet stretches would not
    move the watermark on.
    """
    return _framed_counts(events.withColumn(
        "message", F.when(is_signal("level"), F.col("message"))), every)


def _framed_counts(events: DataFrame, every: str) -> DataFrame:
    framed = events.withColumn("window", F.window("ts", every))
    return (_count_messages(framed, "window")
            .withColumn("window_start", F.col("window.start")).drop("window"))


def merged_window_counts(parts: DataFrame) -> DataFrame:
    """Sum of several parts of `all_window_message_counts`."""
    return (parts.groupBy("source", "window_start", "message", "pattern")
            .agg(F.sum("count").alias("count"), F.min_by("_code", "first_seq").alias("_code"),
                 F.max_by("last_ts", "last_seq").alias("last_ts"),
                 F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")))


def recent_patterns(events: DataFrame, every: str = "60 seconds", k: int = 3) -> DataFrame:
    """The k most frequent patterns per source, window and level, with their best message."""
    return _recent_patterns(window_message_counts(events, every), k)


def _recent_patterns(counts: DataFrame, k: int) -> DataFrame:
    per_pattern = _patterns(counts, "window_start", more=[_best()])
    return top_per_key(per_pattern, ["source", "window_start", "level"],
                       [F.col("count").desc(), F.col("pattern")], k)


def recent_summary(events: DataFrame, every: str = "60 seconds", k: int = 3) -> DataFrame:
    """(source, window_start, errors, warns): the top patterns of each window as text lines."""
    return recent_summary_of(window_message_counts(events, every), k)


def recent_summary_of(counts: DataFrame, k: int = 3) -> DataFrame:
    """Summary of message counts per window."""
    line = F.format_string("- %s (%d hits)\n", "message", "count")

    def listing(level: str, empty: str):
        mine = F.when(F.col("level") == level, F.struct("rank", line.alias("line")))
        text = F.array_join(F.array_sort(F.collect_list(mine))["line"], "")
        return F.when(text == "", empty).otherwise(text)

    return _recent_patterns(counts, k).groupBy("source", "window_start").agg(
        listing("ERROR", "No new errors.").alias("errors"),
        listing("WARN", "No new warnings.").alias("warns"))
