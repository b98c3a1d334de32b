"""Filters, search, source selection and last-N views over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LEVEL_WEIGHTS, SIGNAL_LEVELS
from ..functions.text import display_line, is_signal, level_weight
from ..plans.position import edge_rows

DEFAULT_LIMIT = 500


def signals(events: DataFrame, levels=SIGNAL_LEVELS) -> DataFrame:
    """Events whose level is exactly one of the signal levels."""
    return events.filter(is_signal("level", levels))


def min_level(events: DataFrame, level: str | None) -> DataFrame:
    """Events at least as severe as a level; an unknown or empty level keeps everything."""
    weight = LEVEL_WEIGHTS.get((level or "").upper(), 0)
    return events.filter(level_weight("level") >= weight)


def search(events: DataFrame, q: str = "", level: str = "", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest events whose message contains `q` and whose level equals `level`, ignoring case.

    Newest is by time; positions are those of one file and only order rows of the same time.
    A limit of 0 returns everything; the query text is matched literally.
    """
    found = events
    if level:
        found = found.filter(F.upper("level") == level.upper())
    if q:
        found = found.filter(F.contains(F.lower("message"), F.lit(q.lower())))
    found = found.orderBy(F.col("ts").desc_nulls_last(), F.col("source"), F.col("seq").desc())
    return found.limit(limit) if limit > 0 else found


def api_limit(text: str | None) -> int:
    """Row limit of a request parameter: the default unless it is a positive number."""
    try:
        value = int(text)
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    return value if value > 0 else DEFAULT_LIMIT


def filter_logs(events: DataFrame, text: str = "") -> DataFrame:
    """Events whose message or level contains a text, ignoring case."""
    if not text:
        return events
    needle = F.lit(text.lower())
    return events.filter(F.contains(F.lower("message"), needle)
                         | F.contains(F.lower("level"), needle))


def for_source(df: DataFrame, source: str | None, sources: list[str]) -> DataFrame:
    """Rows of one source; an empty, ``all`` or unknown name means the first source."""
    chosen = source if source in sources else sources[0]
    return df.filter(F.col("source") == chosen)


def format_events(events: DataFrame) -> DataFrame:
    """(source, seq, text) with one display line per event."""
    return events.select("source", "seq", display_line().alias("text"))


def history(events: DataFrame, n: int = 50_000, level: str | None = None) -> DataFrame:
    """The last n events of every source at or above a level."""
    return edge_rows(min_level(events, level), n)


def signal_history(events: DataFrame, n: int = 10_000) -> DataFrame:
    """The last n signals of every source."""
    return edge_rows(signals(events), n)


def tail(events: DataFrame, n: int = 1_500, slack: int = 500) -> DataFrame:
    """Viewport rows: sources with more than n + slack rows are cut to the last n."""
    return edge_rows(events, n, slack=slack)
