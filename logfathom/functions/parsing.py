"""Column functions that take one log line apart.

Each parser returns ``struct<event_ts, level, message>``. All of them are built-in
expressions, so a parse job is a narrow map stage without Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_line, col, strip

# Accepted time formats (RFC 3339, or date and time with a space, UTC).
TIME_FORMAT = (r"^\d{4}-\d{2}-\d{2}(T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})"
               r"| \d{1,2}:\d{2}:\d{2}([.,]\d+)?)$")

# Line layouts tried after the structured ones. (?d) keeps \n the only
# character that "." stops at.
BRACKET_FORMAT = (r"(?d)(\d{4}-\d{2}-\d{2}[\t\n\f\r T]\d{2}:\d{2}:\d{2}).*?"
                  r"\[([a-zA-Z]+)\][\t\n\f\r ]+(.*)")
SIMPLE_FORMAT = r"(?d)(\d{4}-\d{2}-\d{2}.*?)[\t\n\f\r ]+([a-zA-Z]+)[\t\n\f\r ]+(.*)"

# Logfmt values. The last alternative always matches, which pins the first marker.
LOGFMT_TIME = r'(?s)^.*?time=(?:"([^"]*)"|([^" ][^ ]*)|).*'
LOGFMT_MESSAGE = (r'(?s)^.*?msg=(?:"([^"]*)"[\s\p{Z}\x85]*(.*)|("[^"]*)'
                  r'|((?!")[^ ]*)[\s\p{Z}\x85]*(.*))\z')

# Levels accepted between brackets without a date in front.
BRACKET_LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")

# JSON keys by role, in order of preference.
LEVEL_KEYS = ("level", "severity", "lvl")
MESSAGE_KEYS = ("msg", "message", "error", "err")
TIME_KEYS = ("time", "timestamp", "ts", "@timestamp")

# Keys that are not repeated as extra context.
CONSUMED_KEYS = ("level", "severity", "lvl", "msg", "message",
                 "time", "timestamp", "ts", "@timestamp")

STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def bind(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_ts(c) -> Column:
    """Timestamp of an accepted text form, else null. Zone-less forms follow the session zone (UTC)."""
    text = col(c)
    return F.when(text.rlike(TIME_FORMAT),
                  F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def event(time_text: Column, level: Column, message: Column) -> Column:
    return F.struct(parse_ts(time_text).alias("event_ts"), level.alias("level"),
                    message.alias("message"))


def _after(line: Column, marker: str) -> Column:
    """Text behind the first occurrence of a marker (only meaningful where it occurs)."""
    return F.substring(line, F.instr(line, marker) + F.lit(len(marker)), F.length(line))


def is_logfmt(line) -> Column:
    return F.contains(col(line), F.lit("level=")) & F.contains(col(line), F.lit("msg="))


def logfmt_time(line) -> Column:
    """Raw time value of a logfmt line; empty when its quote is never closed, null when absent."""
    value = F.regexp_replace(col(line), LOGFMT_TIME, "$1$2")
    return F.when(F.contains(col(line), F.lit("time=")), value)


def logfmt_level(line) -> Column:
    return F.upper(F.regexp_extract(col(line), "level=([^ \t,]*)", 1))


def logfmt_message(line) -> Column:
    """Message of a cleaned logfmt line, fields behind it appended after a bar."""
    return F.regexp_replace(F.regexp_replace(col(line), LOGFMT_MESSAGE, "$1$3$4 | $2$5"),
                            r" \| \z", "")


def bracket_level(line) -> Column:
    """Upper-cased text between the first brackets when it is a known level, else null."""
    line = col(line)
    inside = F.upper(F.regexp_extract(line, r"^[^\[\]]*\[([^\]]*)\]", 1))
    return F.when(inside.isin(*BRACKET_LEVELS), inside)


def text_kind(line) -> Column:
    """Which layout a cleaned text line has."""
    return (F.when(is_logfmt(line), "logfmt")
             .when(bracket_level(line).isNotNull(), "bracket")
             .when(col(line).rlike(BRACKET_FORMAT), "dated_bracket")
             .when(col(line).rlike(SIMPLE_FORMAT), "simple")
             .otherwise("unknown"))


def text_time(line, kind) -> Column:
    line, kind = col(line), col(kind)
    return (F.when(kind == "logfmt", logfmt_time(line))
             .when(kind == "bracket", strip(F.substring_index(line, "[", 1)))
             .when(kind == "dated_bracket", F.regexp_extract(line, BRACKET_FORMAT, 1))
             .when(kind == "simple", F.regexp_extract(line, SIMPLE_FORMAT, 1)))


def text_level(line, kind) -> Column:
    line, kind = col(line), col(kind)
    return (F.when(kind == "logfmt", logfmt_level(line))
             .when(kind == "bracket", bracket_level(line))
             .when(kind == "dated_bracket", F.upper(F.regexp_extract(line, BRACKET_FORMAT, 2)))
             .when(kind == "simple", F.upper(F.regexp_extract(line, SIMPLE_FORMAT, 2)))
             .otherwise("UNKNOWN"))


def text_message(line, kind) -> Column:
    line, kind = col(line), col(kind)
    return (F.when(kind == "logfmt", logfmt_message(line))
             .when(kind == "bracket", strip(_after(line, "]")))
             .when(kind == "dated_bracket", strip(F.regexp_extract(line, BRACKET_FORMAT, 3)))
             .when(kind == "simple", strip(F.regexp_extract(line, SIMPLE_FORMAT, 3)))
             .otherwise(line))


def parse_logfmt(c) -> Column:
    """Event of a logfmt line; null when the line is not logfmt."""
    return bind(clean_line(c), lambda line: F.when(
        is_logfmt(line), event(logfmt_time(line), logfmt_level(line), logfmt_message(line))))


def _parse_kind(c, wanted) -> Column:
    return bind(clean_line(c), lambda line: bind(text_kind(line), lambda kind: F.when(
        wanted(kind),
        event(text_time(line, kind), text_level(line, kind), text_message(line, kind)))))


def parse_bracket(c) -> Column:
    """Event of a ``... [LEVEL] message`` line; null for other lines."""
    return _parse_kind(c, lambda kind: kind.isin("bracket", "dated_bracket"))


def parse_simple(c) -> Column:
    """Event of a ``date LEVEL message`` line; null for other lines."""
    return _parse_kind(c, lambda kind: kind == "simple")


def parse_text(c) -> Column:
    """Event of any text line; lines of no known layout become UNKNOWN."""
    return _parse_kind(c, lambda kind: F.lit(True))


def json_documents(line) -> Column:
    """What a line holds between braces: null when it is no JSON, one map when it is one object.

    Text behind the object shows as a second element.
    """
    line = col(line)
    whole = line.startswith("{") & F.rtrim(line).endswith("}")
    return F.when(whole, F.from_json(F.concat(F.lit("["), line, F.lit("]")),
                                     "array<map<string,string>>", STRICT_JSON))


def single_document(documents) -> Column:
    return F.when(F.size(col(documents)) == 1, last_wins(F.get(col(documents), F.lit(0))))


def last_wins(fields) -> Column:
    """Fields with the last value of every key, as far as keys are repeated."""
    def once(found):
        keys = F.map_keys(found)
        later = F.filter(F.map_entries(found), lambda entry, i: ~F.array_contains(
            F.slice(keys, i + 2, F.size(keys)), entry["key"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), found).otherwise(
            F.map_from_entries(later))
    return bind(fields, once)


def json_fields(line) -> Column:
    """Top-level fields of a line that is exactly one JSON object, else null."""
    return bind(json_documents(line), single_document)


def first_field(fields, keys) -> Column:
    """Value of the first key that is present, even if it is null or empty."""
    fields, value = col(fields), F.lit("")
    for key in reversed(keys):
        value = (F.when(F.map_contains_key(fields, key), F.coalesce(fields[key], F.lit("")))
                  .otherwise(value))
    return value


def extra_fields(fields) -> Column:
    """All fields without a role of their own as ``k=v | k=v``, ordered by key."""
    kept = F.map_filter(col(fields), lambda k, v: ~k.isin(*CONSUMED_KEYS))
    pairs = F.transform(F.sort_array(F.map_entries(kept)), lambda e: F.concat(
        e["key"], F.lit("="), F.btrim(F.coalesce(e["value"], F.lit("null")), F.lit('"'))))
    return F.array_join(pairs, " | ")


def json_level(fields) -> Column:
    level = F.upper(strip(first_field(fields, LEVEL_KEYS)))
    return F.when(level == "", "INFO").otherwise(level)


def json_message(fields) -> Column:
    parts = F.array(first_field(fields, MESSAGE_KEYS), extra_fields(fields))
    return strip(F.array_join(F.filter(parts, lambda part: part != ""), " | "))


def parse_json(c) -> Column:
    """Event of a JSON line (no wrapper handling); anything else becomes UNKNOWN."""
    return bind(strip(c), lambda line: bind(json_fields(line), lambda fields: (
        F.when(fields.isNull(), event(F.lit(None).cast("string"), F.lit("UNKNOWN"), line))
         .otherwise(event(first_field(fields, TIME_KEYS), json_level(fields),
                          json_message(fields))))))


def wrapped_line(line, fields) -> Column:
    """Line inside a container wrapper ({"log": "...", "stream": ...}), else null.

    Inner text that is not JSON comes back cleaned.
    """
    line, fields = col(line), col(fields)
    wrapper = (F.contains(line, F.lit('"stream"')) & line.rlike(r'"log"[ \t\r\n]*:[ \t\r\n]*"')
               & F.map_contains_key(fields, "stream") & F.map_contains_key(fields, "log"))
    inner = strip(fields["log"])
    return F.when(wrapper & (inner != ""),
                  F.when(inner.startswith("{"), inner).otherwise(clean_line(inner)))


def unwrapped(line, depth: int | None = None) -> Column:
    """Innermost line inside container wrappers and whether it is to be read as JSON:
    ``struct<text, json>``.

    A line can't hold more wrappers than keys named log, so their number ends the walk; a
    `depth` ends it earlier, and so does a step that finds nothing to take off.
    """
    line = col(line)
    mark = F.lit('"log')
    mentions = ((F.length(line) - F.length(F.replace(line, mark, F.lit("")))) / 4).cast("int")
    if depth is not None:
        mentions = F.least(mentions, F.lit(depth))
    steps = F.when(F.contains(line, F.lit('"stream"')) & (mentions > 0), F.sequence(F.lit(1), mentions)) \
             .otherwise(F.array().cast("array<int>"))

    def state(text, json, more):
        return F.struct(text.alias("text"), json.alias("json"), more.alias("more"))

    def inside(now, _):
        taken = bind(wrapped_line(now["text"], F.when(now["json"], json_fields(now["text"]))),
                     lambda inner: F.when(inner.isNull(), state(now["text"], now["json"], F.lit(False)))
                     .otherwise(state(inner, inner.startswith("{"), F.lit(True))))
        return F.when(now["more"], taken).otherwise(now)

    return F.aggregate(steps, state(line, F.lit(True), F.lit(True)), inside)
