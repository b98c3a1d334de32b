"""Column functions on log text: cleaning, fingerprints, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, LEVEL_WEIGHTS, SIGNAL_LEVELS, Config

# The characters Unicode counts as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Fixed value: a digit run that does not continue a word, or a <digit>x hex literal.
VARIABLE_PART = r"(?<![A-Za-z0-9])(?:([0-9][xX])[0-9A-Fa-f]*|[0-9]+)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove surrounding white space, Unicode kinds included."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def clean_line(c) -> Column:
    """Drop NUL and CR, turn tabs into spaces, strip."""
    line = col(c)
    odd = (F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
           | F.contains(line, F.lit("\x00")))
    return strip(F.when(odd, F.translate(line, "\t\x00\r", " ")).otherwise(line))


def fingerprint(c) -> Column:
    """Message with its variable numbers replaced by ``*``; the clustering key."""
    return F.regexp_replace(col(c), VARIABLE_PART, "$1*")


def truncate(c, n: int) -> Column:
    """At most n characters, the last three of them dots when something was cut."""
    return F.when(F.length(col(c)) > n,
                  F.concat(F.substring(col(c), 1, n - 3), F.lit("..."))).otherwise(col(c))


def source_name(c) -> Column:
    """Last part of a path; both kinds of slash separate."""
    return F.regexp_extract(col(c), r"([^/\\]*)$", 1)


def level_weight(c) -> Column:
    """Severity weight; unlisted levels weigh 0."""
    weight = F.lit(0)
    for level, value in LEVEL_WEIGHTS.items():
        weight = F.when(col(c) == level, value).otherwise(weight)
    return weight


def is_signal(c="level", levels=SIGNAL_LEVELS) -> Column:
    return col(c).isin(*levels)


def display_line(ts="ts", level="level", message="message") -> Column:
    """``[HH:mm:ss] LEVEL -> message`` with the level padded to five characters."""
    padded = F.when(F.length(col(level)) < 5, F.rpad(col(level), 5, " ")).otherwise(col(level))
    return F.concat(F.lit("["), F.date_format(col(ts), "HH:mm:ss"), F.lit("] "), padded,
                    F.lit(" -> "), col(message))


def age_label(ts, now) -> Column:
    """How long before `now` a hit was: ``< 1s ago``, ``12s ago``, ``3m 4s ago``, ``5h ago``."""
    age = F.unix_micros(col(now)) - F.unix_micros(col(ts))
    seconds = (age / 1_000_000).cast("bigint")
    return (F.when(age < 1_000_000, "< 1s ago")
             .when(age < 60_000_000, F.format_string("%ds ago", seconds))
             .when(age < 3_600_000_000,
                   F.format_string("%dm %ds ago", F.floor(seconds / 60), seconds % 60))
             .otherwise(F.format_string("%dh ago", F.floor(seconds / 3600))))


def health(eps, wps, config: Config = DEFAULT) -> Column:
    """Health label of a pair of rates; errors outrank warnings."""
    e, w = col(eps), col(wps)
    return (F.when(e >= config.eps_critical, "CRITICAL SPIKE")
             .when(e >= config.eps_warn, "Unstable")
             .when(e >= config.eps_minor, "Minor Issues")
             .when(w >= config.wps_preincident, "Pre-Incident Warning")
             .when(w >= config.wps_suspicious, "Suspicious Activity")
             .when(w >= config.wps_pressure, "Pressure Building")
             .when((e < config.idle) & (w < config.idle), "IDLE")
             .otherwise("HEALTHY"))
