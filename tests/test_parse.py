import json
import random
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logfathom.functions import parsing as P
from logfathom.functions import text as X
from logfathom.operators.parse import detect_format, parse_logs

TEXT_CASES = [
    ("2026-03-08 10:00:00 [FATAL] x", "FATAL", "x", "2026-03-08 10:00:00"),
    ("2026-03-08T10:00:00 [FATAL] x", "FATAL", "x", None),
    ('level="error" msg=x', '"ERROR"', "x", None),
    ('loglevel=warn msg="a', "WARN", '"a', None),
    ('msg="a" level=warn,x time=bad', "WARN", "a | level=warn,x time=bad", None),
    ("level=warn msg=", "WARN", "", None),
    ("level=warn msg=a  b", "WARN", "a | b", None),
    ('app | time=2026-03-08T15:20:45.5+01:00 level=debug msg="x"', "DEBUG", "x", "2026-03-08 14:20:45.5"),
    ('time="2026-03-08T15:20:45Z level=info msg=x', "INFO", "x", None),
    ("\t[warn]\tdisk\x00 full\r", "WARN", "disk full", None),
    ("] [ERROR] x", "UNKNOWN", "] [ERROR] x", None),
    ("2026-03-08 5:04:05 [INFO] early", "INFO", "early", "2026-03-08 05:04:05"),
]

JSON_CASES = [
    ('{"level":"info","level":"error","msg":"a"}', "ERROR", "a", None),
    ('{"x":1,"msg":"a","x":2,"msg":"b"}', "INFO", "b | x=2", None),
    ('{"level":null,"severity":"ERROR"}', "INFO", "", None),
    ('{"level":"error","error":"boom"}', "ERROR", "boom | error=boom", None),
    ('{"a":1} trailing', "UNKNOWN", '{"a":1} trailing', None),
    ('{"a":1},{"b":2}', "UNKNOWN", '{"a":1},{"b":2}', None),
    ("{'a':1}", "UNKNOWN", "{'a':1}", None),
    ('{"msg":"x","flag":true,"none":null,"in":{"b":1}}', "INFO", 'x | flag=true | in={"b":1} | none=null', None),
    ('{"log":"2026-03-08 15:00:00 [ERROR] lost\\n","stream":"stdout","time":"2026-01-01T00:00:00Z"}',
     "ERROR", "lost", "2026-03-08 15:00:00"),
    ('{"log":"{\\"level\\":\\"warn\\",\\"msg\\":\\"in\\"}\\n","stream":"stderr"}', "WARN", "in", None),
    ('{"log":"","stream":"stdout"}', "INFO", "log= | stream=stdout", None),
    ('{"log":5,"stream":"stdout"}', "INFO", "log=5 | stream=stdout", None),
]


def made_text(rng):
    """A line of a random layout and what the rules of that layout make of it."""
    moment = datetime(2026, 3, 8, rng.randrange(24), rng.randrange(60), rng.randrange(60))
    level = rng.choice(["Info", "WARN", "error", "debug", "Notice", "fatal"])
    words = " ".join(rng.choice(["pump", "Valve", "(7)", "a/b", "42%"]) for _ in range(rng.randint(1, 4)))
    layout = rng.choice(["logfmt", "bracket", "plain", "other"])
    if layout == "other":
        return f"~ {words}", "UNKNOWN", f"~ {words}", None
    if layout == "bracket":
        return f"{moment} [{level}] {words}", level.upper(), words, str(moment)
    if layout == "plain":
        return f"{moment} {level} {words}", level.upper(), words, str(moment)
    timed = rng.random() < .5
    extra = rng.choice(["", f"zone={rng.randint(1, 9)}"])
    head = [f"level={level}"] + ([f'time="{moment.isoformat()}Z"'] if timed else [])
    rng.shuffle(head)
    line = " ".join([*head, f'msg="{words}"', *([extra] if extra else [])])
    return line, level.upper(), f"{words} | {extra}" if extra else words, str(moment) if timed else None


def made_json(rng):
    """A JSON line with keys of every role present or not, in any order, and what the rules say."""
    fields, level, message, ts = {}, "INFO", "", None
    if rng.random() < .7:
        value = rng.choice(["warn", "Error", "fatal", ""])
        fields[rng.choice(P.LEVEL_KEYS)] = value
        level = value.upper() or "INFO"
    if rng.random() < .7:
        message = rng.choice(["gate open", "7 of 9", ""])
        fields[rng.choice(["msg", "message"])] = message
    if rng.random() < .5:
        moment = datetime(2026, 3, 8, rng.randrange(24), rng.randrange(60))
        fields[rng.choice(P.TIME_KEYS)], ts = f"{moment.isoformat()}Z", str(moment)
    extras = {name: rng.choice([rng.randint(0, 99), True, None, "text"])
              for name in rng.sample(["zone", "unit", "Rate", "x_1"], rng.randint(0, 3))}
    keys = [*fields, *extras]
    rng.shuffle(keys)
    shown = [f"{k}={v if isinstance(v, str) else json.dumps(v)}" for k, v in sorted(extras.items())]
    return json.dumps({k: (fields | extras)[k] for k in keys}), level, " | ".join(filter(None, [message, *shown])), ts


@pytest.mark.parametrize("made, layout", [(made_text, "text"), (made_json, "json")])
def test_made_lines(make_raw, made, layout):
    rng = random.Random(8)
    cases = [made(rng) for _ in range(400)]
    rows = parse_logs(make_raw([c[0] for c in cases]), layout).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    check(rows.collect(), cases)


def check(rows, cases):
    got = {r.seq: r for r in rows}
    for i, (line, level, message, ts) in enumerate(cases):
        assert (got[i].level, got[i].message) == (level, message), line
        assert (pd.Timestamp(got[i].event_ts) if got[i].event_ts else None) == (
            pd.Timestamp(ts) if ts else None), line


def test_text_cases(make_raw):
    raw = make_raw([c[0] for c in TEXT_CASES])
    rows = parse_logs(raw, "text").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    check(rows.collect(), TEXT_CASES)
    single = raw.select("seq", P.parse_text("line").alias("e")).select(
        "seq", "e.level", "e.message", F.col("e.event_ts").cast("timestamp_ntz").alias("event_ts"))
    check(single.collect(), TEXT_CASES)


def test_json_cases(make_raw):
    raw = make_raw([c[0] for c in JSON_CASES])
    rows = parse_logs(raw, "json").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    check(rows.collect(), JSON_CASES)


def wrap(line, times):
    for _ in range(times):
        line = json.dumps({"log": line + "\n", "stream": "stdout"})
    return line


def test_wrappers_come_off_at_any_depth(make_raw):
    raw = make_raw([wrap("level=warn msg=deep", k) for k in range(1, 7)]
                   + [wrap('{"level":"error","msg":"in"}', k) for k in range(1, 5)])
    rows = parse_logs(raw, "json").orderBy("seq").collect()
    assert [(r.level, r.message) for r in rows] == [("WARN", "deep")] * 6 + [("ERROR", "in")] * 4
    shallow = parse_logs(raw.filter("seq = 1"), "json", unwrap_depth=1).first()
    assert shallow.message == "log=level=warn msg=deep\n | stream=stdout"


def test_blank_lines_are_dropped_and_missing_times_filled(spark):
    stamp = datetime(2026, 1, 1, tzinfo=timezone.utc)
    raw = spark.createDataFrame([("s", line, 0, stamp) for line in ("  \t", "\x00\r", "plain")],
                                "source string, line string, seq bigint, ingest_ts timestamp")
    rows = parse_logs(raw, "text").collect()
    assert [r.message for r in rows] == ["plain"]
    assert rows[0].event_ts is None and rows[0].ts.year == 2026


def test_own_parser(make_raw):
    def pipes(line):
        parts = F.split(line, "[|]")
        return F.struct(F.lit(None).cast("timestamp").alias("event_ts"),
                        F.upper(parts[0]).alias("level"), parts[1].alias("message"))
    raw = make_raw(["error|disk gone", "warn|disk slow"])
    rows = parse_logs(raw, "pipes", parsers={"pipes": pipes}).orderBy("seq").collect()
    assert [(r.level, r.message) for r in rows] == [("ERROR", "disk gone"), ("WARN", "disk slow")]


@pytest.mark.parametrize("json_lines,text_lines,want", [
    (3, 0, "json"), (0, 3, "text"), (7, 3, "json"), (3, 7, "text"), (5, 5, "text")])
def test_format_vote(make_raw, json_lines, text_lines, want):
    lines = ['{"msg":"x"}'] * json_lines + ["level=info msg=x"] * text_lines
    assert detect_format(make_raw(lines)).first().format == want


def test_format_vote_reads_the_first_ten_nonblank_lines(make_raw):
    raw = make_raw(["", " "] + ["level=info msg=x"] * 10 + ['{"a":1}'] * 50)
    assert detect_format(raw.repartition(5)).first().format == "text"


def test_times(spark):
    good = {"2026-03-08T15:04:05Z": "2026-03-08 15:04:05", "2026-03-08 15:04:05": "2026-03-08 15:04:05",
            "2026-03-08T15:04:05.123456789Z": "2026-03-08 15:04:05.123456",
            "2026-03-08T15:04:05+02:00": "2026-03-08 13:04:05",
            "2026-03-08 15:04:05,250": "2026-03-08 15:04:05.25"}
    bad = ["2026-03-08T15:04:05", "2026-03-08", "1712345678", "", "2026-02-30 00:00:00", "15:04:05"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select(
        "t", P.parse_ts("t").cast("string").alias("p")).collect()
    assert {r.t: r.p for r in rows} == {**good, **dict.fromkeys(bad)}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.truncate(F.lit("This is a very long text that has to be cut down some."), 10).alias("a"),
        X.truncate(F.lit("short"), 10).alias("b"), X.truncate(F.lit("exactly10!"), 10).alias("c"),
        X.truncate(F.lit("exactly11!!"), 10).alias("d"),
        X.source_name(F.lit("C:\\logs\\app.log")).alias("e"),
        X.source_name(F.lit("/var/log/web.log")).alias("f"),
        *[X.age_label(F.timestamp_micros(F.lit(0)), F.timestamp_micros(F.lit(age))).alias(f"g{i}")
          for i, age in enumerate([999_999, 1_000_000, 59_999_999, 61_000_000, 7_300_000_000])],
    ).first()
    assert list(row) == ["This is...", "short", "exactly10!", "exactly...", "app.log", "web.log",
                         "< 1s ago", "1s ago", "59s ago", "1m 1s ago", "2h ago"]


@pytest.mark.parametrize("eps,wps,label", [
    (0, 0, "IDLE"), (0.05, 0, "HEALTHY"), (0.5, 0, "Minor Issues"), (2, 0, "Unstable"),
    (100, 0, "CRITICAL SPIKE"), (0, 60, "Pressure Building"), (0, 110, "Suspicious Activity"),
    (0, 210, "Pre-Incident Warning"), (2, 210, "Unstable")])
def test_health(spark, eps, wps, label):
    assert spark.range(1).select(X.health(F.lit(eps), F.lit(wps))).first()[0] == label
