import random

import pytest
from pyspark.sql import functions as F

from logfathom.functions.text import fingerprint
from logfathom.operators import cluster as C

# Each rule of the fingerprint, with a message made for it.
RULES = {
    "no digit, no change": ("ledger is closed", "ledger is closed"),
    "a number between separators": ("slot 7 of 12", "slot * of *"),
    "every part of a dotted number": ("took 0.25, v 1.2.3", "took *.*, v *.*.*"),
    "a unit stays behind its number": ("waited 40ms", "waited *ms"),
    "letters before digits are a name": ("queue7 at lane9b", "queue7 at lane9b"),
    "an underscore separates": ("lane_9 and lane_", "lane_* and lane_"),
    "hexadecimal keeps its prefix": ("at 0xBEEF and 9Xff", "at 0x* and 9X*"),
    "a prefix needs no digits": ("mask 0x,", "mask 0x*,"),
    "after a number a letter starts a word": ("5a5 b", "*a5 b"),
    "quotes and brackets separate": ('["31"] (8)', '["*"] (*)'),
    "other alphabets separate": ("é4 ж5", "é* ж*"),
    "nothing": ("", ""),
}


def test_fingerprint_rules(spark):
    rows = spark.createDataFrame([(k, *v) for k, v in RULES.items()], "rule string, m string, want string")
    got = rows.select("rule", "want", fingerprint("m").alias("got")).collect()
    assert {r.rule: r.got for r in got} == {r.rule: r.want for r in got}
    assert all(by_character(m) == want for m, want in RULES.values())


def by_character(message):
    """Fingerprint by walking the characters."""
    out, i, word = [], 0, False
    while i < len(message):
        c = message[i]
        digit = c.isascii() and c.isdigit()
        if digit and not word:
            i += 1
            if i < len(message) and message[i] in "xX":
                out.append(c + message[i] + "*")
                i += 1
                while i < len(message) and message[i] in "0123456789abcdefABCDEF":
                    i += 1
            else:
                out.append("*")
                while i < len(message) and message[i] in "0123456789":
                    i += 1
            # What follows a number starts like after a separator, unless it is a letter.
            word = False
            continue
        out.append(c)
        word = c.isascii() and c.isalnum()
        i += 1
    return "".join(out)


def test_fingerprint_of_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0019xXafgZ_ .:=é-") for _ in range(rng.randint(0, 24)))
             for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "m string").select(
        "m", fingerprint("m").alias("got")).collect()
    assert [(r.m, r.got, by_character(r.m)) for r in rows if r.got != by_character(r.m)][:3] == []


EVENTS = [
    (0, "ERROR", "crate refused | lid=101"), (1, "INFO", "fine 1"),
    (2, "WARN", "slow disk 7"), (3, "ERROR", "crate refused | lid=102"),
    (4, "WARN", "crate refused | lid=101"), (5, "UNKNOWN", "odd 9"), (6, "WARN", "slow disk 8"),
    (7, "WARN", "slow disk 8"),
]


def test_two_variants_form_one_pattern(make_events):
    events = make_events(EVENTS)
    rows = {r.pattern: r for r in C.patterns(events).collect()}
    assert rows["crate refused | lid=*"]["count"] == 3
    assert rows["crate refused | lid=*"].level == "ERROR"
    assert C.variants(events).filter("pattern like 'crate%'").count() == 2
    top = [(r.level, r.pattern, r["count"]) for r in C.top_patterns(events).collect()]
    assert top == [("ERROR", "crate refused | lid=*", 3), ("WARN", "slow disk *", 3)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_counts_do_not_depend_on_partitioning(spark, make_events, parts):
    events = make_events([(i, "ERROR", f"job {i % 50} failed x{i % 3}") for i in range(5000)])
    rows = C.patterns(events.repartition(parts)).collect()
    assert sorted((r.pattern, r["count"], r.first_seq) for r in rows) == [
        (f"job * failed x{k}", 5000 // 3 + (k < 5000 % 3), k) for k in range(3)]


def test_pattern_limit_keeps_the_first_seen(make_events):
    events = make_events([(i, "ERROR", f"kind{chr(97 + i % 20)} failed") for i in range(100)])
    kept = {r.pattern for r in C.patterns(events, max_patterns=3).collect()}
    assert kept == {"kinda failed", "kindb failed", "kindc failed"}
    assert {r.pattern for r in C.variants(events, max_patterns=3).collect()} == kept


def test_hit_times(make_events):
    events = make_events([(i, "ERROR", f"job {i % 60} failed") for i in range(3000)]).repartition(9)
    times = C.variant_times(events).collect()
    assert len({r.message for r in times}) == 50 and len(times) == 50 * 20
    first = sorted((r.rank, r.ts) for r in times if r.message == "job 0 failed")
    assert [r for r, _ in first] == list(range(1, 21))
    assert first[0][1] > first[-1][1] and (first[0][1] - first[-1][1]).seconds == 19 * 60
    last = C.pattern_times(events).first().times
    assert len(last) == 100 and last == sorted(last)


def test_last_n_is_limited_before_the_shuffle(make_events):
    events = make_events(EVENTS)
    plan = C.pattern_times(events)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_inspect(make_events):
    events = make_events(EVENTS)
    rows = {r.message: r for r in C.inspect(events, "slow disk *").collect()}
    assert rows["slow disk 8"]["count"] == 2 and rows["slow disk 8"].total == 3
    assert rows["slow disk 8"].times == sorted(rows["slow disk 8"].times, reverse=True)
    assert C.inspect(events, "no such thing").count() == 0
    row = C.inspect_map(events, "slow disk *").first()
    assert row.variants["slow disk 7"]["count"] == 1 and row.n_variants == 2


def test_recent_summary(make_events):
    rows = []
    for name, hits in zip("abcde", (100, 80, 60, 40, 20)):
        rows += [(0, "ERROR", f"kind{name} failed")] * hits
    line = C.recent_summary(make_events(rows), "60 seconds").first()
    assert line.errors == ("- kinda failed (100 hits)\n- kindb failed (80 hits)\n"
                           "- kindc failed (60 hits)\n")
    assert line.warns == "No new warnings."


def test_representative_prefers_the_smallest_of_equals(make_events):
    events = make_events([(0, "ERROR", "job 2"), (1, "ERROR", "job 1")])
    assert C.representative(events).first().message == "job 1"
