from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START
from logfathom.config import Config, micros
from logfathom.operators import alerts as A
from logfathom.operators import filters as L
from logfathom.operators import incidents as I
from logfathom.operators import rates as V
from logfathom.operators import reports as G


def at(seconds):
    return START + timedelta(seconds=seconds)


def naive(rows, column):
    """Times of a column as naive UTC datetimes, in order."""
    return [r[0] for r in rows.select(F.col(column).cast("timestamp_ntz")).orderBy(column).collect()]


THREE = [(0, "ERROR", "Database down"), (1, "INFO", "User logged in"), (2, "WARN", "Slow disk")]


@pytest.mark.parametrize("text,count", [("Database", 1), ("WARN", 1), ("", 3), ("dataBASE", 1), ("%", 0)])
def test_filter(make_events, text, count):
    assert L.filter_logs(make_events(THREE), text).count() == count


def test_search(make_events):
    events = make_events([(i, "ERROR" if i % 2 else "Warn", f"Log_{i} 100%") for i in range(50)])
    rows = L.search(events, "LOG_", "warn", 5).collect()
    assert [r.seq for r in rows] == [48, 46, 44, 42, 40]
    assert L.search(events, "l%g").count() == 0 and L.search(events, limit=0).count() == 50
    plan = L.search(events, "log", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert [L.api_limit(t) for t in (None, "", "x", "-1", "0", "7")] == [500] * 5 + [7]


def test_min_level(make_events):
    events = make_events([(0, level, "x") for level in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")])
    def kept(level):
        return [r.level for r in L.min_level(events, level).orderBy("seq").collect()]
    assert kept("warn") == ["WARN", "ERROR"]
    assert kept("DEBUG") == kept("") == kept("odd") == ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]


def test_source_choice(make_events):
    events = make_events([(0, "INFO", "x", "a"), (0, "INFO", "y", "b")])
    names = {s: L.for_source(events, s, ["b", "a"]).first().source for s in ("a", "b", "all", "", "zz")}
    assert names == {"a": "a", "b": "b", "all": "b", "": "b", "zz": "b"}


def test_history(spark):
    events = spark.range(50_010).select(
        F.lit("app").alias("source"), F.col("id").alias("seq"),
        F.timestamp_micros(F.col("id")).alias("ts"), F.lit("INFO").alias("level"),
        F.concat(F.lit("Log "), F.col("id").cast("string")).alias("message"))
    kept = L.history(events, 50_000)
    ends = kept.agg(F.min_by("message", "seq"), F.max_by("message", "seq"), F.count("*")).first()
    assert list(ends) == ["Log 10", "Log 50009", 50_000]


@pytest.mark.parametrize("size,kept", [(2_500, 1_500), (500, 500), (2_000, 2_000)])
def test_viewport(make_events, size, kept):
    rows = L.tail(make_events([(0, "INFO", "x")] * size)).select("seq").collect()
    assert len(rows) == kept and max(r.seq for r in rows) == size - 1


def test_counts_and_last_seen(make_events):
    events = make_events([(5, "ERROR", "a"), (3, "ERROR", "b"), (9, "INFO", "c"), (1, "FATAL", "d")])
    assert G.totals(events).first().total_lines == 4
    assert {r.level: r["count"] for r in G.level_counts(events).collect()} == {
        "ERROR": 2, "INFO": 1, "FATAL": 1}
    # The last arrived one counts, not the latest time.
    assert naive(G.last_seen(events), "last_error_ts") == [at(3)]
    assert G.last_seen(events).first().last_warn_ts is None


def test_heartbeat(make_events):
    events = make_events([(0, "WARN", "w"), (1, "WARN", "w"), (2, "WARN", "w"), (3, "ERROR", "e2"),
                          (4, "ERROR", "e1"), (5, "INFO", "i"), (3700, "WARN", "late"), (7300, "INFO", "i")])
    rows = G.heartbeat(events).orderBy("window_start").collect()
    assert [r.top_issue for r in rows] == ["[ERROR] e1 (1 times)", "[WARN] late (1 times)", "None (0 times)"]
    assert rows[0].report == ("HEARTBEAT [12:00]\nDuration: 1h0m0s\nErrors: 2 | Warns: 3 | Info: 1\n"
                              "Top Issue: [ERROR] e1 (1 times)\n")


def test_trend_and_scale(make_events):
    events = make_events([(0, "INFO", "x"), *[(2, "ERROR", "x")] * 100, (4, "WARN", "x")])
    rows = V.trend(events, 60).orderBy("tick").collect()
    assert [r.errors for r in rows] == [0, 0, 100, 0, 0] and rows[-1].warns == 1
    assert [r.errors for r in V.trend(events, 3).orderBy("tick").collect()] == [100, 0, 0]
    scaled = V.normalize_trend(V.trend(events)).orderBy("tick").collect()
    assert [r.scaled for r in scaled] == [0, 0, 1, 0, 0] and scaled[0].axis_max == 100
    quiet = V.normalize_trend(V.trend(make_events([(0, "INFO", "x"), (3, "INFO", "x")])))
    assert [r.scaled for r in quiet.collect()] == [0.0] * 4


def test_snapshot(make_events):
    events = make_events([(0, "ERROR", "a 1"), (0, "ERROR", "a 2"), (1, "WARN", "b"), (3, "INFO", "c")])
    row = G.snapshot_row(events).first()
    assert (row.total_lines, row.error, row.eps, row.peak_eps, row.status) == (
        4, 2, 0.5, 2.0, "Minor Issues")
    assert row.trend_error == [2, 0, 0, 0]
    parts = G.snapshot(events)
    assert parts["top_patterns"].first().pattern == "a *" and parts["sample"].count() == 4


def burst(second, count, level="ERROR"):
    return [(second + i / (count + 1), level, f"boom {i}") for i in range(count)]


def test_spike_gives_one_incident(make_events):
    rows = [r for s in range(10) for r in burst(s, 1)] + burst(10, 50) + [(11.2, "ERROR", "last"), (11.5, "WARN", "w")]
    found = I.incidents(make_events(rows)).collect()
    assert len(found) == 1 and found[0].level == "ERROR" and found[0].window_start is None
    assert naive(I.incidents(make_events(rows)), "incident_ts") == [at(11.2)]


def test_critical_rate_reports_every_minute_and_recovery_forgets(make_events):
    rows = [r for s in range(200) for r in burst(s, 6)]
    events = make_events(rows)
    times = naive(I.incidents(events), "incident_ts")
    assert len(times) == 4 and all(b - a >= timedelta(minutes=1) for a, b in zip(times, times[1:]))
    quiet_then_again = rows[:6 * 60] + [r for s in range(400, 470) for r in burst(s, 6)]
    found = I.incidents(make_events(quiet_then_again)).orderBy("incident_ts").collect()
    assert [f.after_recovery for f in found][:2] == [False, True]
    assert found[1].window_start is None


def test_report_contents(make_events):
    config = Config(context_rows=7, signal_rows=5, hourly_ticks=4)
    rows = [(s, "INFO", f"i{s}") for s in range(10)] + burst(10, 50) + [(11.2, "WARN", "w 1")]
    report = I.incident_reports(make_events(rows), config=config).first()
    assert report.reason == "Anomaly: WARN Spike Detected"
    assert report.total_lines == 61 and report.peak_eps == 50.0
    assert [r.message for r in report.signal_history] == [*(f"boom {i}" for i in range(46, 50)), "w 1"]
    assert len(report.full_context) == 7 and report.full_context[-1].message == "w 1"
    assert report.hourly_trend_errors == [0, 0, 0, 50]
    assert report.started_at == "2026-03-08T12:00:00Z" and report.ended_at == "2026-03-08T12:00:11Z"


def test_alert_cooldown(make_events):
    events = make_events([(0, "ERROR", "a"), (5, "ERROR", "dropped"), (10, "ERROR", "dropped too"),
                          (10.1, "ERROR", "b"), (21, "WARN", "c"), (32, "ERROR", "d"), (43, "WARN", "e")])
    rows = A.alerts(events).orderBy("ts").collect()
    assert [(r.message, r.status) for r in rows] == [
        ("a", "NOTIFIED"), ("b", "LOGGED"), ("c", "NOTIFIED"), ("d", "NOTIFIED"), ("e", "NOTIFIED")]
    assert not any(r.push for r in rows)
    assert A.format_alert(A.alerts(events)).orderBy("ts").first().line == (
        "[2026-03-08 12:00:00] [NOTIFIED] ERROR: a")


def test_gate_is_shared_by_all_sources(make_events):
    events = make_events([(0, "ERROR", "x", "a"), (4, "WARN", "y", "b"), (11, "WARN", "z", "b")])
    assert [r.message for r in A.throttle(events).orderBy("ts").collect()] == ["x", "z"]


def test_push_needs_topic_and_rate(make_events):
    events = make_events([r for s in range(30) for r in burst(s, 3)])
    rows = A.alerts(events, topic="t").orderBy("ts").collect()
    assert [(r.status, r.push) for r in rows] == [("NOTIFIED", False), ("LOGGED", False), ("NOTIFIED", True)]


def test_durations():
    assert micros("90 seconds") == 90_000_000
    with pytest.raises(ValueError):
        micros("1 month")
