"""Streams over files that arrive one by one against the batch operators over all of them."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START
from logfathom.config import Config
from logfathom.operators import alerts as A
from logfathom.operators import cluster as C
from logfathom.operators import incidents as I
from logfathom.operators import rates as V
from logfathom.operators import reports as G
from logfathom.operators.parse import order_by_time, parse_logs
from logfathom.sources import logs, state
from logfathom.streaming import queries as S

CONFIG = Config(rolling_ticks=10, eps_critical=2.5, eps_warn=1.0,
                critical_cooldown="20 seconds", spike_cooldown="60 seconds")
FILES = 4


@pytest.fixture(scope="module")
def segments():
    """Text of four files: busy, quiet and bursting seconds of two sources."""
    rng = random.Random(2)
    files = []
    for part in range(FILES):
        lines = []
        for second in range(part * 40, part * 40 + 40):
            busy = 4 if second // 25 % 2 == 0 else (9 if rng.random() < 0.1 else 0)
            moments = sorted(rng.sample(range(1_000_000), busy + 1))
            for micros in moments:
                level = rng.choice(["error", "error", "warn", "info"])
                at = START + timedelta(seconds=second, microseconds=micros)
                lines.append(f'time="{at.isoformat(timespec="microseconds")}Z" level={level} '
                             f'msg="job {rng.randint(1, 5)} failed" svc={rng.choice("ab")}')
        files.append(lines)
    # A last line far behind closes every window.
    files[-1].append(f'time="{(START + timedelta(hours=3)).isoformat()}Z" level=info msg=end svc=a')
    return files


def source_of(path):
    return F.regexp_extract(path, "([^/]*)/[^/]*$", 1)


def run(spark, tmp_path, segments, start, apart=False, order=None):
    """Feed the files in turn; after each one the stream runs to its end and stops.

    With `apart` the files of one source all come before those of the other; `order` has the numbers
    of the files in the order in which they come, if it is another.
    """
    folder = tmp_path / "logs"
    for svc in "ab":
        (folder / svc).mkdir(parents=True)
    out = str(tmp_path / "out")
    turns = [(n, svc) for svc in "ab" for n in range(len(segments))] if apart else [
        (n, "ab") for n in order or range(len(segments))]
    for number, sources in turns:
        for svc in sources:
            (folder / svc / f"{number}.log").write_text(
                "".join(line + "\n" for line in segments[number] if line.endswith(f"svc={svc}"))
                + ("no time here\n" if apart else ""))
        events = S.stream_events(spark, f"{folder}/*", source=source_of)
        start(events, out, f"{out}-checkpoint").awaitTermination()
    raw = logs.read_logs(spark, f"{folder}/*").withColumn("source", source_of("source"))
    return out, order_by_time(parse_logs(raw, "text").filter("event_ts is not null")).cache()


def same(got, want, *columns):
    rows = [sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) for df in (got, want)]
    assert rows[0] == rows[1] and rows[0]


def test_counts(spark, tmp_path, segments):
    out, events = run(spark, tmp_path, segments, S.start_counts)
    loaded = state.load_state(spark, out)
    same(state.state_level_counts(loaded), G.level_counts(events), "source", "level", "count")
    same(state.state_patterns(loaded), C.patterns(events), "source", "pattern", "level", "count", "last_ts")
    same(state.state_last_seen(loaded), G.last_seen(events), "source", "last_error_ts", "last_warn_ts")


@pytest.mark.parametrize("apart", [False, True])
def test_ticks(spark, tmp_path, segments, apart):
    out, events = run(spark, tmp_path, segments, S.start_ticks, apart)
    same(S.read_ticks(spark, out), V.ticks(events), "source", "tick", "errors", "warns")
    ends = events.groupBy("source").agg(F.max("ts").alias("end"))
    closed = V.ticks(events).join(ends, "source").filter("tick + INTERVAL 11 SECONDS <= end")
    same(S.read_ticks(spark, out, delay="10 seconds"), closed, "source", "tick", "errors", "warns")


def test_reports(spark, tmp_path, segments):
    out, events = run(spark, tmp_path / "h", segments,
                      lambda e, o, c: S.start_heartbeat(e, o, c, "1 minute"), True)
    same(S.read_heartbeat(spark, out, "1 minute").drop("infos"), G.heartbeat(events, "1 minute"),
         "source", "window_start", "report")
    out, events = run(spark, tmp_path / "r", segments,
                      lambda e, o, c: S.start_recent_summary(e, o, c, "30 seconds"))
    same(S.read_recent_summary(spark, out, "30 seconds"), C.recent_summary(events, "30 seconds"),
         "source", "window_start", "errors", "warns")


@pytest.mark.parametrize("apart", [False, True])
def test_incidents(spark, tmp_path, segments, apart):
    out, events = run(spark, tmp_path, segments,
                      lambda e, o, c: S.start_incidents(e, o, c, config=CONFIG), apart)
    S.finish_incidents(spark, out, config=CONFIG)
    columns = ("source", "incident_ts", "level", "window_start", "after_recovery", "peak_eps", "peak_wps")
    same(S.read_incidents(spark, out), I.incidents(events, config=CONFIG), *columns)
    epochs = list((tmp_path / "out" / "state").glob("epoch=*"))
    assert len(epochs) == 2


@pytest.mark.parametrize("order", ["last first", "backwards", "shuffled"])
def test_incidents_of_late_segments(spark, tmp_path, segments, order):
    """Segments of one source in any order give the incidents of the batch."""
    numbers = list(range(len(segments)))
    numbers = {"last first": numbers[-1:] + numbers[:-1], "backwards": numbers[::-1],
               "shuffled": random.Random(3).sample(numbers, len(numbers))}[order]
    out, events = run(spark, tmp_path, segments, lambda e, o, c: S.start_incidents(e, o, c, config=CONFIG),
                      order=numbers)
    S.finish_incidents(spark, out, config=CONFIG)
    columns = ("source", "incident_ts", "level", "window_start", "after_recovery", "peak_eps", "peak_wps")
    same(S.read_incidents(spark, out), I.incidents(events, config=CONFIG), *columns)


def test_alerts(spark, tmp_path, segments):
    out, events = run(spark, tmp_path, segments,
                      lambda e, o, c: S.start_alerts(e, o, c, topic="t", config=CONFIG))
    columns = ("ts", "source", "level", "message", "status", "push")
    same(spark.read.parquet(f"{out}/alerts"), A.alerts(events, topic="t", config=CONFIG), *columns)


def test_alerts_of_a_late_source(spark, tmp_path, segments):
    out, events = run(spark, tmp_path, segments[2:],
                      lambda e, o, c: S.start_alerts(e, o, c, topic="t", config=CONFIG), True)
    columns = ("ts", "source", "level", "message", "status", "push")
    same(spark.read.parquet(f"{out}/alerts"), A.alerts(events, topic="t", config=CONFIG), *columns)


def test_only_new_files(spark, tmp_path, segments):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "old.log").write_text("level=info msg=old\n")
    later = "2099-01-01 00:00:00"
    for start_after, want in ((None, 1), (later, 0)):
        rows = logs.stream_logs(spark, str(folder), start_after)
        out = str(tmp_path / f"out{want}")
        (rows.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination())
        assert spark.read.schema("line string").parquet(out).count() == want
