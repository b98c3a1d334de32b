import gzip
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logfathom.config import Config
from logfathom.operators import alerts as A
from logfathom.operators import cluster as C
from logfathom.operators import cluster
from logfathom.operators import incidents as I
from logfathom.operators import reports as G
from logfathom.operators.parse import order_by_time, parse_logs, times_from_neighbours
from logfathom.plans import position
from logfathom.plans.scale import materialize, path_exists, temporary_tables
from logfathom.sources import events, logs, reports, state


def test_lines_are_stripped_and_keep_their_order(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("\n".join(f"  line {i}\t" if i % 3 else "   " for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.read_logs(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        got = [r.line for r in rows.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(4000) if i % 3]
    row = rows.select(logs.source_folder().alias("folder"), "source", "ingest_ts").first()
    assert row.folder == tmp_path.name and row.source.endswith("app.log") and row.ingest_ts


def test_several_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"level":"error","msg":"x"}\n' * 3)
    (tmp_path / "b.log").write_text("level=warn msg=y\n" * 2)
    with gzip.open(tmp_path / "c.log.gz", "wt") as out:
        out.write("[INFO] z\n")
    raw = logs.read_logs(spark, f" {tmp_path}/a.log, ,{tmp_path}/b.log ,{tmp_path}/c.log.gz")
    rows = parse_logs(raw).groupBy("level", "message").count().collect()
    assert {(r.level, r.message, r["count"]) for r in rows} == {
        ("ERROR", "x", 3), ("WARN", "y", 2), ("INFO", "z", 1)}
    with pytest.raises(ValueError):
        logs.read_logs(spark, " , ")


def test_missing_stream_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        logs.stream_logs(spark, str(tmp_path / "nothing"))


@pytest.fixture
def incident_store(spark, make_events, tmp_path):
    rows = [(s, "ERROR", "boom", src) for src in ("/logs/a.log", "007") for s in range(10)]
    rows += [(10 + i / 60, "ERROR", f"boom {i}", src) for src in ("/logs/a.log", "007") for i in range(50)]
    rows += [(11.5, "ERROR", "last", src) for src in ("/logs/a.log", "007")]
    found = I.incident_reports(make_events(rows), config=Config(context_rows=5))
    path = str(tmp_path / "incidents")
    reports.write_incidents(found, path)
    return path


def test_incident_store(spark, incident_store, tmp_path):
    listed = reports.list_incidents(spark, incident_store).collect()
    assert len(listed) == 2 and {r.source for r in listed} == {"/logs/a.log", "007"}
    assert {r.filename for r in listed} == {"incident_2026-03-08_12-00-11.json"}
    assert listed[0].timestamp == "2026-03-08 12-00-11"
    only = reports.list_incidents(spark, incident_store, "007").collect()
    assert [(r.source, r.total_lines, r.peak_eps) for r in only] == [("007", 61, 50.0)]
    found = reports.get_incident(spark, incident_store, "some/dir/incident_2026-03-08_12-00-11.json", "007")
    fields = found.select(F.from_json("document", "source string, full_context array<struct<message:string>>").alias("d")).first().d
    assert fields.source == "007" and [e.message for e in fields.full_context][-1] == "last"
    with pytest.raises(LookupError):
        reports.get_incident(spark, incident_store, "incident_2000-01-01_00-00-00.json")
    for name in ("../secret", "incident_x.txt", "other.json"):
        with pytest.raises(ValueError):
            reports.get_incident(spark, incident_store, name)
    assert reports.list_incidents(spark, str(tmp_path / "none")).count() == 0


def test_corrupt_documents_are_skipped(spark, incident_store):
    spark.createDataFrame([('{"reason": "x", "source": ',)], "value string").write.mode("append").text(
        f"{incident_store}/source_key=z/date=2026-01-01/incident_id=incident_bad")
    assert reports.list_incidents(spark, incident_store).count() == 2


def test_incident_archive_opens_what_it_needs(spark, tmp_path):
    """Listing opens no document and a fetch one file; the last batch of an incident wins."""
    path = tmp_path / "archive"

    def found(batch, reason="first"):
        rows = [(src, f"incident_2026-03-08_12-00-{batch:02}", reason, 1.0, 0.0, batch, "a", "b", [f"row {batch}"])
                for src in ("a", "b")]
        return spark.createDataFrame(rows, "source string, incident_id string, reason string, peak_eps double, peak_wps double, "
                                     "total_lines long, started_at string, ended_at string, full_context array<string>")

    for batch in range(20):
        reports.write_incidents(found(batch), str(path))
    listed = reports.list_incidents(spark, str(path))
    once = listed.collect()
    assert len(once) == 40 and listed.inputFiles() and all("/headers/" in f for f in listed.inputFiles())
    assert len(list((path / "headers" / "parts").iterdir())) < 40
    name = once[7].filename
    page = reports.get_incident(spark, str(path), name, once[7].source)
    assert len([f for f in page.inputFiles() if "/documents/" in f]) == 1 and page.count() == 1
    assert reports.get_incident(spark, str(path), name).count() == 2

    for _ in range(2):
        reports.write_incidents(found(19, "again"), str(path), 20)
    last = reports.list_incidents(spark, str(path)).collect()
    assert [(r.filename, r.source) for r in last] == [(r.filename, r.source) for r in once]
    assert [r.reason for r in last].count("again") == 2 == [r.reason for r in last[:2]].count("again")
    page = reports.get_incident(spark, str(path), last[0].filename, "a").collect()
    assert len(page) == 1 and '"reason":"again"' in page[0].document
    documents = reports.fetch_incidents(listed.select("source", "filename"), str(path)).collect()
    assert len(documents) == 40 and sum('"again"' in r.document for r in documents) == 2
    assert reports.fetch_incidents(listed.select("source", F.lit("incident_x.json").alias("filename")), str(path)).count() == 0


def test_numbered_alert_lines_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "alerts")
    for batch, lines in ((0, ["a", "b"]), (1, ["c"]), (1, ["c"])):
        reports.write_alerts(spark.createDataFrame([(line,) for line in lines], "line string"), path, batch)
    reports.write_alerts(spark.createDataFrame([("d",)], "line string"), path)
    assert sorted(r.line for r in reports.read_alerts(spark, path).collect()) == ["a", "b", "c", "d"]


def test_alert_log_is_appended(spark, make_events, tmp_path):
    path = str(tmp_path / "alerts")
    events = make_events([(0, "ERROR", "a"), (30, "WARN", "b")])
    reports.write_alerts(A.format_alert(A.alerts(events)), path)
    reports.write_alerts(G.heartbeat_lines(events), path)
    text = {r.value for r in spark.read.text(path).collect()}
    assert "[2026-03-08 12:00:00] [NOTIFIED] ERROR: a" in text
    assert any(line.startswith("[2026-03-08 13:00:00] System Heartbeat: HEARTBEAT") for line in text)


def test_state_survives_sessions(spark, make_events, tmp_path):
    path = str(tmp_path / "state")
    rows = [(i, ("ERROR", "WARN", "INFO")[i % 3], f"job {i % 7}") for i in range(200)]
    events = make_events(rows)
    parts = [events.filter("seq < 90"), events.filter("seq >= 90")]
    for epoch, part in enumerate(parts):
        # Sessions count their own lines from zero.
        own = part.withColumn("seq", F.col("seq") - 90 * epoch)
        for _ in range(2):   # a retried save replaces itself
            state.save_state(state.partials(own, epoch), path, epoch)
    loaded = state.load_state(spark, path)
    want = {(r.pattern, r.level, r["count"], r.last_ts) for r in C.patterns(events).collect()}
    got = {(r.pattern, r.level, r["count"], r.last_ts) for r in state.state_patterns(loaded).collect()}
    assert got == want
    assert {(r.level, r["count"]) for r in state.state_level_counts(loaded).collect()} == {
        (r.level, r["count"]) for r in G.level_counts(events).collect()}
    assert state.state_last_seen(loaded).first() == G.last_seen(events).first()
    assert state.load_state(spark, path, reset=True).count() == 0
    assert state.load_state(spark, str(tmp_path / "none")).count() == 0


def test_stored_events_are_pruned(spark, tmp_path, make_events):
    rows = make_events([(i, "ERROR" if i % 2 else "INFO", f"job {i} failed", "ab"[i % 3 == 0]) for i in range(90)])
    path = str(tmp_path / "events")
    for _ in range(2):
        events.write_events(rows, path, "first")
    events.write_events(rows.withColumn("ts", F.lit(None).cast("timestamp")), path, "second")
    found = events.read_events(spark, path, "a", since="2026-03-08", until="2026-03-08")
    found = found.filter("pattern = 'job * failed'")
    assert found.count() == rows.filter("source = 'a' and level = 'ERROR'").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "source#" in plan.split("PartitionFilters")[1][:200]
    assert "EqualTo(pattern,job * failed)" in plan
    assert events.read_events(spark, path).count() == 2 * rows.count()
    listed = {r.message: r["count"] for r in cluster.variant_list(found, "job * failed").collect()}
    assert set(listed.values()) == {1}


def test_heads_of_files_tell_their_format(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("\n \n" + '{"m":1}\n' * 6 + "text\n" * 500)
    (tmp_path / "b.log").write_text("text\n" * 6 + '{"m":1}\n' * 500)
    (tmp_path / "c.log").write_text("")
    (tmp_path / "e f.log").write_text('{"m":1}\n')
    with gzip.open(tmp_path / "d.log.gz", "wt") as f:
        f.write('{"m":1}\n' * 3)
    rows = logs.detect_sources(spark, f"{tmp_path}/*").collect()
    assert {r.source.rsplit("/", 1)[-1]: r.format for r in rows} == {
        "x.log": "json", "b.log": "text", "c.log": "text", "d.log.gz": "json", "e%20f.log": "json"}
    assert logs.head_lines(spark, str(tmp_path / "b.log"), 3) == ["text"] * 3


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_order_within_a_second_is_that_of_the_file(spark, parts):
    stamp = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [("s", i, stamp, "ERROR" if i % 8 == 0 else "WARN", f"job {i // 8}x") for i in range(1600)]
    found = spark.createDataFrame(rows, "source string, seq long, ts timestamp, level string, message string")
    placed = order_by_time(found.repartition(parts))
    first = cluster.patterns(placed.withColumn("message", F.concat(F.lit("m"), F.translate("message", "0123456789", "abcdefghij"))))
    assert {r.level for r in first.collect()} == {"ERROR"}
    assert placed.select("seq").distinct().count() == 1600


def test_temporary_tables_go(spark):
    with temporary_tables(spark):
        kept = materialize(spark.range(5))
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 5 and path_exists(spark, path)
    assert not path_exists(spark, path)


def test_heads_are_read_by_tasks_and_end_early(spark, tmp_path, monkeypatch):
    (tmp_path / "many").mkdir()
    for i in range(200):
        (tmp_path / "many" / f"{i}.log").write_text(('{"m":1}\n' if i % 2 else "text\n") * 12)
    for name, line in (("big.log", '{"m":"' + "x" * 90 + '"}\n'), ("plain.log", "y" * 99 + "\n")):
        (tmp_path / "many" / name).write_text("\n \n" + line * 300_000)

    def opened(*_):
        raise AssertionError("the driver opens no file")

    def read():
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalInputBytes()

    monkeypatch.setattr(logs, "head_lines", opened)
    before = read()
    found = {r.source.rsplit("/", 1)[-1]: r.format for r in logs.detect_sources(spark, f"{tmp_path}/many").collect()}
    assert found == {"big.log": "json", "plain.log": "text"} | {
        f"{i}.log": "json" if i % 2 else "text" for i in range(200)}
    assert read() - before < 8 << 20   # of 60 MB


def test_one_time_over_several_stretches(spark):
    """A file without times: all rows of one time, over positions of several stretches."""
    stamp = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [("s" if i % 3 else "t", i * 40_000, stamp, "INFO", str(i)) for i in range(12)]
    placed = order_by_time(spark.createDataFrame(rows, "source string, seq long, ts timestamp, level string, message string"))
    for source in "st":
        own = placed.filter(F.col("source") == source).orderBy("seq").collect()
        assert [int(r.message) for r in own] == [i for i in range(12) if ("s" if i % 3 else "t") == source]
        assert [r.seq - own[0].seq for r in own] == list(range(len(own)))


def test_times_are_carried_over_groups_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(position, "STRETCHES", 2)
    step = 1 << position.STRETCH_BITS
    times = {3 * step: 10, 3 * step + 1: 11, 9 * step: 20}
    at = [0, step, 3 * step, 3 * step + 1, 3 * step + 2, 4 * step, 7 * step, 9 * step, 9 * step + 5, 12 * step]
    rows = [("s", seq, datetime.fromtimestamp(times[seq], timezone.utc) if seq in times else None, None) for seq in at]
    found = times_from_neighbours(spark.createDataFrame(
        rows, "source string, seq long, event_ts timestamp, ingest_ts timestamp").withColumn("ts", F.col("event_ts")))
    got = [r.t for r in found.orderBy("seq").select(F.unix_seconds("ts").alias("t")).collect()]
    assert got == [10, 10, 10, 11, 11, 11, 11, 20, 20, 20]
