import random

import pytest
from pyspark.sql import functions as F

from logfathom.plans import cooldown, position, scale
from logfathom.plans.running import rolling_ticks


def walk(rows, last=None):
    """The cooldown rule as a plain loop over (t, cool, reset)."""
    merged = {}
    for t, cool, reset in rows:
        known = merged.get(t, (None, False))
        cools = [c for c in (known[0], cool) if c is not None]
        merged[t] = (min(cools) if cools else None, known[1] or reset)
    picks = []
    for t in sorted(merged):
        cool, reset = merged[t]
        if last is not None and t <= last and not picks:
            continue
        if reset:
            last = None
        if cool is not None and (last is None or t - last >= cool):
            picks.append((t, last))
            last = t
    return picks


def timeline(rng, size, span, cools, resets):
    rows = []
    for _ in range(size):
        if rng.random() < resets:
            rows.append((rng.randrange(span), None, True))
        else:
            rows.append((rng.randrange(span), rng.choice(cools), False))
    return rows


DDL = "k string, t bigint, cool bigint, reset boolean"


@pytest.mark.parametrize("cools,resets,slice_us", [
    ([11], 0.0, 37), ([20], 0.0, 20), ([6, 30], 0.0, 64), ([6, 30], 0.1, 50), ([5, 9, 40], 0.3, 7)])
def test_parallel_picks_equal_the_loop(spark, monkeypatch, cools, resets, slice_us):
    monkeypatch.setattr(cooldown, "SLICE_ROWS", 1)   # keep the slices as short as given
    rng = random.Random(len(cools) * 100 + slice_us)
    lines = {f"k{i}": timeline(rng, rng.randint(1, 400), rng.choice([300, 3_000, 9_000]), cools, resets)
             for i in range(6)}
    df = spark.createDataFrame([(k, *row) for k, rows in lines.items() for row in rows], DDL)
    got = {k: [] for k in lines}
    for r in cooldown.cooldown_picks(df, ["k"], slice_us).collect():
        got[r.k].append((r.t, r.last))
    for k, rows in lines.items():
        assert sorted(got[k], key=lambda p: p[0]) == walk(rows), k


def test_step_tables_compose_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(cooldown, "FAN_BITS", 1)
    monkeypatch.setattr(cooldown, "SLICE_ROWS", 1)
    rng = random.Random(3)
    rows = timeline(rng, 600, 2_000, [6, 30], 0.05)
    df = spark.createDataFrame([("k", *row) for row in rows], DDL).drop("k")
    got = sorted(((r.t, r.last) for r in cooldown.cooldown_picks(df, [], 100).collect()), key=lambda p: p[0])
    assert got == [(t, last) for t, last in walk(rows)]


@pytest.mark.parametrize("widest", [1, 30, 1_000_000])
def test_picks_resume_from_a_known_state(spark, monkeypatch, widest):
    monkeypatch.setattr(cooldown, "SLICE_ROWS", widest)
    rng = random.Random(5)
    rows = sorted(timeline(rng, 300, 5_000, [6, 30], 0.05), key=lambda r: r[0])
    early = [r for r in rows if r[0] < 2_000]
    late = [r for r in rows if r[0] >= 2_000]
    last = walk(early)[-1][0]
    late.append((last, 6, False))   # over already
    df = spark.createDataFrame([("k", *row) for row in late], DDL)
    entry = spark.createDataFrame([("k", last), ("other", 9)], "k string, last bigint")
    got = sorted(((r.t, r.last) for r in cooldown.cooldown_picks(df, ["k"], 64, entry).collect()), key=lambda p: p[0])
    assert got == walk(late, last)


def test_no_rows_give_no_picks(spark):
    assert cooldown.cooldown_picks(spark.createDataFrame([], DDL), ["k"], 10).count() == 0


@pytest.fixture
def short_stretches(monkeypatch):
    monkeypatch.setattr(position, "STRETCH_BITS", 3)


def rows_for(spark, sizes):
    data = [(name, i, f"m{i}") for name, size in sizes.items() for i in range(size)]
    return spark.createDataFrame(data, "source string, seq bigint, message string").repartition(6)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100, 5000])
def test_edge_rows(spark, short_stretches, n):
    sizes = {"hot": 900, "mid": 60, "one": 1}
    df = rows_for(spark, sizes)
    for newest in (True, False):
        got = {}
        for r in position.edge_rows(df, n, newest).collect():
            got.setdefault(r.source, set()).add(r.seq)
        for name, size in sizes.items():
            want = range(max(0, size - n), size) if newest else range(min(n, size))
            assert got[name] == set(want)


def test_edge_rows_with_slack(spark, short_stretches):
    df = rows_for(spark, {"big": 251, "fits": 250})
    got = {r.source: r["n"] for r in position.edge_rows(df, 150, slack=100)
           .groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {"big": 150, "fits": 250}


def test_rows_before_and_counts(spark, short_stretches):
    df = rows_for(spark, {"a": 500, "b": 40})
    marks = spark.createDataFrame([("a", 1, 3), ("a", 2, 100), ("a", 3, 499), ("b", 4, 39)],
                                  "source string, mark bigint, mark_seq bigint")
    got = {}
    for r in position.rows_before(marks, df, 20).collect():
        got.setdefault(r.mark, {})[r["rank"]] = r.seq
    for mark, seq in ((1, 3), (2, 100), (3, 499), (4, 39)):
        assert got[mark] == {k + 1: seq - k for k in range(min(20, seq + 1))}
    totals = {r.mark: r.total for r in position.count_until(marks, df).collect()}
    assert totals == {1: 4, 2: 101, 3: 500, 4: 40}


def test_top_per_key_with_a_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 300).cast("string")).alias("k"),
        "id").repartition(16)
    got = position.top_per_key(df, ["k"], [F.col("id").desc()], 5).filter("k = 'hot'")
    assert {r["rank"]: r.id for r in got.collect()} == {
        1: 19_999, 2: 19_997, 3: 19_996, 4: 19_994, 5: 19_993}


def test_rolling_series_across_runs(spark):
    rng = random.Random(11)
    ticks = {}
    for source, low, high in (("a", 3, 400), ("b", 100, 130)):
        for idx in {low, high, *rng.sample(range(low, high), (high - low) // 2)}:
            ticks[source, idx] = (rng.randint(0, 9), rng.randint(0, 3))
    df = spark.createDataFrame([(s, i, e, w) for (s, i), (e, w) in ticks.items()],
                               "source string, idx bigint, errors bigint, warns bigint")
    n = 10
    for row in rolling_ticks(df, n, run=1).collect():   # runs of 8 n ticks
        low = min(i for s, i in ticks if s == row.source)
        dense = [ticks.get((row.source, i), (0, 0))[0] for i in range(low, row.idx + 1)]
        assert row.age == row.idx - low
        assert row.eps == pytest.approx(sum(dense[-n:]) / len(dense[-n:]))
        assert row.peak_eps == max(dense)
        if len(dense) > 1:
            past = dense[:-1]
            assert row.last_errors == past[-1] and row.last_peak_eps == max(past)
            assert row.last_eps == pytest.approx(sum(past[-n:]) / len(past[-n:]))


def test_carried_series_continues(spark):
    ddl = "source string, idx bigint, errors bigint, warns bigint"
    rows = [("a", i, i % 7, i % 3) for i in range(100)]
    whole = {r.idx: r for r in rolling_ticks(spark.createDataFrame(rows, ddl), 10).collect()}
    carry = spark.createDataFrame([("a", 0, 6, 2)], "source string, low bigint, top_errors bigint, top_warns bigint")
    part = rolling_ticks(spark.createDataFrame(rows[80:], ddl), 10, carry=carry)
    for r in part.filter("idx >= 90").collect():
        assert r.asDict() == whole[r.idx].asDict()


def test_broadcast_only_below_the_bound(spark):
    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")

    def plan(limit):
        return scale.join_small(big, small, ["k"], max_rows=limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10)
    assert "strategy=broadcast" not in plan(9)


def test_staged_columns_are_not_substituted(spark):
    df = scale.compute_once(spark.range(5), x=F.upper(F.col("id").cast("string")))
    plan = df.filter("x = '3'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and df.filter("x = '3'").count() == 1


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_ranks_of_several_kinds_of_rows(spark, monkeypatch, group):
    """Against counting, with stretches that hold none of a kind, or a mark and no row of it."""
    monkeypatch.setattr(position, "STRETCHES", group)
    rng = random.Random(group)
    rows = [(s, seq, None, "ERROR" if seq < 200_000 and rng.random() < 0.4 else "INFO")
            for s in "ab" for seq in sorted(rng.sample(range(700_000), 300))]
    df = spark.createDataFrame(rows, "source string, seq long, ts timestamp, level string")
    chosen = [(s, i, seq) for i, (s, seq, *_) in enumerate(rng.sample(rows, 40))]
    marks = spark.createDataFrame(chosen, "source string, mark long, mark_seq long")
    kinds = {"lines": F.lit(True), "errors": F.col("level") == "ERROR"}
    counts = position.kind_counts(df, kinds)
    got = {(r.source, r.mark): (r.lines, r.errors) for r in position.kind_ranks(marks, df, counts, kinds).collect()}
    assert got == {(s, i): (sum(r[0] == s and r[1] <= seq for r in rows),
                            sum(r[0] == s and r[1] <= seq and r[3] == "ERROR" for r in rows)) for s, i, seq in chosen}
