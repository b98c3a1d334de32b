"""Greedy cooldown picks in parallel.

A cooldown rule walks a timeline and keeps only the time of the last pick: a
candidate is picked when it is at least its own `cool` microseconds younger than
the last pick, or when there is none; a reset forgets the last pick. Walked
plainly, one busy timeline is one long sequential task. Here it runs in three
steps, each over bounded groups:

1. The timeline is cut into slices. They are at least as fine as asked for, so that
   a dense stretch stays bounded by its distinct microseconds, and wider where rows are
   few. Every slice is reduced to a step table that maps the last pick before the
   slice to the last pick after it. Only candidates near the start of the slice
   can make a difference, so the table is short.
2. Step tables are composed over groups of neighbouring slices, level by level,
   and the known state is then handed back down to every slice.
3. Every slice, knowing the state it starts from, walks its own candidates.

The result equals the sequential walk for any input.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import join_small, materialize

# Workers get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = -(1 << 62)     # state: no last pick
ALWAYS = (1 << 62)     # step bound that every state satisfies
FAN_BITS = 7           # slices composed per group: 128
SLICE_ROWS = 1_000_000  # rows a slice is widened to while time is sparse


def _successors(t, cool, reset):
    """For each row, the next pick after a pick there (len(t) when the slice has none)."""
    size = len(t)
    nxt = np.full(size, size, dtype=np.int64)
    candidate = np.flatnonzero(cool < ALWAYS)
    for step in np.unique(cool[candidate]):
        rows = np.flatnonzero(cool == step)
        found = np.searchsorted(t[rows], t + step, side="left")
        nxt = np.minimum(nxt, np.append(rows, size)[found])
    later_reset = _next_reset(reset)
    found = np.searchsorted(candidate, later_reset, side="left")
    return np.minimum(nxt, np.append(candidate, size)[found]), later_reset


def _next_reset(reset):
    """For each row, the first reset row after it (len when none)."""
    rows = np.flatnonzero(reset)
    found = np.searchsorted(rows, np.arange(len(reset)), side="right")
    return np.append(rows, len(reset))[found]


def _shorten(upto, out, start):
    """Drop steps that no state before `start` reaches and merge runs with one outcome."""
    if len(upto) == 0:
        return upto, out
    reach = np.searchsorted(upto, start, side="left")
    upto, out = upto[:reach + 1], out[:reach + 1]
    last = np.append(out[1:] != out[:-1], True)
    return upto[last], out[last]


def _slice_steps(t, cool, reset, start):
    """Step table of one slice: a state <= upto[i] (and above upto[i-1]) leaves as out[i]."""
    size = len(t)
    nxt, later_reset = _successors(t, cool, reset)
    last = np.where(nxt < size, nxt, np.arange(size))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    out = np.where(later_reset[last] < size, NEVER, t[last])

    candidate = np.flatnonzero(cool < ALWAYS)
    resets = np.flatnonzero(reset)
    bound = np.where(cool < ALWAYS, t - np.where(cool < ALWAYS, cool, 0), NEVER)
    if len(resets):
        free = np.searchsorted(candidate, resets[0], side="left")
        considered = candidate[:free + 1]
        bound[candidate[free:free + 1]] = ALWAYS
    else:
        considered = candidate
    limits = bound[considered]
    best = np.maximum.accumulate(limits) if len(limits) else limits
    record = np.append(True, best[1:] > best[:-1])[:len(limits)]
    upto, outcome = best[record], out[considered][record]
    if len(resets) and (len(upto) == 0 or upto[-1] < ALWAYS):
        upto, outcome = np.append(upto, ALWAYS), np.append(outcome, NEVER)
    return _shorten(upto, outcome, start)


def _apply(states, upto, out):
    found = np.searchsorted(upto, states, side="left")
    return np.where(found < len(upto), np.append(out, 0)[found], states)


def _compose(first, second, start):
    upto, out = first
    then_upto, then_out = second
    passed = then_upto > (upto[-1] if len(upto) else NEVER)
    return _shorten(np.append(upto, then_upto[passed]),
                    np.append(_apply(out, then_upto, then_out), then_out[passed]), start)


def _tables(pdf):
    """Step tables of a group of slices in time order."""
    pdf = pdf.sort_values(["node", "upto"], kind="stable")
    for node, part in pdf.groupby("node", sort=True):
        yield node, (part["upto"].to_numpy(), part["out"].to_numpy())


def cooldown_picks(df: DataFrame, keys: list[str], slice_us: int,
                   entry: DataFrame | None = None) -> DataFrame:
    """Rows picked by the cooldown rule: (keys, t, last); `last` is null when no pick was remembered.

    df: keys, t (microseconds), cool (microseconds > 0, null for a pure reset row) and
        reset (boolean, takes effect before the candidate at the same time).
    entry: optional (keys, last) with the pick before the first row. Rows up to that time
        are over and done with.
    """
    synthetic = not keys
    if synthetic:
        df = df.withColumn("_all", F.lit(0))
        entry = None if entry is None else entry.withColumn("_all", F.lit(0))
        keys = ["_all"]
    if entry is not None:
        # The known pick joins the timeline as a candidate that always passes.
        entry = entry.select(*keys, F.col("last").alias("_last")).filter("_last is not null")
        forced = entry.select(*keys, F.col("_last").alias("t"), F.lit(1).cast("bigint").alias("cool"),
                              F.lit(True).alias("reset"))
        df = (join_small(df, entry, keys, "left")
              .filter(F.col("_last").isNull() | (F.col("t") > F.col("_last")))
              .drop("_last").unionByName(forced))
    rows = (df.withColumn("node", F.floor(F.col("t") / slice_us).cast("bigint"))
              .groupBy(*keys, "node", "t")
              .agg(F.min("cool").alias("cool"), F.max("reset").alias("reset")))
    rows = materialize(rows)
    low, high, densest = (rows.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"))
                          .agg(F.min("node"), F.max("node"), F.max("n")).first())
    if low is None:
        low, high, densest = 0, 0, 1
    wider = max(1, SLICE_ROWS // densest)
    low, high, slice_us = low // wider, high // wider, slice_us * wider
    rows = rows.withColumn("node", F.floor(F.col("node") / wider).cast("bigint"))
    rows = rows.withColumn("node", F.col("node") - low)
    depth = 0
    while (high - low) >> (FAN_BITS * (depth + 1)):
        depth += 1

    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    step_ddl = f"{key_ddl}, node bigint, upto bigint, out bigint"
    state_ddl = f"{key_ddl}, node bigint, state bigint"

    def keyed(key, frame):
        for position, name in enumerate(keys):
            frame.insert(position, name, key[position])
        return frame

    def arrays(pdf):
        pdf = pdf.sort_values("t", kind="stable")
        cool = pdf["cool"].fillna(ALWAYS).astype("int64").to_numpy()
        return pdf["t"].to_numpy(), cool, pdf["reset"].to_numpy().astype(bool)

    def summarise(key, pdf):
        node = int(key[-1])
        upto, out = _slice_steps(*arrays(pdf), (node + low) * slice_us)
        return keyed(key, pd.DataFrame({"node": node, "upto": upto, "out": out}))

    def merger(width):
        def merge(key, pdf):
            parent = int(key[-1])
            table = (np.empty(0, np.int64), np.empty(0, np.int64))
            for _, following in _tables(pdf):
                table = _compose(table, following, parent * width + low * slice_us)
            return keyed(key, pd.DataFrame({"node": parent, "upto": table[0], "out": table[1]}))
        return merge

    levels = [rows.groupBy(*keys, "node").applyInPandas(summarise, step_ddl)]
    for level in range(depth):
        levels[-1] = materialize(levels[-1])
        parent = F.shiftright("node", FAN_BITS).alias("parent")
        levels.append(levels[-1].groupBy(*keys, parent).applyInPandas(
            merger(slice_us << (FAN_BITS * (level + 1))), step_ddl))

    def hand_down(key, pdf, before):
        state = int(before["state"].iloc[0]) if len(before) else NEVER
        nodes, states = [], []
        for node, (upto, out) in _tables(pdf):
            nodes.append(node)
            states.append(state)
            state = int(_apply(np.array([state]), upto, out)[0])
        return keyed(key[:len(keys)], pd.DataFrame({"node": nodes, "state": states},
                                                   dtype="int64"))

    def start(key, pdf):
        return hand_down(key, pdf, ())

    states = levels[-1].groupBy(*keys).applyInPandas(start, state_ddl)
    for table in reversed(levels[:-1]):
        parent = F.shiftright("node", FAN_BITS)
        states = (table.groupBy(*keys, parent.alias("parent"))
                  .cogroup(states.groupBy(*keys, F.col("node").alias("parent")))
                  .applyInPandas(hand_down, state_ddl))

    def walk(key, pdf):
        t, cool, reset = arrays(pdf)
        size = len(t)
        nxt, later_reset = _successors(t, cool, reset)
        last = int(pdf["state"].iloc[0])
        candidate = np.flatnonzero(cool < ALWAYS)
        first_reset = int(np.flatnonzero(reset)[0]) if reset.any() else size
        ready = candidate[t[candidate] - cool[candidate] >= last]
        freed = candidate[candidate >= first_reset]
        at = min(int(ready[0]) if len(ready) else size, int(freed[0]) if len(freed) else size)
        if at < size and first_reset <= at:
            last = NEVER
        picked, previous = [], []
        while at < size:
            picked.append(t[at])
            previous.append(None if last == NEVER else last)
            step = int(nxt[at])
            last = int(t[at])
            if step < size and later_reset[at] <= step:
                last = NEVER
            at = step
        return keyed(key[:-1], pd.DataFrame({
            "t": pd.array(picked, dtype="int64"), "last": pd.array(previous, dtype="Int64")}))

    picks = (rows.join(states, [*keys, "node"]).groupBy(*keys, "node")
             .applyInPandas(walk, f"{key_ddl}, t bigint, last bigint"))
    if entry is not None:
        picks = (join_small(picks, entry, keys, "left")
                 .filter(F.col("_last").isNull() | (F.col("t") > F.col("_last"))).drop("_last"))
    return picks.drop("_all") if synthetic else picks
