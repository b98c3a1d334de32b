"""Exact dedup against a history of digests held in minimal perfect hash tables.

Rows that come later are looked up in the tables of the history: a slot holds the full digest,
which is compared byte by byte, and the locator of the winner. Members are repeats; the others
are grouped by digest on their own.

A table is minimal: a bucket of n digests has n slots. Buckets hold about a thousand digests,
whatever the size of the history, so that each is built and probed by one small task.

Cases: a null text is an empty text. A row whose doc_id is null loses to every row that has one,
and is kept when its group has none. Repeated rows (same doc_id, same text) are copies of each
other and one of them stays. An empty table gives an empty result. Only ``doc_id`` and ``text``
are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.plans.scale import join_small

from .common import shares, staged, text_of

#: Digests in a bucket, on average.
BUCKET_DIGESTS = 1024
#: Digests that share a displacement, on average.
DISPLACED_TOGETHER = 4

INDEX_SCHEMA = ("bucket long, groups int, seeds binary, digests binary, doc_ids binary, "
                "row_nos binary, counts binary")
FOUND_SCHEMA = "digest binary, win_doc long, win_row long, group_size long, member boolean"
#: Stands for a null doc_id in a locator: below every other.
NO_ID = -(1 << 63)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number that tells repeated rows apart, written once."""
    found = docs.select("doc_id", F.unhex(F.sha2(text_of(), 256)).alias("digest"))
    return staged(found.withColumn("row_no", F.monotonically_increasing_id()), "digests")


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the locator of the row with the largest doc_id, and the number of rows."""
    locator = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.col("row_no").alias("row"))
    return (rows.groupBy("digest").agg(F.max(locator).alias("win"), F.count(F.lit(1)).alias("rows"))
            .select("digest", F.col("win.doc").alias("win_doc"), F.col("win.row").alias("win_row"),
                    "rows"))


def _bucketed(found: DataFrame, buckets: int) -> DataFrame:
    # The digest is uniform already; its first 15 hex digits are a number.
    prefix = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return found.withColumn("bucket", F.pmod(prefix, F.lit(buckets)))


def _slot(word, seed, n: int):
    """Slot of a digest under a displacement; for Python numbers and for numpy arrays of them."""
    if isinstance(word, int):
        x = (word + seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1
        x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        return (x ^ x >> 29) % n
    x = word + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(29)) % np.uint64(n)).astype(np.int64)


def build_slots(found: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Displacements that send n distinct digests (n x 32 bytes) to n slots, and those slots.

    Groups are placed from the largest to the smallest. A group tries displacements until all
    its digests fall on free slots; groups of one simply take the next free slot, which is
    stored as a negative number.
    """
    n = len(found)
    groups = max(1, -(-n // DISPLACED_TOGETHER))
    words = np.ascontiguousarray(found).view("<u8")
    members: list[list[int]] = [[] for _ in range(groups)]
    for i, g in enumerate((words[:, 1] % np.uint64(groups)).tolist()):
        members[g].append(i)
    seeds, slots, taken = np.zeros(groups, np.int32), np.zeros(n, np.int64), bytearray(n)
    word, free = words[:, 2].tolist(), 0
    for g in sorted(range(groups), key=lambda g: -len(members[g])):
        own = members[g]
        if len(own) == 1:
            while taken[free]:
                free += 1
            seeds[g], slots[own[0]], taken[free] = -free - 1, free, 1
        elif own:
            seed = 0
            while True:
                at = [_slot(word[i], seed, n) for i in own]
                if len(set(at)) == len(at) and not any(taken[a] for a in at):
                    break
                seed += 1
            seeds[g] = seed
            for i, a in zip(own, at):
                slots[i], taken[a] = a, 1
    return groups, seeds, slots


def probe_slots(probe: np.ndarray, groups: int, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot in which each digest would have to be."""
    words = np.ascontiguousarray(probe).view("<u8")
    seed = seeds[(words[:, 1] % np.uint64(groups)).astype(np.int64)]
    return np.where(seed < 0, -seed.astype(np.int64) - 1, _slot(words[:, 2], seed, n))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    found = _matrix(pdf["digest"])
    groups, seeds, slots = build_slots(found)
    order = np.argsort(slots)
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iloc[0])], "groups": [groups], "seeds": [seeds.tobytes()],
        "digests": [found[order].tobytes()],
        **{to: [pdf[name].to_numpy(np.int64)[order].tobytes()]
           for to, name in (("doc_ids", "win_doc"), ("row_nos", "win_row"), ("counts", "rows"))}})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Hash tables over the distinct digests of a history (see ``winners``), one row for each
    bucket, written to the shared folder."""
    return staged(_bucketed(history, buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA),
                  "digest-index")


def _look_up(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    names = ["digest", "win_doc", "win_row", "group_size", "member"]
    new = probes.rename(columns={"rows": "group_size"}).assign(member=False)[names]
    if index.empty:
        return new
    row = index.iloc[0]
    slots = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    docs, rows, counts = (np.frombuffer(row[k], np.int64).copy()
                          for k in ("doc_ids", "row_nos", "counts"))
    if len(new):
        asked = _matrix(new["digest"])
        at = probe_slots(asked, int(row["groups"]), np.frombuffer(row["seeds"], np.int32), len(slots))
        hit = (slots[at] == asked).all(axis=1)
        at, repeats = at[hit], new[hit]
        counts[at] += repeats["group_size"].to_numpy(np.int64)
        # A history made of smaller doc_ids than its repeats have gets new winners.
        later = repeats["win_doc"].to_numpy(np.int64) > docs[at]
        docs[at[later]] = repeats["win_doc"].to_numpy(np.int64)[later]
        rows[at[later]] = repeats["win_row"].to_numpy(np.int64)[later]
        new = new[~hit]
    held = pd.DataFrame({"digest": [d.tobytes() for d in slots], "win_doc": docs, "win_row": rows,
                         "group_size": counts, "member": True})[names]
    return pd.concat([held, new], ignore_index=True) if len(new) else held


def look_up(index: DataFrame, probes: DataFrame, buckets: int) -> DataFrame:
    """Winners of the history, brought up to date, and of the digests it doesn't hold.

    ``probes`` has a row for each digest (see ``winners``), so a text that fills a third of the
    table is one probe.
    """
    return (index.groupBy("bucket").cogroup(_bucketed(probes, buckets).groupBy("bucket"))
            .applyInPandas(_look_up, FOUND_SCHEMA))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, from_history.

    The upper half of the doc_ids is taken as the history, and the lower half as the rows that
    are looked up, so that winners of the history (the largest doc_id stays) remain winners.
    """
    rows = digests(docs)
    ends = rows.agg(F.min("doc_id").cast("double").alias("low"), F.count(F.lit(1)).alias("rows"),
                    F.max("doc_id").cast("double").alias("high")).first()
    middle = ((ends["low"] or 0.0) + (ends["high"] or 0.0)) / 2
    old = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    # Half the rows at most are distinct digests of the history.
    buckets = shares(ends["rows"], 2 * BUCKET_DIGESTS)
    groups = look_up(build_index(winners(rows.filter(old)), buckets),
                     winners(rows.filter(~old)), buckets)
    return rows.join(groups, "digest").select(
        "doc_id",
        F.when(F.col("win_doc") != F.lit(NO_ID), F.col("win_doc")).alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("win_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("from_history"))


def keep_winners(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Only what is dropped is joined to the texts: documents that lose, and rows that repeat a winner
    with its doc_id, of which one stays. Texts move where these are too many to be told to all tasks.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    fates = (exact_dedup(docs).groupBy(own.alias("__id"), F.unhex("text_sha256").alias("__digest"))
             .agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
             .filter(~F.col("kept") | (F.col("rows") > 1))
             .select("__id", "__digest", F.col("kept").alias("__repeats")))
    marked = join_small(docs.withColumns({"__id": own, "__digest": F.unhex(F.sha2(text_of(), 256))}), fates,
                        ["__id", "__digest"], "left")
    # Repeated rows have the same doc_id and text, so one of them is as good as another.
    single = marked.filter(F.col("__repeats").isNull())
    return single.union(marked.filter("__repeats").dropDuplicates(["__id", "__digest"])).select(*docs.columns)
