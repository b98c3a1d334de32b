"""Near-duplicate groups by an exact Jaccard join in metric space.

1 - Jaccard is a metric, and with distance 1 between most texts pivots drawn at random tell
nothing apart. Pivots are therefore drawn where texts meet: two sets that reach the threshold
share one of their first shingles in any common order (prefix filter), and in each such list of
sets the most central one is a pivot. Rounds, each of them exact:

1. Regions: every set is measured against the pivots of its lists and belongs to the nearest one
   it links with, or is a region of its own. All members of a region are linked through its pivot,
   so pairs inside a region are never formed, however large it is.
2. Regions that share a list and are not connected yet join by their pivots at distance D. By the
   triangle inequality a member x of A can only link with a member y of B when
   D - d(x, A) - d(y, B) is at most the threshold; only such members (the windows at the
   boundary) are copied to the other region and compared.
3. Lists with many regions are cut first, by the second shingle that linked sets have to share.

Where regions meet, a task takes a list as a cell and rules pairs of regions out by sizes, parities
and radii; only what may hold a link leaves the task, so rows grow with the links that are left and
not with the pairs of a list. A cell of many regions is dealt out in pairs of blocks.

Texts with equal sets are one node throughout. The order of shingles puts frequent ones last; their
counts only steer the order, and no result depends on them.

Cases: a null or empty text has no shingles and links with nothing; fewer words than a shingle make
one shingle; equal sets have distance 0; a row with a null doc_id takes part, and a component has
the smallest doc_id that is not null; repeated rows are rows of one node; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfathom.plans.scale import join_small

from .common import kept, release, staged, text_of
from .components import components

WORDS = 5
#: Similarity in hundredths, so that it is compared in whole numbers.
SIMILAR = 80
#: Shingles whose frequency is told to all tasks, at most; of a batch, and in all.
FREQUENT_IN_BATCH, FREQUENT = 8_192, 65_536
#: Shingles that are counted together.
COUNTED_TOGETHER = 1_500_000
#: Bytes of texts whose shingles are made together.
PART_BYTES = 1 << 20
#: Lists longer than this are cut into parts.
PART = 10_000
#: Lists with more regions than this are cut by a second shingle.
MANY_REGIONS = 2_048
#: Regions that one task compares with one another, and rows of them at a time.
CELL, TILE = 2_048, 64
#: Rows that repeat the set of another one and are told to all tasks, at most.
MANY_REPEATS = 1 << 21
#: Shingles of the sets of one block of nodes that pairs are measured in, and the fewest and most blocks.
BLOCK_SHINGLES, FEWEST_BLOCKS, MOST_BLOCKS = 1 << 21, 16, 1_024
#: Largest distance of a link, with room for rounding.
REACH = 1 - SIMILAR / 100 + 1e-9
#: Most bits that a set's parities take.
MOST_BITS = 1 << 15
#: Bits of the parities that column expressions compare.
MARK_BITS = 1024
NO_ID = -(1 << 63)

SETS_SCHEMA = ("doc_id long, n int, digest binary, prefix array<long>, parts array<int>, "
               "bits binary, marks array<long>, text_digest binary")


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of the shingles of each text, some MB of texts at a time."""
    begin, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + size > PART_BYTES:
            yield from _part_sets(texts[begin:i], words)
            begin, held = i, 0
        held += size
    yield from _part_sets(texts[begin:], words)


def _part_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                         len(coded.dictionary))
    codes = np.asarray(coded.indices, np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = codes != empty
    before = np.concatenate([[0], np.cumsum(real)])
    offsets = np.asarray(split.offsets, np.int64)
    ends = before[offsets - offsets[0]].tolist()
    flat = hashes[codes[real]]
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for i in range(words if len(rolled) else 0):
        rolled = rolled * step + flat[i:len(flat) - words + 1 + i]
    rolled = _mixed(rolled)
    out = []
    for begin, end in zip(ends, ends[1:]):
        if end - begin >= words:
            out.append(np.unique(rolled[begin:end - words + 1]))
        elif end > begin:
            whole = np.array([end - begin], np.uint64)
            for h in flat[begin:end]:
                whole = whole * step + h
            out.append(_mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)


def parities(found: np.ndarray, size: int | None = None) -> bytes:
    """For each value of the last bits of the hashes, whether an odd number of shingles has it.

    Every shingle that only one of two sets holds flips one bit, so the bits in which two sets
    differ are at most the shingles in which they do.
    """
    if size is None:
        size = 64
        while size < min(2 * len(found), MOST_BITS):
            size *= 2
    counts = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """Bits in which parities differ; the longer ones are folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


@F.pandas_udf(T.DoubleType())
def _least_distance(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """A distance that two sets have at least, by their sizes and their parities."""
    out = []
    for m, n, x, y in zip(n_a, n_b, a, b):
        apart = max(abs(m - n), _differing(x, y))
        out.append(2.0 * apart / (m + n + apart))
    return pd.Series(out, dtype="float64")


def _digest(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent shingles of some sets; equal sets count once."""
    kept(("jaccard",), dict)

    def counted(distinct: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
        often = np.nonzero(counts >= 3)[0]
        often = often[np.argsort(-counts[often], kind="stable")][:FREQUENT_IN_BATCH]
        return pa.RecordBatch.from_arrays(
            [pa.array(values[often].view(np.int64)), pa.array(counts[often], pa.int64())],
            ["hash", "times"])

    for batch in batches:
        distinct: dict[bytes, np.ndarray] = {}
        held = 0
        for found in shingle_sets(batch["text"]):
            if len(found) and (digest := _digest(found)) not in distinct:
                distinct[digest] = found
                held += len(found)
            if held > COUNTED_TOGETHER:
                yield counted(distinct)
                distinct, held = {}, 0
        if distinct:
            yield counted(distinct)
        del distinct
        release()


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in ascending order, and about how many sets each is in."""
    rows = (docs.select(text_of().alias("text")).mapInArrow(_frequencies, "hash long, times long")
            .groupBy("hash").agg(F.sum("times").alias("times"))
            .orderBy(F.desc("times"), "hash").limit(FREQUENT).collect())
    hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["times"] for r in rows], np.int64)[order]


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """First shingles of a set of n, one of which a similar set has among its own first ones."""
    return n - -(-n * similar // 100) + 1


def _prefixes(frequent: tuple[np.ndarray, np.ndarray]):
    """Per document: size, digest and parities of its set, its first shingles (and one more), and
    into how many parts the list of each is cut."""
    known, times = frequent

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("jaccard",), dict)
        for batch in batches:
            sizes, digests, firsts, parts, bits, marks = [], [], [], [], [], []
            for found in shingle_sets(batch["text"]):
                n = len(found)
                sizes.append(n)
                digests.append(_digest(found) if n else b"")
                bits.append(parities(found))
                marks.append(np.frombuffer(parities(found, MARK_BITS), np.int64))
                if not n:
                    firsts.append([])
                    parts.append([])
                    continue
                often = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = np.where(known[at] == found, times[at], 0)
                first = np.argsort(often, kind="stable")[:prefix_length(n) + 1]
                firsts.append(found[first].view(np.int64))
                cut = often[first] // PART + 1
                parts.append(cut if cut.max() > 1 else [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                 pa.array(firsts, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())),
                 pa.array(bits, pa.binary()), pa.array(marks, pa.list_(pa.int64())),
                 batch["text_digest"]],
                ["doc_id", "n", "digest", "prefix", "parts", "bits", "marks", "text_digest"])
            del sizes, digests, firsts, parts, bits, marks
            release()
    return prefixes


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch["text"]))
        yield pa.RecordBatch.from_arrays(
            [batch["key"], pa.array([_digest(s) for s in sets], pa.binary()), batch["text"]],
            ["key", "digest", "text"])


def _set_blocks(sets: DataFrame) -> int:
    """Blocks of nodes, so that the sets of a block take about ``BLOCK_SHINGLES`` shingles."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    return max(FEWEST_BLOCKS, min(MOST_BLOCKS, -(-total // BLOCK_SHINGLES)))


def possible(pairs: DataFrame, profiles: DataFrame, slack=0.0) -> DataFrame:
    """Pairs (a, b) whose distance may be at most the threshold plus ``slack`` (a column).

    This compares a few bits for each shingle; most pairs that only share a passage end here.
    """
    for end in ("a", "b"):
        pairs = pairs.join(profiles.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"),
                                           F.col("bits").alias(f"bits_{end}")), end)
    least = _least_distance("n_a", "n_b", "bits_a", "bits_b")
    return pairs.withColumn("least", least).filter(
        F.col("least") <= F.lit(REACH) + (slack if isinstance(slack, Column) else F.lit(slack))).drop(
        "n_a", "n_b", "bits_a", "bits_b", "least")


def _cell_shared(pairs: pa.Table, held: pa.Table) -> pa.Table:
    """Shingles that the pairs of a cell share, each distinct pair once; ``held``: side, node, n,
    text of the ends that the cell's pairs name. Sets are made here from the texts, which are
    smaller than the sets and compress."""
    own = [{}, {}]
    found = shingle_sets(held["text"].combine_chunks())
    for side, node, n, one in zip(*(held[c].to_pylist() for c in ("side", "node", "n")), found):
        own[side][node] = (n, one)
    met = pa.table({"a": pairs["a"], "b": pairs["b"]}).group_by(["a", "b"]).aggregate([])
    a, b = met["a"].to_pylist(), met["b"].to_pylist()
    found_a, found_b = [own[0][x] for x in a], [own[1][y] for y in b]
    shared = [len(np.intersect1d(x, y, assume_unique=True)) for (_, x), (_, y) in zip(found_a, found_b)]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                     "n_a": pa.array([m for m, _ in found_a], pa.int32()),
                     "n_b": pa.array([m for m, _ in found_b], pa.int32()),
                     "shared": pa.array(shared, pa.int32())})


def _placed(pairs: DataFrame, sets: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with the blocks of their ends (k_a, k_b), and the sets that go to each cell of two blocks
    (h_a, h_b)."""
    keyed = pairs.select("a", "b", *[F.pmod(F.xxhash64(end), F.lit(blocks)).alias(f"k_{end}") for end in ("a", "b")])
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(end).alias("node")) for side, end in enumerate("ab")])
    held = keyed.select(F.col("k_a").alias("h_a"), F.col("k_b").alias("h_b"), F.explode(ends).alias("end")).select(
        "h_a", "h_b", "end.side", "end.node")
    return keyed, held.distinct().join(sets.select("node", "n", "text"), "node")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact distance and whether they link.

    Nodes fall into blocks, and a task measures the pairs of one block of ``a`` with one of ``b``; a
    set moves once to each block of its partners, not once for each pair, so a set in many pairs
    (the pivot of a large group) is not copied with each of them.
    """
    keyed, held = _placed(pairs, sets, _set_blocks(sets))
    counted = keyed.groupBy("k_a", "k_b").cogroup(held.groupBy("h_a", "h_b")).applyInArrow(
        _cell_shared, "a long, b long, n_a int, n_b int, shared int")
    shared = pairs.join(counted, ["a", "b"])
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return shared.select(*pairs.columns, (F.lit(1.0) - F.col("shared") / union).alias("d"),
                         (100 * F.col("shared").cast("long") >= SIMILAR * union.cast("long")).alias("linked"))


def shingles_of(pairs: list[DataFrame], plain: DataFrame, profiles: DataFrame, have: DataFrame | None) -> DataFrame:
    """Texts of all nodes in some pairs, of which sets are made where pairs are measured; those at
    hand are not looked up again."""
    ends = [p.select(F.col(end).alias("node")) for p in pairs for end in ("a", "b")]
    nodes = ends[0]
    for more in ends[1:]:
        nodes = nodes.union(more)
    nodes = nodes.distinct()
    if have is not None:
        nodes = nodes.join(have.select("node"), "node", "left_anti")
    wanted = staged(nodes.join(profiles.select("node", "key", "n", "digest"), "node"), "wanted")
    keyed = plain.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    made = keyed.join(wanted.select("key").distinct(), "key", "left_semi").mapInArrow(
        _set_rows, "key long, digest binary, text string")
    made = staged(made.join(wanted, ["key", "digest"]).dropDuplicates(["node"])
                  .select("node", "n", "text"), "sets")
    return made if have is None else have.union(made)


def _differ(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; ``labels``: node, component."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return pairs.filter("c_a <> c_b").drop("c_a", "c_b")


def _folded(bits: list[bytes]) -> np.ndarray:
    """Parities as rows of words, all folded to the length of the shortest."""
    rows = [np.frombuffer(b, np.uint64) for b in bits]
    least = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, least), axis=0) for r in rows])


def _runs(rows: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows, which stand by their sizes, in runs of at most ``most`` whose parities are equally long.

    Parities that are folded tell less, so those of a large set must not be folded to the length of a
    small one's only because both are in one tile.
    """
    own, begin = lengths[rows], 0
    while begin < len(rows):
        end = min(begin + most, int(np.searchsorted(own, own[begin], "right")))
        yield rows[begin:end]
        begin = end


def _cell_pairs(cell: pa.Table) -> pa.Table:
    """Unconnected regions of a cell that may hold linked members, by the sizes and parities of their
    pivots and by their radii. Columns: mine (block of the row), low, high (blocks that meet here),
    region, component, n, radius, bits."""
    found_a, found_b, least = [], [], []
    mine, n = np.asarray(cell["mine"]), np.asarray(cell["n"]).astype(np.int64)
    region, component = np.asarray(cell["region"]), np.asarray(cell["component"])
    radius = np.asarray(cell["radius"])
    low, high = cell["low"][0].as_py(), cell["high"][0].as_py()
    bits = cell["bits"].to_pylist()
    lengths = np.fromiter(map(len, bits), np.int64, len(bits))
    left, right = np.nonzero(mine == low)[0], np.nonzero(mine == high)[0]
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    widest = float(radius.max(initial=0))
    for some in _runs(left, lengths, TILE):
        # Sets whose sizes differ by more can't be near enough; the rest lie together.
        share = 1 - min(1.0, REACH + float(radius[some].max()) + widest)
        fewest, most = n[some[0]] * share, n[some[-1]] / share if share > 0 else np.inf
        near = right[np.searchsorted(n[right], fewest - 1e-6):np.searchsorted(n[right], most + 1e-6, "right")]
        for others in _runs(near, lengths, 8 * TILE):
            words = _folded([bits[i] for i in [*some, *others]])
            differ = np.bitwise_count(words[:len(some), None] ^ words[None, len(some):]).sum(axis=2, dtype=np.int64)
            sizes = n[some][:, None] + n[others]
            apart = np.maximum(np.abs(n[some][:, None] - n[others]), differ)
            may = ((2.0 * apart <= (REACH + radius[some][:, None] + radius[others]) * (sizes + apart))
                   & (component[some][:, None] != component[others]))
            if low == high:
                may &= region[some][:, None] < region[others]
            x, y = np.nonzero(may)
            found_a.append(region[some[x]])
            found_b.append(region[others[y]])
            least.append((2.0 * apart / (sizes + apart))[x, y])
    a, b = (np.concatenate(found) if found else np.zeros(0, np.int64) for found in (found_a, found_b))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)),
                     "least": pa.array(np.concatenate(least) if least else np.zeros(0))})


def _with_partner(regions: DataFrame) -> DataFrame:
    """Regions of a cell that another one of it is near enough to by size, so that no parities move
    for the rest. Of compatible sizes those next to each other in order are compatible too, so every
    region is held against its neighbours. Lists of several blocks stay whole."""
    alone = F.when(F.col("blocks") > 1, F.col("region"))
    cell = Window.partitionBy("cell", "merged", alone)
    by_size = cell.orderBy("n")
    share = F.greatest(F.lit(0.0), 1 - F.lit(REACH) - 2 * F.max("radius").over(cell))
    near = regions.select("*", F.lag("n").over(by_size).alias("before"), F.lead("n").over(by_size).alias("after"),
                          share.alias("share"))
    return near.filter((F.col("blocks") > 1) | (F.col("n") * F.col("share") <= F.col("before") + 1e-6)
                       | (F.col("after") * F.col("share") <= F.col("n") + 1e-6)).drop("before", "after", "share")


def _meeting_pairs(lists: DataFrame, profiles: DataFrame, radii: DataFrame) -> DataFrame:
    """Pairs of unconnected regions that meet in a list and may hold linked members, with their radii (the
    region with fewer members first) and a distance that their pivots have at least; ``lists``: hash, region, component.

    Of lists with the same regions one is enough. Lists that are much alike, as those of the shingles
    of one passage, mostly have the same region first in a random order; while they are small together
    they are one cell that one task compares. Any other list is a cell of its own, and of one with many
    regions every two of its blocks are a cell.
    """
    lists = staged(lists, "cells")
    signature = [F.count(F.lit(1)).alias("regions"), F.min(F.xxhash64("region", F.lit(2))).alias("key"), *[
        F.sum(F.xxhash64("region", F.lit(i)).cast("decimal(20,0)")).alias(f"sum{i}") for i in range(2)]]
    first = lists.groupBy("hash").agg(*signature).groupBy("key", "regions", "sum0", "sum1").agg(
        F.min("hash").alias("hash"))
    merged = F.col("together") <= CELL
    first = first.join(first.groupBy("key").agg(F.sum("regions").alias("together")), "key").select(
        "hash", F.when(merged, F.col("key")).otherwise(F.col("hash")).alias("cell"), merged.alias("merged"),
        F.when(merged, 1).otherwise(F.ceil(F.col("regions") / CELL)).cast("long").alias("blocks"))
    met = lists.join(first, "hash").select("cell", "merged", "blocks", "region", "component").distinct()
    own = profiles.select(F.col("node").alias("region"), "n").join(radii.select("region", "radius"), "region")
    blocks = _with_partner(met.join(own, "region")).withColumn(
        "mine", F.pmod(F.xxhash64("region"), F.col("blocks"))).join(
        profiles.select(F.col("node").alias("region"), "bits"), "region")
    placed = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = placed.select("cell", "merged", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
                          "mine", "region", "component", "n", "radius", "bits")
    pairs = cells.groupBy("cell", "merged", "low", "high").applyInArrow(_cell_pairs, "a long, b long, least double").groupBy(
        "a", "b").agg(F.max("least").alias("least"))
    for end in ("a", "b"):
        pairs = pairs.join(radii.select(F.col("region").alias(end), F.col("radius").alias(f"r_{end}"),
                                        F.col("members").alias(f"m_{end}")), end)
    # ``a`` is the region with fewer members, which are those that windows copy first.
    swapped = F.col("m_a") > F.col("m_b")
    return pairs.select(*[F.when(swapped, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}")).alias(f"{c}{x}")
                          for c in ("", "r_") for x, y in ("ab", "ba")], "least")


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return _grouped(docs, F.lit(None).cast("binary")).drop("text_digest")


def _grouped(docs: DataFrame, text_digest: Column) -> DataFrame:
    """What ``groups`` returns, with a value of the text of each row as ``text_digest``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = staged(plain.withColumn("text_digest", text_digest).mapInArrow(_prefixes(frequent_shingles(plain)), SETS_SCHEMA)
                  .withColumn("row_no", F.monotonically_increasing_id()), "shingled")
    # A node is a distinct set; it has the number of one of its rows.
    nodes = staged(rows.filter("n > 0").groupBy("digest").agg(
        F.min("row_no").alias("node"), F.min("doc_id").alias("doc")), "nodes")
    # Rows are far wider than their numbers: those that only repeat a set are told to all tasks.
    own_rows = rows.filter("n > 0")
    repeats = own_rows.select("row_no").join(nodes.select(F.col("node").alias("row_no")), "row_no", "left_anti")
    own_rows = join_small(own_rows, repeats, ["row_no"], "left_anti", max_rows=MANY_REPEATS)
    profiles = staged(own_rows.select(F.col("row_no").alias("node"), "n", "digest", "bits", "marks",
                                      F.coalesce("doc_id", F.lit(NO_ID)).alias("key")), "profiles")
    firsts = own_rows.select(F.col("row_no").alias("node"), "n",
                             F.arrays_zip("prefix", "parts").alias("first"))
    length = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100).cast("int") + 1
    entries = firsts.select("node", F.explode(F.slice("first", F.lit(1), length)).alias("e")).select(
        "node", F.col("e.prefix").alias("hash"), F.coalesce("e.parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    own_list = Window.partitionBy("hash", "part")
    lists = staged(entries.withColumn("part", part).select(
        "hash", "part", "parts", "node", F.count(F.lit(1)).over(own_list).alias("members"))
        .filter("members > 1 OR parts > 1").drop("members"), "list-entries")
    # The pivot of a list is the set that meets others with the largest share of its first
    # shingles: an original more likely than an altered copy, whose changes are its own.
    met = lists.groupBy("node").agg(F.count(F.lit(1)).alias("met")).join(
        profiles.select("node", "n"), "node").select(
        "node", "n", F.col("met").cast("int").alias("met"))
    central = F.max(F.struct((F.col("met") / length).alias("share"), (-F.col("node")).alias("low"), "n")).over(own_list)
    # Dealt out here, so that what the window compares is made behind the shuffle.
    lists = staged(lists.join(met, "node").repartition("hash", "part").select(
        "hash", "part", "parts", "node", "n", (-central["low"]).alias("pivot"), central["n"].alias("pivot_n")), "lists")

    # Round 1: stars around the pivots, and around the first of the pivots of a list in parts.
    cut_lists = lists.filter("parts > 1").select("hash", F.struct(F.col("pivot").alias("node"), F.col("pivot_n").alias("n"))
                                                 .alias("pivot")).distinct()
    heads = cut_lists.groupBy("hash").agg(F.min("pivot").alias("head"))
    stars = lists.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pivot").alias("b"),
                         F.col("pivot_n").alias("n_b")).union(
        cut_lists.join(heads, "hash").select("pivot.node", "pivot.n", "head.node", "head.n")).filter("a <> b")
    # Sizes rule out most of them before parities move.
    apart = F.abs(F.col("n_a") - F.col("n_b"))
    stars = stars.filter(2 * apart <= F.lit(REACH) * (F.col("n_a") + F.col("n_b") + apart)).select("a", "b").distinct()
    stars = staged(possible(stars, profiles), "stars")
    sets = shingles_of([stars], plain, profiles, None)
    close = staged(measured(stars, sets).filter("linked"), "star-links")
    links = close.select("a", "b")
    nearest = close.groupBy("a").agg(F.min(F.struct("d", F.col("b"))).alias("best"))
    first = components(links)
    regions = staged(
        lists.select("node").distinct().join(nearest, F.col("node") == F.col("a"), "left")
        .join(first, "node", "left")
        .select("node", F.coalesce("best.b", "node").alias("region"),
                F.coalesce("best.d", F.lit(0.0)).alias("d"),
                F.coalesce("component", "node").alias("component")), "regions")

    # Round 2: lists in which more than one component is left.
    placed = lists.select("hash", "node").join(regions.select("node", "region", "component"), "node")
    meeting = staged(placed.select("hash", "region", "component").distinct(), "meeting")
    sizes = staged(meeting.groupBy("hash").agg(
        F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("regions"))
        .filter("components > 1"), "open-lists")
    radii = staged(regions.groupBy("region").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("members")), "radii")
    few, many = sizes.filter(F.col("regions") <= MANY_REGIONS), sizes.filter(F.col("regions") > MANY_REGIONS)
    cells = meeting.join(few.select("hash"), "hash", "left_semi")
    if not many.isEmpty():
        cut = placed.join(many.select("hash"), "hash", "left_semi").join(
            firsts.select("node", F.explode("first.prefix").alias("second")), "node").filter("hash <> second")
        cut = cut.select(F.xxhash64(F.least("hash", "second"), F.greatest("hash", "second")).alias("hash"),
                         "region", "component").distinct()
        cells = cells.union(cut)
    # No member of one region can link with one of the other beyond the sum of the radii.
    pairs = staged(_meeting_pairs(cells, profiles, radii), "region-pairs")
    # Sets move only where the pivots themselves may link. For windows a distance that the pivots have
    # at least will do, as it only makes them wider.
    close = pairs.filter(F.col("least") <= REACH)
    sets = shingles_of([close], plain, profiles, sets)
    pivots = staged(measured(close, sets), "pivot-distances")
    links = links.union(pivots.filter("linked").select("a", "b"))
    second = staged(components(links), "second")

    # Windows: members of two regions that the triangle inequality allows to link.
    apart = pivots.filter("NOT linked").select("a", "b", "d", "r_a", "r_b").union(
        pairs.filter(F.col("least") > REACH).select("a", "b", F.col("least").alias("d"), "r_a", "r_b"))
    apart = _differ(second, apart)
    apart = apart.filter((F.col("r_a") + F.col("r_b") > 0)
                         & (F.col("d") - F.col("r_a") - F.col("r_b") <= REACH))

    members = regions.join(profiles.select("node", "n", "marks"), "node")

    def member(end: str) -> DataFrame:
        return members.select(*[F.col(c).alias(f"{c}_{end}") for c in ("region", "node", "d", "n", "marks")])

    # The condition is part of the join, so members that sizes and parities keep apart never meet.
    differ = sum((F.bit_count(F.col("marks_a")[i].bitwiseXOR(F.col("marks_b")[i]))
                  for i in range(MARK_BITS // 64)), F.lit(0))
    near = (100 + SIMILAR) * differ <= (100 - SIMILAR) * (F.col("n_a") + F.col("n_b"))
    sided = apart.join(member("a"), F.col("a") == F.col("region_a")).filter(
        F.col("d") - F.col("d_a") - F.col("r_b") <= REACH)
    windows = sided.join(member("b"), (F.col("b") == F.col("region_b")) & near & (
        F.col("d") - F.col("d_a") - F.col("d_b") <= REACH)).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    windows = staged(possible(windows, profiles), "windows")
    last = measured(windows, shingles_of([windows], plain, profiles, sets)).filter("linked")
    final = components(links.union(staged(last.select("a", "b"), "window-links")))

    labels = nodes.join(final, "node", "left").select(
        "digest", "doc", F.coalesce("component", "node").alias("component"))
    named = labels.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = labels.join(named, "component").select("digest", "component_id")
    return rows.select("doc_id", "n", "digest", "text_digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows with a null doc_id stay when no document of their group has one; repeated rows are one
    document and stay or go together. Only documents that go are joined to the texts, which move
    where these are too many to be told to all tasks.
    """
    digest = F.unhex(F.sha2(text_of(), 256))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # The id alone does not tell rows with a null doc_id apart.
    gone = _grouped(docs, digest).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        key.alias("__id"), F.col("text_digest").alias("__digest")).distinct()
    return join_small(docs.withColumns({"__id": key, "__digest": digest}), gone, ["__id", "__digest"],
                      "left_anti").select(*docs.columns)
