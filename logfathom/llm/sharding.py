"""Sharding by a hierarchical weighted hash tree, in column expressions alone.

A document descends region, rack and shard. At each level every child draws an exponential
number from the hash of (doc_id, child), divided by the weight of its subtree, and the smallest
draw wins. So a child is chosen in proportion to its weight, and when the weight of a subtree
changes, documents move only into it (more weight) or out of it (less weight).

Cases: a null text has no bytes (size 8, crc of nothing); a null doc_id is a key like any other;
repeated rows go to the same shard and get slots of their own; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logfathom.plans.scale import compute_once

from .common import prefix_sums, shares, staged, text_of

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Rows whose slots one task numbers, about.
SLOT_ROWS = 20_000


def even_tree(shards: int = 24, racks: int = 2, per_rack: int = 4) -> dict:
    """Regions of ``racks`` racks with ``per_rack`` shards of weight 1 each."""
    tree: dict = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def with_region(tree: Tree, name: str, shard: int, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a region of its own.

    In an existing region the new weight would also draw rows to its old shards.
    """
    return {**tree, name: {f"{name}-rack": {shard: weight}}}


def _children(tree: Tree) -> tuple[dict, dict, dict]:
    """Children with their weights of the root, of each region and of each rack, by name."""
    racks = {r: {f"{r}/{k}": sum(shards.values()) for k, shards in inner.items()}
             for r, inner in tree.items()}
    shards = {f"{r}/{k}": {f"{r}/{k}/{shard}": weight for shard, weight in own.items()}
              for r, inner in tree.items() for k, own in inner.items()}
    return {"": {r: sum(own.values()) for r, own in racks.items()}}, racks, shards


def _descend(key: Column, node: Column, children: dict[str, dict[str, float]]) -> Column:
    """The child of a node whose draw is the smallest; children without weight get nothing."""
    options = F.create_map(*[part for name, own in children.items() for part in (
        F.lit(name), F.array(*[F.struct(F.lit(child).alias("name"), F.lit(float(weight)).alias("weight"))
                               for child, weight in own.items() if weight > 0]))])

    def draw(child: Column) -> Column:
        # 53 bits of the hash as a number in (0, 1); -ln of it is an exponential draw.
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double")
        uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(options[node], draw))["name"]


def place(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """Add the shard of each key as a column."""
    root, racks, shards = _children(tree)
    node = F.lit("")
    for level in (root, racks, shards):
        df = compute_once(df, **{name: _descend(key, node, level)})
        node = F.col(name)
    return compute_once(df, **{name: F.element_at(F.split(node, "/"), -1).cast("int")})


def assign(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number the rows of a shard from 0 without gaps. A shard is cut into buckets by hash,
    whose counts tell where the slots of each bucket begin, so no task numbers a whole shard.
    """
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"))
    key = F.col("doc_id").cast("long")
    rows = staged(place(place(rows, key, tree, "shard"), key, grown, "grown_shard"), "sharded")
    count = sum(len(shards) for racks in tree.values() for shards in racks.values())
    buckets = shares(rows.count(), SLOT_ROWS * count)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"),
                                            F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    begins = prefix_sums(counts, ["shard"], "bucket", {"begin": F.col("rows")}).drop("rows")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (rows.withColumn("at", F.row_number().over(within) - 1)
            .join(begins, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("begin") + F.col("at")).cast("long").alias("slot"), "grown_shard"))
