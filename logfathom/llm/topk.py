"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are cut into blocks. In a block, the postings of a component are the vectors that have
it in one quantised level: a segment. A query visits segments by descending quantised impact,
adding to the scores of their vectors. A vector's score is at most what it has gathered, plus
the impact now reached for each component not yet met, plus what quantising hides. Visiting
ends only when all vectors but a few are proved to be below the k-th exact score known; these
few are scored exactly. Blocks meet in a grid of (query block, vector block), and the winners
of the blocks are merged per query.

Cases: vectors that are null or hold null or non-finite components take no part; a query meets
vectors of its own length only; equal scores go to the smaller vec_id; repeated vec_ids are
candidates of their own, save that a query never meets its own vec_id; an empty table gives an
empty result. Rows with a null vec_id are left out, as they can't be named in a result. Scores
beyond 64 bits end at the largest or smallest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import shares, staged

#: Vectors in a block, and queries in a block, about.
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 1_024
#: Width of a quantised level.
LEVEL = 4
#: Vectors that are scored exactly once the others are ruled out.
RESCORED = 128
#: Segments are visited in so many steps, with a look at the bounds after each.
STEPS = 16

RESULT = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) of each component, for the vectors that take part."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    sound = ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(double, lambda x: F.floor(x * F.lit(256.0)).cast("long"))
                    .alias("vector")))


class ImpactIndex:
    """Postings of one block of vectors, by component and level."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        n, dims = matrix.shape
        levels = matrix // LEVEL
        self.order, starts, dim_of, level_of = [], [], [], []
        for d in range(dims):
            order = np.argsort(levels[:, d], kind="stable")
            values, first = np.unique(levels[order, d], return_index=True)
            self.order.append(order)
            starts.extend(first + d * n)
            dim_of.extend([d] * len(values))
            level_of.extend(values)
        self.postings = np.concatenate(self.order) if dims else np.zeros(0, np.int64)
        self.starts = np.asarray(starts, np.int64)
        self.ends = np.append(self.starts[1:], len(self.postings))
        self.dim, self.low = np.asarray(dim_of, np.int64), np.asarray(level_of, np.int64) * LEVEL

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (vec_id, score) of the block, without the query's own vec_id."""
        n, dims = self.matrix.shape
        # The least that a posting of the segment adds; at most ``hidden`` is missing in total.
        impact = np.where(query[self.dim] >= 0, query[self.dim] * self.low,
                          query[self.dim] * (self.low + LEVEL - 1))
        hidden = int(np.abs(query).sum()) * (LEVEL - 1)
        visit = np.argsort(-impact, kind="stable")
        gathered, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
        possible, floor = np.arange(n), None
        step = max(1, -(-len(visit) // STEPS))
        for begin in range(0, len(visit), step):
            segments = visit[begin:begin + step]
            own = np.concatenate([self.postings[s:e] for s, e in zip(
                self.starts[segments].tolist(), self.ends[segments].tolist())])
            added = np.repeat(impact[segments], self.ends[segments] - self.starts[segments])
            gathered += np.bincount(own, added, n).astype(np.int64)
            met += np.bincount(own, minlength=n)
            if begin + step >= len(visit):
                break
            reach = int(impact[visit[begin + step]])
            most = gathered + (dims - met) * reach + hidden
            ahead = np.argpartition(-most, min(n - 1, 4 * k))[:4 * k + 1]
            exact = self._scores(ahead, query)[self.ids[ahead] != query_id]
            if len(exact) >= k:
                found = int(np.partition(exact, len(exact) - k)[len(exact) - k])
                floor = found if floor is None else max(floor, found)
                possible = np.nonzero(most >= floor)[0]
                if len(possible) <= RESCORED:
                    break
        else:
            possible = np.arange(n)
        possible = possible[self.ids[possible] != query_id]
        scores = self._scores(possible, query)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible[best]], scores[best]

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.matrix[rows] @ query


#: Up to this size of component, sums over thousands of components are exact in a double.
SAFE = 1 << 18


def _plain_top(ids, vectors, query_id, query, k):
    """For components so large that sums could pass 64 bits: whole numbers of any size."""
    cut = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    scored = sorted((-cut(sum(int(a) * int(b) for a, b in zip(v, query))), int(i))
                    for i, v in zip(ids, vectors) if i != query_id)[:k]
    return [i for _, i in scored], [-s for s, _ in scored]


def _search(k: int):
    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(vectors):
            ids = vectors["vec_id"].to_numpy(np.int64)
            matrix = np.array(vectors["vector"].tolist(), np.int64).reshape(len(ids), -1)
            asked = np.array(queries["vector"].tolist(), np.int64).reshape(len(queries), -1)
            small = max(np.abs(matrix).max(initial=0), np.abs(asked).max(initial=0)) <= SAFE
            index = ImpactIndex(ids, matrix) if small else None
            for query_id, query in zip(queries["vec_id"].tolist(), asked):
                found, scores = (index.top(query_id, query, k) if index else
                                 _plain_top(ids, matrix, query_id, query, k))
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": scores}))
        return (pd.concat(out, ignore_index=True) if out else
                pd.DataFrame({"query_id": [], "vec_id": [], "score": []})).astype("int64")
    return search


def top_k(vectors: DataFrame, is_query, k: int = 5, block_vectors: int = BLOCK_VECTORS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best vectors for each query row.

    ``is_query`` is a condition on ``vec_id``. Both sides are dealt into blocks of bounded size
    by a hash; every pair of blocks is one group, and a group returns k rows per query.
    """
    rows = staged(whole_numbers(vectors).withColumn("dims", F.size("vector")), "vectors")
    count = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("asked")).first()
    vector_blocks, query_blocks = (shares(count["all"], block_vectors),
                                   shares(count["asked"], block_queries))

    def dealt(df, blocks, name):
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))

    def copied(df, blocks, name):
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    asked = rows.filter(is_query).dropDuplicates(["vec_id", "vector"])
    queries = copied(dealt(asked, query_blocks, "query_block"),
                     vector_blocks, "vector_block")
    vectors_ = copied(dealt(rows, vector_blocks, "vector_block"), query_blocks, "query_block")
    keys = ["dims", "query_block", "vector_block"]
    found = (queries.groupBy(*keys).cogroup(vectors_.groupBy(*keys))
             .applyInPandas(_search(k), RESULT))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
