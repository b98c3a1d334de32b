"""Exact distances of pairs, where one set is in many pairs."""

import random

import numpy as np

from logfathom.llm import jaccard


def test_a_set_in_many_pairs_moves_once_a_block(spark):
    rng = random.Random(5)
    pivot = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    texts = [" ".join(pivot)]
    for _ in range(300):
        own = list(pivot)
        for _ in range(rng.choice([0, 1, 3, 12])):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 99999)}"
        texts.append(" ".join(own))
    found = [np.array(sorted(set(s.tolist())), np.uint64)
             for s in jaccard.shingle_sets(__import__("pyarrow").array(texts))]
    sets = spark.createDataFrame([(i, len(s), t) for i, (s, t) in enumerate(zip(found, texts))],
                                 "node long, n int, text string")
    pairs = spark.createDataFrame([(i, 0, float(i)) for i in range(1, len(texts))] + [(1, 0, 1.0)],
                                  "a long, b long, extra double")

    blocks = 4
    _, held = jaccard._placed(pairs, sets, blocks)
    assert held.filter("side = 1 AND node = 0").count() <= blocks

    got = sorted(tuple(r) for r in jaccard.measured(pairs, sets).collect())
    want = []
    for a, b, extra in [(i, 0, float(i)) for i in range(1, len(texts))] + [(1, 0, 1.0)]:
        x, y = set(found[a].tolist()), set(found[b].tolist())
        shared, union = len(x & y), len(x | y)
        want.append((a, b, extra, 1.0 - shared / union, 100 * shared >= 80 * union))
    assert len(got) == len(want)
    for (a, b, e, d, linked), (a2, b2, e2, d2, linked2) in zip(got, sorted(want)):
        assert (a, b, e, linked) == (a2, b2, e2, linked2) and abs(d - d2) < 1e-12
