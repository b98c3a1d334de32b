"""What leaves the cells in which regions are compared, and what moves to them."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logfathom.llm import jaccard


def hashes(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))


def cell_of(sets, radius=None):
    n = len(sets)
    return pa.table({"mine": pa.array([0] * n, pa.int64()), "low": pa.array([0] * n, pa.int64()),
                     "high": pa.array([0] * n, pa.int64()), "region": pa.array(range(n), pa.int64()),
                     "component": pa.array(range(n), pa.int64()), "n": pa.array(map(len, sets), pa.int32()),
                     "radius": pa.array(radius or [0.0] * n, pa.float64()),
                     "bits": pa.array([jaccard.parities(s) for s in sets], pa.binary())})


def test_a_small_set_does_not_blind_the_cell():
    """Large sets with nothing in common were a pair wherever a tile also held a small set."""
    rng = np.random.default_rng(3)
    near = hashes(rng, 700)
    sets = [hashes(rng, n) for n in (5, 6, 600, 610, 2_500, 2_600, 2_700)] + [near, near[20:]]
    got = jaccard._cell_pairs(cell_of(sets))
    assert {(2, 3), (4, 5), (4, 6), (5, 6)}.isdisjoint(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    least = dict(zip(zip(got["a"].to_pylist(), got["b"].to_pylist()), got["least"].to_pylist()))
    assert 0 < least[7, 8] <= 20 / 700 + 1e-9


def test_no_pair_in_reach_is_lost():
    rng = np.random.default_rng(4)
    sets, radius = [], []
    for base in (30, 60, 64, 127, 128, 129, 500, 513, 4_000):
        own = hashes(rng, base)
        for kept in (1.0, 0.97, 0.9, 0.81, 0.7):
            sets.append(np.unique(np.concatenate([own[:int(kept * len(own))], hashes(rng, int((1 - kept) * base / 3))])))
            radius.append(float(rng.choice([0.0, 0.0, 0.1, 0.2])))
    got = jaccard._cell_pairs(cell_of(sets, radius))
    pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    for (a, b), least in zip(zip(got["a"].to_pylist(), got["b"].to_pylist()), got["least"].to_pylist()):
        assert a < b and least <= 1 - len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) + 1e-9
    for b in range(len(sets)):
        for a in range(b):
            d = 1 - len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
            if d <= jaccard.REACH + radius[a] + radius[b]:
                assert (a, b) in pairs


def test_regions_with_a_partner_by_size_stay(spark):
    rng = random.Random(8)
    rows = [(cell, False, 1, cell * 100 + i, rng.randint(5, 400), rng.choice([0.0, 0.0, 0.0, 0.15]))
            for cell in range(40) for i in range(rng.randint(1, 9))]
    rows += [(50, True, 2, 5_000 + i, 10 ** i, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "cell long, merged boolean, blocks long, region long, n int, radius double")
    stay = {r.region for r in jaccard._with_partner(df).collect()}
    for cell, _, blocks, region, n, radius in rows:
        partner = any(min(n, m) >= (1 - jaccard.REACH - radius - r) * max(n, m)
                      for c, _, _, other, m, r in rows if c == cell and other != region)
        assert region in stay or not (partner or blocks > 1)
    assert len(stay) < len(rows)


def test_windows_copy_the_members_of_the_smaller_region(spark):
    rng = np.random.default_rng(5)
    own = hashes(rng, 300)
    sets = {1: own, 2: own[25:], 3: own[:-30], 4: own[12:]}
    members = {1: 900, 2: 1, 3: 1, 4: 30}
    lists = spark.createDataFrame([(7, i, i) for i in sets], "hash long, region long, component long")
    profiles = spark.createDataFrame([(i, len(s), bytearray(jaccard.parities(s))) for i, s in sets.items()],
                                     "node long, n int, bits binary")
    radii = spark.createDataFrame([(i, 0.19 if m > 1 else 0.0, m) for i, m in members.items()],
                                  "region long, radius double, members long")
    pairs = jaccard._meeting_pairs(lists, profiles, radii).collect()
    assert {frozenset((r.a, r.b)) for r in pairs} == {frozenset(p) for p in ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))}
    for r in pairs:
        assert members[r.a] <= members[r.b]
        assert (r.r_a, r.r_b) == tuple(0.19 if members[x] > 1 else 0.0 for x in (r.a, r.b))


@pytest.mark.parametrize("cell", [1, 3, 2_048])
def test_groups_by_cells_of_any_size(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(14)]
    rows = []
    for _ in range(12):
        own = passage + [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([12, 40, 45, 90]))]
        for _ in range(rng.choice([1, 3, 6])):
            rows.append((len(rows), " ".join(own)))
            at = rng.randrange(len(own) - 3)
            own = own[:at] + [f"new{rng.randint(0, 9999)}"] * rng.choice([0, 1, 2]) + own[at + 1:]
    rows += [rows[3], (None, rows[3][1]), (900, None), (901, ""), (None, "alone here"), (902, rows[0][1] + " more")]
    rng.shuffle(rows)
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = Counter()
    for (doc, _), own, g in zip(rows, sets, group):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None]
        want[doc, len(own), min(ids, default=None) if own else doc] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, jaccard.groups(df).collect())) == want
