"""Whitening, line dedup and alignment against brute force, with every odd case in the fixture."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logfathom.llm import alignment, line_dedup, whitening
from test_llm_operators import with_clashes

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# Whitening

def vectors(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def mixed_rows(seed=5, n=300, d=9):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(0.1, 3, d)
    rows = [(i, (rng.normal(size=d) @ mix).tolist()) for i in range(n)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, []), (902, [None] * d),
             (903, [float("nan")] + [0.0] * (d - 1)), (904, [float("inf")] * d), (905, [1.0] * (d + 1))]
    return rows


def test_whitening_equals_brute_force(spark):
    rows = mixed_rows()
    got = whitening.whiten(vectors(spark, rows).repartition(4), count=5).collect()
    fit = [(i, v) for i, v in rows[:302]]
    x = np.floor(64 * np.float32([v for _, v in fit]).astype(float)).astype(int) + 1_000_000
    n, d = x.shape
    sums = x.sum(axis=0)
    apart = n * x - sums
    value, vector = np.linalg.eigh((apart / n).T @ (apart / n) / n)
    value, vector = value[::-1], vector[:, ::-1]
    assert Counter(r.vec_id for r in got) == {i: 5 * c for i, c in Counter(i for i, _ in fit).items()}
    by = defaultdict(list)
    for (i, _), row, want in zip(fit, apart, (apart / n) @ vector[:, :5] / np.sqrt(value[:5])):
        by[i].append((int((row * row).sum()), want))
    sign = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-12
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-9)
        want = [w[r.component - 1] for deviation, w in by[r.vec_id] if deviation == r.deviation]
        assert want
        flip = sign.setdefault(r.component, 1 if want[0] * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(flip * want[0], abs=1e-8)
    # The error told is the one that the whitened values have.
    white = np.array([[r.whitened for r in got if r.component == j] for j in range(1, 6)])
    assert np.abs(white @ white.T / n - np.eye(5)).max() < 1e-9


def test_whitening_of_equal_and_missing_eigenvalues(spark):
    corners = [(0, 1, 0, 0), (0, -1, 0, 0), (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 2), (0, 0, 0, -2)]
    got = whitening.whiten(vectors(spark, [(i, list(map(float, c))) for i, c in enumerate(corners)])).collect()
    explained = {r.component: r.explained for r in got}
    assert list(map(round, [600 * explained[j] for j in (1, 2, 3, 4)])) == [400, 100, 100, 0]
    assert all((r.whitened is None) == (r.component == 4) for r in got)
    white = np.array([[r.whitened for r in got if r.component == j] for j in (1, 2, 3)])
    assert np.allclose(white @ white.T / 6, np.eye(3))
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in same)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_characteristic_polynomial_is_exact(spark):
    rng = random.Random(2)
    for d in (1, 2, 5, 8):
        root = [[rng.randint(-900, 900) for _ in range(d)] for _ in range(d)]
        m = [[sum(root[k][i] * root[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        polynomial = whitening.characteristic(spark, m)
        for at in (-3, 0, 17, 10 ** 7):
            a = [[Fraction(at * (i == j) - m[i][j]) for j in range(d)] for i in range(d)]
            determinant = Fraction(1)
            for k in range(d):
                pivot = next((i for i in range(k, d) if a[i][k]), None)
                if pivot is None:
                    determinant = 0
                    break
                if pivot != k:
                    a[k], a[pivot], determinant = a[pivot], a[k], -determinant
                determinant *= a[k][k]
                for i in range(k + 1, d):
                    f = a[i][k] / a[k][k]
                    a[i] = [x - f * y for x, y in zip(a[i], a[k])]
            assert sum(c * at ** (d - i) for i, c in enumerate(polynomial)) == determinant


def test_roots_are_counted_and_isolated():
    polynomial = [1]
    for r in (2, 2, 5, 9, 9, 9, 10 ** 12, 10 ** 12 + 1):
        polynomial = [a - r * b for a, b in zip([*polynomial, 0], [0, *polynomial])]
    assert [whitening.roots_above(polynomial, t) for t in (0, 1, 2, 4, 5, 8, 9, 10 ** 12)] == [8, 8, 6, 6, 5, 5, 2, 1]
    for k, (root, first, times) in enumerate([(10 ** 12 + 1, 1, 1), (10 ** 12, 2, 1), (9, 3, 3), (9, 3, 3),
                                              (9, 3, 3), (5, 6, 1), (2, 7, 2), (2, 7, 2)], 1):
        fraction, places, *rest = whitening.isolate(polynomial, k)
        assert rest == [first, times] and abs(Fraction(fraction, 1 << places) - root) < Fraction(1, 10 ** 9)


@pytest.mark.parametrize("scale", [1, 10 ** 6, 10 ** 12])
def test_sums_of_products_are_exact(scale):
    x = np.random.default_rng(0).integers(-scale, scale, (50, 4))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(4)] for i in range(4)]
    assert whitening.products(x).tolist() == want


# Line dedup

def line_rows(seed=1):
    rng = random.Random(seed)
    shared = [f"shared line number {i} " + "x" * rng.randint(10, 60) for i in range(12)]
    rows = []
    for i in range(60):
        lines = [rng.choice(shared) if rng.random() < .5 else f"own {rng.random()}" * rng.randint(1, 4)
                 for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(f"\t {s.upper()}\r" if rng.random() < .3 else s for s in lines)))
    hot = "a line that nearly every document holds, in full"
    rows = [(i, f"{t}\n{hot}\n{hot}" if i % 3 else t) for i, t in rows]
    four = "found in four documents only, so that it has to stay"
    rows += [(100 + i, f"{four}\n\n{four}") for i in range(4)] + [(200 + i, "É" * 39) for i in range(6)]
    rows += [(300 + i, "É" * 40 + " ") for i in range(5)] + [(400, None), (401, ""), (402, "\n\n"), rows[4], rows[4]]
    rows += [(None, hot), (None, hot), (None, "a\n" + hot), (500, hot + "\n" + "z" * 300_000)]
    rows += [(600, "twice the same id\n" + hot), (600, hot)]
    return rows


def deduped(rows, least_length=40, least_documents=5):
    strip = " \t\n\v\f\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    order = lambda i: -1 if i is None else i
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                held[key(line)].add(order(i))
    stays = {k: max(docs) for k, docs in held.items() if len(docs) >= least_documents}
    for i, text in rows:
        lines = (text or "").split("\n")
        yield i, lines, [s for s in lines if stays.get(key(s), order(i)) == order(i)]


@pytest.mark.parametrize("parts, most_rows", [(1, 1000), (7, 0)])
def test_line_dedup(spark, parts, most_rows):
    rows = line_rows()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(parts)
    want = Counter((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
                   for i, lines, kept in deduped(rows))
    assert Counter(map(tuple, line_dedup.digests(docs, most_rows).collect())) == want
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter(
        (i, "\n".join(kept)) for i, _, kept in deduped(rows))
    assert line_dedup.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_walks_of_ranges_cut_anywhere(seed):
    """A hash may fill several ranges; every cut gives the lines that brute force drops."""
    import pyarrow as pa
    rng = random.Random(seed)
    lines = [(h, 0, -d, r, p) for h in range(rng.randint(1, 12)) for d in range(rng.choice([1, 3, 4, 5, 9, 40]))
             for r in range(rng.choice([1, 1, 2])) for p in range(rng.choice([1, 1, 3]))]
    lines = sorted((h, z, -d, r, p) for h, z, d, r, p in lines)
    cuts = sorted(rng.sample(range(len(lines) + 1), min(len(lines), rng.randint(0, 6))))
    found, opened, heads = [], [], defaultdict(set)
    for a, b in zip([0, *cuts], [*cuts, len(lines)]):
        own, batches = [(h, z, -d, r, p) for h, z, d, r, p in lines[a:b]], []
        while own:
            k = rng.randint(1, 30)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*own[:k])],
                                                      ["high", "low", "doc", "row_hash", "position"]))
            own = own[k:]
        for out in line_dedup._walker(5)(iter(batches)):
            for h, z, d, r, p, kind in zip(*[c.to_pylist() for c in out.columns]):
                if kind == line_dedup.HEAD:
                    heads[h].add(d)
                else:
                    (found if kind == line_dedup.DROP else opened).append((h, z, d, r, p))
    found += [x for x in opened if len(heads[x[0]]) >= 5 and x[2] != max(heads[x[0]])]
    documents = defaultdict(set)
    for h, _, d, *_ in lines:
        documents[h].add(-d)
    assert sorted(found) == sorted((h, z, -d, r, p) for h, z, d, r, p in lines
                                   if len(documents[h]) >= 5 and -d != max(documents[h]))


def test_bitmaps_keep_what_lies_beyond_their_end():
    import pandas as pd
    import zlib
    [keep] = line_dedup._bitmap.func(pd.Series([np.array([0, 9])]))
    assert len(zlib.decompress(keep)) == 2
    assert line_dedup.kept_lines("\n".join(map(str, range(40))), keep) == [str(i) for i in range(40) if i not in (0, 9)]


# Alignment

ODD_TEXTS = [None, "", " ", "a", "<|endoftext|> and <s> </s> <unk>", "two  spaces\n\nand lines\t\x00", "Grüße, 你好 🙂 😀é",
             "▁ is a character of its own", "word " * 40_000, "x" * 20_000, "á" + "á", "   end "]


def token_spans(tokenizer, text):
    out, at = [], 0
    spaced = " " + text if isinstance(tokenizer, alignment.ByteLevel) else text
    for i in tokenizer.encode([spaced])[0]:
        out.append((i, at, at + len(tokenizer.bytes_of[i])))
        at = out[-1][2]
    return out


def alignments(texts):
    """What the operator returns, in the order of the texts, by comparing all pairs of tokens nearby."""
    a, b = alignment.ByteLevel(FIRST), alignment.Pieces(SECOND)
    per, count = [], Counter()
    for text in texts:
        x, y = (token_spans(t, text) for t in (a, b)) if text else ([], [])
        spelt = (" " + (text or "")).encode()
        if any(b"".join(t.bytes_of[i] for i, *_ in s) != spelt for t, s in ((a, x), (b, y))):
            x, y = [], []
        links, j = [], 0
        for i, begin, end in x:
            while y[j][2] <= begin:
                j += 1
            k = j
            while k < len(y) and y[k][1] < end:
                links.append((i, y[k][0]))
                k += 1
        count.update(links)
        groups, m, n = [], 0, 0
        for cut in sorted({s[2] for s in x} & {s[2] for s in y}):
            p = next(q for q in range(m, len(x)) if x[q][2] == cut) + 1
            r = next(q for q in range(n, len(y)) if y[q][2] == cut) + 1
            groups.append(",".join(str(s[0]) for s in x[m:p]) + "|" + ",".join(str(s[0]) for s in y[n:r]))
            m, n = p, r
        per.append((len(x), len(y), groups, links))
    highest = defaultdict(int)
    for (_, j), c in count.items():
        highest[j] = max(highest[j], c)
    for n_a, n_b, groups, links in per:
        yield (n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[1]] for p in links),
               sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_alignment(spark, monkeypatch):
    rng = random.Random(4)
    texts = ODD_TEXTS + ["".join(rng.choice("ab e.\né你") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += ["the same text once more"] * 5
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter((i, *w) for (i, _), w in zip(rows, alignments(texts)))
    got = alignment.align(docs.repartition(3), FIRST, SECOND)
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert Counter(map(tuple, got.select(*columns).collect())) == want
    assert alignment.align(docs.limit(0), FIRST, SECOND).count() == 0


def test_alignment_in_small_chunks():
    """Chunks of any size give the same documents."""
    import pyarrow as pa
    texts = ["one two three", "", "four", "five six", "seven eight nine ten", "x" * 90]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array(range(100, 106))],
                                       ["doc_id", "text", "row_no"])
    whole = None
    for size in (1, 20, 1 << 20):
        alignment.CHUNK_BYTES, kept = size, alignment.CHUNK_BYTES
        rows = [r for out in alignment._aligner(FIRST, SECOND)(iter([batch])) for r in out.to_pylist()]
        alignment.CHUNK_BYTES = kept
        own = [(r["doc_id"], r["n_links"], r["groups_sha256"]) for r in rows if r["pairs"] is None]
        assert whole in (None, own) and len({r["chunk"] for r in rows}) == sum(r["pairs"] is not None for r in rows)
        whole = own


def test_gallop_finds_what_a_binary_search_finds():
    rng = np.random.default_rng(1)
    ends, short, sizes, low, high, want = [], [], [], [], [], []
    for _ in range(50):
        long_ = np.unique(rng.integers(1, 3000, rng.integers(1, 900)))
        own = np.unique(rng.integers(1, long_[-1] + 1, rng.integers(1, 400)))
        low.append(sum(map(len, ends)))
        want.append(low[-1] + np.searchsorted(long_, own))
        ends.append(long_)
        short.append(own)
        sizes.append(len(own))
        high.append(low[-1] + len(long_))
    begins = np.cumsum(sizes) - sizes
    got = alignment.ranks(np.concatenate(short), begins, np.array(sizes), np.concatenate(ends), np.array(low), np.array(high))
    assert (got == np.concatenate(want)).all()


def test_bytes_of_ids_are_those_of_the_tokenizers():
    a, b = alignment.ByteLevel(FIRST), alignment.Pieces(SECOND)
    assert sorted(a.bytes_of[i] for i in range(256)) == sorted(bytes([i]) for i in range(256))
    assert sorted(x for i, x in enumerate(b.bytes_of) if b.model.is_byte(i)) == [bytes([i]) for i in range(256)]
    text = " Größe 你好 \x00\n"
    assert b"".join(a.bytes_of[i] for i in a.encode([text])[0]) == text.encode()


@pytest.mark.parametrize("seed", range(8))
def test_ids_of_units_are_those_of_whole_texts(seed):
    rng = random.Random(seed)
    spelt = alignment._loaded(FIRST, SECOND)
    letters = "ab cd ef, 12 's é 你 🙂 ▁ . \n \t \r\n \x1c \xa0 \u2003 \u200b \x85 \x00 <s> ́ <|endoftext|>".split(" ") + [" ", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    own, both = spelt.encode(texts)
    ends = [np.cumsum(sizes).tolist() for _, sizes in both]
    found = {t: [ids[e - s:e].tolist() for (ids, sizes), es in zip(both, ends)
                 for e, s in [(es[k], int(sizes[k]))]] for k, t in enumerate(own)}
    for i, text in enumerate(texts):
        x, y = spelt.a.encode([" " + text])[0], spelt.b.encode([text])[0]
        good = all(b"".join(t.bytes_of[j] for j in ids) == (" " + text).encode() for t, ids in ((spelt.a, x), (spelt.b, y)))
        assert (found[i] == [x, y]) if good and text else i not in found, repr(text)
