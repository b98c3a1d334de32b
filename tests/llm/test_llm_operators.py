"""Operators against brute force on a small fixture, with every odd case in it."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import count, islice

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logfathom.llm import (bpe, components, dedup, jaccard, licenses, packing, sharding, token_counts,
                           topk, toxicity, warc)

SMALL = "/root/testdata/sf0.001"
#: Columns that have names which the operators use themselves.
CLASHING = {"digest": "'x'", "row_no": "7", "NODE": "1", "score": "2.0", "bucket": "3", "page": "'p'",
            "chunk": "CAST(NULL AS STRING)", "tokens": "1", "text_sha256": "'s'", "kept": "false"}


def with_clashes(df, *names):
    return df.withColumns({name: F.expr(CLASHING[name]) for name in names or CLASHING})


def words(rng, n):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randint(0, 30))
                    for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(6, 60)) for _ in range(60)]
    near = [b.split() for b in base[:12] for _ in range(3)]
    for n in near:
        n[rng.randrange(len(n))] = "changed"
    found = base + base[:9] * 2 + [" ".join(n) for n in near]
    found += [None, "", " \t\n", "one", "Two words", "two  words", "TWO\tWORDS", "É é", words(rng, 30_000)]
    return found + ["loser " + base[1], "x" * 9_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", "hot" if i % 3 else f"s{i}", None) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "hot", 1), (None, "no id", None, None, None), (None, texts[2], "en", "hot", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return with_clashes(df).repartition(5)


@pytest.fixture(scope="module")
def plain(docs):
    """(doc_id, text with null as empty) of all rows."""
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, plain, empty):
    rows = dedup.exact_dedup(docs).collect()
    members = defaultdict(list)
    for doc_id, text in plain:
        members[hashlib.sha256(text.encode()).hexdigest()].append(doc_id)
    assert len(rows) == len(plain)
    for r in rows:
        own = members[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
    kept = [r for r in rows if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(set(members))
    assert all(r.doc_id == r.keep_id for r in kept)
    assert {r.from_history for r in rows} == {True, False}
    stay = dedup.keep_winners(docs)
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in stay.collect()) == Counter(
        (max((i for i in own if i is not None), default=None), text)
        for text, own in ((t, members[hashlib.sha256(t.encode()).hexdigest()]) for t in {t for _, t in plain}))
    assert dedup.exact_dedup(empty).count() == 0 and dedup.keep_winners(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_hash_is_minimal_and_perfect(n):
    found = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)),
                          np.uint8).reshape(-1, 32)
    groups, seeds, slots = dedup.build_slots(found)
    assert sorted(slots.tolist()) == list(range(n))
    if n:
        assert (dedup.probe_slots(found, groups, seeds, n) == slots).all()


def test_token_totals(spark, tmp_path):
    store = token_counts.TokenTotals(spark, str(tmp_path / "totals"))
    names = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long"
    load = [("s", "en", "v1", "insert", 10, None), ("s", "en", "v1", "insert", 5, None),
            (None, None, "v1", "insert", None, None), ("t", "de", "v2", "insert", 3, None)]
    change = [("s", "en", "v1", "delete", 5, None), ("s", "en", "v1", "revise", 12, 10),
              ("t", "de", "v2", "delete", 3, None)]
    assert store.totals().count() == 0
    for _ in range(2):
        store.commit("load", spark.createDataFrame(load, names))
    store.commit("change", spark.createDataFrame(change, names))
    store.commit("none", spark.createDataFrame([], names))
    want = {("s", "en", "v1", 1, 12), (None, None, "v1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact("all")
    assert {tuple(r) for r in store.totals().collect()} == want
    with pytest.raises(ValueError):
        store.commit("load", spark.createDataFrame(load, names))
    store.commit("more", spark.createDataFrame([("s", "en", "v1", "insert", 1, None)], names))
    assert ("s", "en", "v1", 2, 13) in {tuple(r) for r in store.totals().collect()}
    with pytest.raises(Exception, match="unknown change"):
        store.commit("bad", spark.createDataFrame([("s", "en", "v1", "drop", 1, None)], names))


def test_token_totals_survive_compactions_and_crashes(spark, tmp_path, monkeypatch):
    names = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long"
    batch = lambda n: spark.createDataFrame([("s", "en", "v", "insert", n, None)], names)
    store = token_counts.TokenTotals(spark, str(tmp_path / "totals"))
    tokens = lambda: sum(r.tokens for r in store.totals().collect())
    store.commit("load", batch(100))
    store.compact("all")
    # The id of a compaction is taken, and so are those of what it folded.
    for used in ("all", "load"):
        with pytest.raises(ValueError):
            store.commit(used, batch(1))
    with pytest.raises(ValueError):
        store.compact("all")
    assert tokens() == 100
    store.commit("more", batch(10))
    store.commit("more", batch(20))
    assert tokens() == 120
    # A crash before the manifest is in place leaves everything as it was, and can be repeated.
    publish = token_counts.TokenTotals._publish
    monkeypatch.setattr(token_counts.TokenTotals, "_publish", lambda self, change: 1 / 0)
    for act in (lambda: store.compact("again"), lambda: store.commit("lost", batch(7))):
        with pytest.raises(ZeroDivisionError):
            act()
    assert tokens() == 120
    monkeypatch.setattr(token_counts.TokenTotals, "_publish", publish)
    # A batch that is replaced while it is folded is not lost.
    sums = token_counts.TokenTotals._sums
    def slow(self, live):
        monkeypatch.setattr(token_counts.TokenTotals, "_sums", sums)
        store.commit("more", batch(30))
        return sums(self, live)
    monkeypatch.setattr(token_counts.TokenTotals, "_sums", slow)
    with pytest.raises(ValueError, match="changed"):
        store.compact("again")
    assert tokens() == 130
    store.compact("again")
    store.vacuum()
    assert tokens() == 130 and len(list((tmp_path / "totals" / "parts").iterdir())) == 1
    store.commit("last", batch(1))
    assert tokens() == 131


def test_token_counts_are_those_of_the_library(docs, plain):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(path))
    rows = token_counts.token_count(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.tokens) for r in rows.collect()) == Counter(
        (i, len(encoding.encode_ordinary(t))) for i, t in plain)


def test_packing(docs, plain, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, window=256).collect()
    ids = defaultdict(list)
    for doc_id, text in plain:
        ids[doc_id].append(tokenizer.encode(text, add_special_tokens=False).ids + [1])
    sequences = defaultdict(list)
    pieces = Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens] += r.length
        assert any(r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
                   for own in ids[r.doc_id] if len(own) == r.doc_tokens), r
    want = Counter()
    for doc_id, lists in ids.items():
        for own in lists:
            want[doc_id, len(own)] += len(own)
    assert pieces == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 256 or end & (end - 1) == 0
    assert {r.kind for r in rows} >= {"window", "combination", "tail"}
    assert packing.pack(empty, path).count() == 0


def test_packing_of_special_tokens(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "before<|endoftext|>after and on"), (2, "a <|startoftext|> b <|endoftext|>")]
    want = {i: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, window=256).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(ids) for i, ids in want.items()}
    for r in got:
        own = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_least_squares_and_rounding():
    rng = np.random.default_rng(2)
    table = packing.combinations(8)
    assert (np.arange(1, 8) @ table == 8).all()
    for _ in range(20):
        counts = rng.integers(0, 40, 7)
        x = packing.nnls(table, counts.astype(float))
        slope = table.T @ (counts - table @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max(initial=0) < 1e-6
        repeats = packing.whole_repeats(table, counts.tolist())
        assert (table @ repeats <= counts).all()


def test_checksums_of_joined_parts():
    shift = packing.crc_shift(12)
    parts = [bytes(random.Random(i).randbytes(12)) for i in range(9)]
    assert packing.joined_crc([zlib.crc32(p) for p in parts], shift) == zlib.crc32(b"".join(parts))


def test_sharding(docs, plain, empty):
    tree = sharding.even_tree(24)
    rows = sharding.assign(docs, tree, sharding.with_region(tree, "new", 24)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in plain)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert sharding.assign(empty, tree, tree).count() == 0


def test_shards_follow_their_weights(spark):
    tree = {"a": {"r": {0: 1.0, 1: 3.0}}, "b": {"r": {2: 2.0}, "s": {3: 0.0, 4: 2.0}}}
    keys = spark.range(40_000)
    now = sharding.place(keys, F.col("id"), tree, "shard")
    share = {r["shard"]: r["count"] / 40_000 for r in now.groupBy("shard").count().collect()}
    assert {k: round(v, 1) for k, v in share.items()} == {0: 0.1, 1: 0.4, 2: 0.2, 4: 0.2} or all(
        abs(share[k] - w / 8) < 0.02 for k, w in {0: 1, 1: 3, 2: 2, 4: 2}.items())
    heavier = {**tree, "b": {"r": {2: 4.0}, "s": tree["b"]["s"]}}
    moved = sharding.place(now, F.col("id"), heavier, "then").filter("shard <> then")
    # More weight in one rack draws keys into that region, and inside it into that rack only.
    assert {r["then"] for r in moved.select("then").distinct().collect()} <= {2, 4}
    assert moved.filter("shard IN (2) OR (shard = 4 AND then <> 2)").count() == 0


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def near_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[root(a)] = root(b)
    ids = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        ids[root(a)].append(i)
    return [(i, len(s), min((j for j in ids[root(a)] if j is not None), default=None) if s else i)
            for a, (i, s) in enumerate(sets)]


def test_jaccard_groups(docs, plain, empty):
    rows = jaccard.groups(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(near_groups(plain))
    stay = jaccard.keep_one(docs)
    assert stay.columns == docs.columns
    named = {i for i, _, c in near_groups(plain) if i == c}
    assert {r.doc_id for r in stay.collect()} == named
    assert jaccard.groups(empty).count() == 0


def test_near_copies_without_an_id_leave(spark):
    own, other = (words(random.Random(n), 60) for n in (1, 2))
    rows = [(1, own), (None, own + " more"), (None, other), (2, words(random.Random(3), 60))]
    stay = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, stay.collect())) == Counter([rows[0], rows[2], rows[3]])


@pytest.mark.parametrize("limits", [{}, {"MANY_REGIONS": 1}, {"PART": 3}, {"MANY_REGIONS": 1, "PART": 2}])
def test_jaccard_chains(spark, monkeypatch, limits):
    """Chains of texts that drift apart, so that regions border on each other."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(11)
    rows = []
    for chain in range(6):
        own = words(rng, 60).split()
        for _ in range(25):
            at = rng.randrange(len(own) - 3)
            own = own[:at] + [f"new{rng.randint(0, 9999)}"] * rng.choice([0, 1, 1, 2]) + own[at + 1:]
            rows.append((len(rows), " ".join(own)))
    for i in range(120):  # one passage in many texts
        rows.append((len(rows), "a b c d e f g h i j k " + words(rng, rng.randint(3, 12))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, jaccard.groups(df).collect())) == Counter(near_groups(rows))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_warc(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["http://a.example/x?b=1", "https://www.b.example/", None, "ftp://c/d\r\ne"]),
             rng.choice([None, "", "<p>é</p>", "WARC/1.1\r\n\r\nx\r\n\r\n", f"page {i}", "z" * 70_000]))
            for i in range(150)]
    rows += [rows[5], rows[5], (None, None, "unnamed"), (None, "http://a.example/", "page 3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = with_clashes(pages, "digest", "page").repartition(4)
    got = warc.archive_pages(pages, str(tmp_path / "warc")).collect()
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    of = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for t in groups}
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter(
        (i, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows)
    for r in got:
        text = of[r.payload_digest]
        best = max((i for i in groups[text] if i is not None), default=None)
        assert r.payload_bytes == len(text.encode())
        if r.record_type == "response":
            assert r.page_id == best and r.refers_to is None
        else:
            assert r.refers_to == best
    assert Counter(r.payload_digest for r in got if r.record_type == "response") == Counter(set(of))
    order = [(r.url_key, 1_700_000_000 + (-(1 << 63) if r.page_id is None else r.page_id) % 10 ** 9)
             for r in sorted(got, key=lambda r: (r.range_no, r.position))]
    assert order == sorted(order)
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("records", [1, 5_000])
def test_warc_payloads_that_hold_separators(spark, tmp_path, monkeypatch, records):
    """Each alone in an archive, and all in one."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", records)
    payloads = ["", "a", "\r\n", "\r\n\r\n", "\r\na\r\n", "a\r\n\r\n\r", "\r\n" * 5, "WARC/1.1\r\n\r\nx"]
    pages = spark.createDataFrame([(i, "http://a.example/", p) for i, p in enumerate(payloads)],
                                  "page_id long, url string, html string")
    path = tmp_path / "warc"
    warc.write_archives(warc.typed(pages).coalesce(1), str(path))
    got = {r.page_id: r for r in warc.read_archives(spark, str(path)).collect()}
    assert len(list(path.glob("*.gz"))) == (8 if records == 1 else 1)
    for i, payload in enumerate(payloads):
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), digest)
        content = gzip.decompress((path / got[i].archive).read_bytes())[got[i].offset:]
        assert content.startswith(b"WARC/1.1\r\n") and f"Record-ID: <urn:page:{i}:1>".encode() in content[:200]


def test_warc_archives_are_read_a_record_at_a_time():
    """Of an archive without end, whose records come out as they are read."""
    def pieces():
        for i in count():
            yield f"WARC/1.1\r\nX-Number: {i}\r\nContent-Length: 7".encode()
            yield b"abc\r"
            yield b""
    with pytest.raises(ValueError, match="does not end"):
        list(islice(warc.parse_archive(pieces()), 3))

    def sound():
        for i in count():
            yield f"WARC/1.1\r\nX-Number: {i}\r\nContent-Length: 8".encode()
            yield b"abc\r"[:3]
            yield b"d"
    found = list(islice(warc.parse_archive(sound()), 1000))
    assert [(int(h["X-Number"]), p) for _, h, p in found] == [(i, b"abc\r\n\r\nd") for i in range(1000)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(islice(sound(), 4)))


def test_warc_revisits_of_pages_that_share_an_id(spark, tmp_path):
    rows = [(None, "http://a/", text) for text in ("one", "one", "three", "three", "fifteen")]
    rows += [(7, "http://b/", text) for text in ("sixteen", "sixteen", "four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages, str(tmp_path / "warc")).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((i, len(t)) for i, _, t in rows)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), i) for i in range(rng.randint(0, 20))) for _ in range(k)]
    merged = list(warc.merge_runs(runs))
    assert [entry for entry, _ in merged] == sorted(e for run in runs for e in run)


def test_licenses(spark, empty):
    notice = licenses.TEMPLATES["GPL-3.0"]
    rows = [(1, f"words before\n{notice}\nand after"), (2, notice.upper() + " " + licenses.TEMPLATES["MIT"]),
            (3, notice.replace("version 3", "version 2")), (4, "this is a work of art"), (5, None), (6, ""),
            (7, "license"), (8, f"{notice}\n{notice}"), (None, notice), (9, "a b " * 5000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.license): (r.dice, r.n_units) for r in got}
    assert found == {(1, "GPL-3.0"): (1.0, 1), (2, "GPL-3.0"): (1.0, 1), (2, "MIT"): (1.0, 1),
                     (3, "GPL-3.0"): (0.909091, 1), (8, "GPL-3.0"): (1.0, 2), (None, "GPL-3.0"): (1.0, 1)}
    assert licenses.scan(empty).count() == 0


def test_licenses_across_lines_and_in_sentences(spark):
    mit = licenses.FULL_TEXTS["MIT"].split()
    wrapped = "\n".join(" ".join(mit[i:i + 12]) for i in range(0, len(mit), 12))
    short = "Released under the MIT License."
    rows = [(1, "This work is licensed under the GNU\nGeneral Public License, version 3."),
            (2, "Copyright 2020 Foo Bar, released under the MIT License"), (3, f"MIT\n\n{wrapped}\nend"),
            (4, f"We say that it was {short[:-1]} and so on\n{short}"),
            (5, "it is released under the BSD\nLicense"), (6, licenses.FULL_TEXTS["ISC"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license): (r.dice, r.n_units) for r in got} == {
        (1, "GPL-3.0"): (1.0, 1), (2, "MIT"): (1.0, 1), (3, "MIT"): (1.0, 1), (4, "MIT"): (1.0, 2),
        (6, "ISC"): (1.0, 1)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_words_an_edit_away():
    rng = random.Random(9)
    entries = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(25)]
    lexicon = toxicity.Lexicon(dict.fromkeys(entries, 5.0), {"cccab": 4.0})
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        found = lexicon.find(word)
        near = min(distance(word, e) for e in entries)
        if near == 0 or word.startswith("cccab"):
            assert found and not found[1]
        elif near == 1:
            assert found == (5.0, True)
        else:
            assert found is None


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    train = [(i, words(rng, 20) + (" Verminous folk, all scoundrels" if i % 4 == 0 else ""), i % 4 == 0)
             for i in range(400)]
    rows = spark.createDataFrame([t[:2] for t in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in train] + [(1, 0, None), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(rows, labels)
    assert model.score("you SCOUNDRELS are verminous") > 0.5 > model.score("a quiet day")
    assert model.score("you are a verminus scoundrelss") > model.score("a quiet day")
    assert model.score('they called us "scoundrels" and left') < model.score("you scoundrels go and leave")
    assert 0 <= model.score("") < 0.5
    got = toxicity.scores(rows, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == int(r.doc_id % 4 == 0)
    assert toxicity.scores(docs, labels).count() == docs.count()
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.scores(empty, labels).count() == 0
    assert toxicity.scores(rows, labels.limit(0)).filter("score BETWEEN 0 AND 1").count() == 400


def test_lexicon_holds_every_toxic_word(spark):
    letters = "abcdefghijklmnopqrst"
    bad = [f"{letters[i % 20]}{letters[i // 20]}{letters[i % 7]}{letters[i % 11]}{letters[i % 13]}wxyz"
           for i in range(150)]
    rows = [(i, " ".join(bad) if i % 2 else f"some clean text {i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df, df.select("doc_id", "toxic")).lexicon
    # Only whole words are also found with an edit.
    assert all(lexicon.find(word) and lexicon.find(word[:2] + "_" + word[2:]) for word in bad)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert len(rows) > 50 and right > 0.93


def test_byte_bpe(docs, plain, empty):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(path))
    rows = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()

    def of(text):
        ids = encoding.encode_ordinary(text)
        return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest())
    assert Counter(map(tuple, rows)) == Counter((i, *of(t)) for i, t in plain)
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_odd_text(monkeypatch):
    import tiktoken
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    monkeypatch.setattr(bpe, "TOGETHER", 40)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})
    own, rng = bpe.ByteBPE(ranks, public_tokenizers.PATTERN), random.Random(5)
    parts = ["a", "the", "ab", "\n", " ", "  ", "é", "ж", "👍", "1", "23", "'s", "'", "_", "\x1c", "\x85",
             "　", "aaaa", "中", "́", "#", "!!", "=", "\x00"]
    found = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    found += ["a" * 4000, "ab" * 2000, "=" * 3001, " " * 777 + "x", "中" * 999, "abcde" * 400]
    for text, ids in zip(found, own.encode_all(found)):
        assert ids == encoding.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(size=(700, 12)), 2)
    vectors[300:420] = vectors[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (950, [1.0, None] + [0.0] * 10), (1000, [float("nan")] * 12), (1050, []),
             (1100, [float("inf")] * 12), (1150, [1.0, 2.0]), (1151, [3.0, 4.0]), (None, [0.0] * 12),
             (1200, [1e30] * 12), (50, rows[50][1]), (1250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, 5, block_vectors=90, block_queries=5)
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for q, v in {(i, tuple(v)) for i, v in sound if i % 50 == 0}:
        scored = sorted((-cut(sum(min(a, (1 << 63) - 1) * min(b, (1 << 63) - 1) for a, b in zip(v, w))), i)
                        for i, w in sound if i != q and len(w) == len(v))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0




@pytest.mark.parametrize("copies", [1, 2, 3, 9])
def test_copies_of_a_licence_count_one_by_one(spark, copies):
    """Copies side by side, and with text between them, of a full text and of a wrapped notice."""
    full = licenses.FULL_TEXTS["MIT"] if "MIT" in licenses.FULL_TEXTS else next(iter(licenses.FULL_TEXTS.values()))
    name = next(n for n, t in licenses.FULL_TEXTS.items() if t == full)
    texts = [(1, "\n\n".join([full] * copies)), (2, " and then something else of some length ".join([full] * copies))]
    rows = licenses.scan(with_clashes(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    found = {r.doc_id: (r.n_units, r.dice) for r in rows if r.license == name}
    assert found == {1: (copies, 1.0), 2: (copies, 1.0)}
