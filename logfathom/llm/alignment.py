"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a space and the text; the byte offsets at which their tokens end are two sorted
lists. The shorter list drives a galloping search in the longer one: from where an earlier end was
found steps double until they pass the end, and a binary search settles the rest. All ends of a
stretch of documents are searched at once, every 256th first, then every 16th, then all, each from
where the one before it was found. Ends in both lists cut the tokens into groups, and the
differences of ranks give the range of tokens that each token of the shorter list overlaps.

How often two ids are linked is counted over the corpus: documents are worked on in chunks, a chunk
counts its distinct pairs, and the totals come back to each chunk as a table of its own pairs, next
to its links. No table of all pairs is held by any task.

Cases: a null or empty text, or one that the tokens of either side don't spell byte by byte, has no
tokens and zeros; repeated rows are documents of their own and count as often as they occur; a null
doc_id stays null; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, staged, text_of
from .unit_ids import UnitIds, in_order

#: Bytes of texts in a chunk, and of those tokenized together.
CHUNK_BYTES, TOGETHER_BYTES = 8 << 20, 1 << 20
#: Units that are tokenized together.
TOGETHER = 10_000
# Fixed value: how a byte-level tokenizer cuts texts of which units can be encoded on their own.
BY_WORDS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: White space beyond ASCII's, and separators that some take for it.
ODD_TEXT = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
ODD = re.compile(b"[\x1c-\x1f]|" + "|".join(
    f"{chr(c)}" for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030),
                          *range(0x205F, 0x2065), 0x3000, 0xFEFF)).encode())
#: Ends between those that are searched first, at each level.
STRIDES = (256, 16, 1)
#: Bits of an id of the second tokenizer in a pair.
SECOND_BITS = 20

ALIGNED_SCHEMA = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                  "groups_sha256 string, links binary, pairs array<long>, times array<long>")
RESULT_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                 "count_sum long, groups_sha256 string")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable characters of
    Latin-1 stand for themselves, the other bytes in turn for those from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer and the bytes of each id."""

    prefix, spelt_prefix = "", b""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        entries = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())
        self.bytes_of = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        config = json.loads(self.tokenizer.to_str())
        # Its pattern leaves white space in front of a word, and the words apart.
        self.by_units = config["normalizer"] is None and config["pre_tokenizer"] == BY_WORDS

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space before the text, and the bytes of each id."""

    # With a letter in front, the space that the model adds stays away from the first unit.
    prefix, spelt_prefix = "a", b" a"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes_of = [bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                         else piece.replace("▁", " ").encode() for i, piece in zip(ids, pieces)]
        # No piece goes on with white space after another character, and all white space is kept.
        probe = "a  b\n c  "
        self.by_units = (not any(re.search("[^▁]▁|.\n", piece) for piece in pieces)
                         and b"".join(self.bytes_of[i] for i in self.model.encode(probe)) == f" {probe}".encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class SpeltIds:
    """Ids of units under both tokenizers, of those that spell the unit byte by byte.

    A unit is white space and the word that follows, up to the next space or line end. Neither
    tokenizer joins these with what stands before, so the ids of a text are those of its units. Texts with other white space than ASCII's
    are units themselves.
    """

    def __init__(self, first: str, second: str) -> None:
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.by_units = self.a.by_units and self.b.by_units
        self.memory = UnitIds(*[partial(self._ids_of, t, np.array([len(x) for x in t.bytes_of], np.int64))
                                for t in (self.a, self.b)])
        self.written = [b"%d%s" % (i, end) for size, end in (
            (len(self.a.bytes_of), b","), (len(self.a.bytes_of), b"|"), (len(self.b.bytes_of), b","),
            (len(self.b.bytes_of), b";"), (len(self.b.bytes_of), b"")) for i in range(size)]

    def _ids_of(self, tokenizer: ByteLevel | Pieces, lengths: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has: none if they don't spell it."""
        alone = np.array([unit[-1:].isspace() or ODD.search(unit) is not None for unit in units], bool)
        parts, sizes = [], []
        for group, rest in ((np.nonzero(~alone)[0], False), (np.nonzero(alone)[0], True)):
            for begin in range(0, len(group), TOGETHER):
                some = [units[i] for i in group[begin:begin + TOGETHER]]
                together = None if rest else self._joined(tokenizer, lengths, some)
                ids, own = together or self._single(tokenizer, lengths, some)
                parts.append(ids)
                sizes.append(own)
        order = np.empty(len(units), np.int64)
        order[np.argsort(alone, kind="stable")] = np.arange(len(units))
        return in_order(np.concatenate(parts), np.concatenate(sizes), order)

    def _joined(self, tokenizer, lengths: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Many units as one text, None if some are not spelt."""
        text = b"".join(units)
        ids = tokenizer.encode([tokenizer.prefix + text.decode()])[0]
        if b"".join(map(tokenizer.bytes_of.__getitem__, ids)) != tokenizer.spelt_prefix + text:
            return None
        ids = np.array(ids, np.int64)
        ends = np.cumsum(lengths[ids])
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        bounds += len(tokenizer.spelt_prefix)
        at = np.searchsorted(ends, bounds, "left") + 1
        if bounds[0] == 0:
            at[0] = 0
        if (ends[at[1:] - 1] != bounds[1:]).any() or at[0] and ends[at[0] - 1] != bounds[0]:
            return None
        return ids[at[0]:].astype(np.uint32), np.diff(at)

    def _single(self, tokenizer, lengths: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for unit, ids in zip(units, tokenizer.encode([tokenizer.prefix + unit.decode() for unit in units])):
            begin, before = 0, len(tokenizer.spelt_prefix)
            while before > 0 and begin < len(ids):
                before -= int(lengths[ids[begin]])
                begin += 1
            spelt = b"".join(map(tokenizer.bytes_of.__getitem__, ids)) == tokenizer.spelt_prefix + unit
            found.append(ids[begin:] if spelt and not before else [])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
        """The texts that both spell, and for each tokenizer their ids in a row and how many each has."""
        spaced = [" " + text for text in texts]
        cut = [i for i, text in enumerate(spaced) if self.by_units and ODD_TEXT.search(text) is None]
        whole = sorted({i for i, text in enumerate(texts) if text}.difference(cut))
        cut = [i for i in cut if texts[i]]
        marked = pc.replace_substring_regex(pa.array([spaced[i] for i in cut], pa.string()),
                                            "([^ \\t-\\r])([ \\n])", "\\1\x1e\\2")
        split = pc.split_pattern(marked, "\x1e")
        coded = split.flatten().dictionary_encode()
        units = coded.dictionary.cast(pa.binary()).to_pylist()
        at = np.concatenate([np.asarray(coded.indices, np.int64), len(units) + np.arange(len(whole))])
        counts = np.concatenate([np.diff(np.asarray(split.offsets, np.int64)), np.ones(len(whole), np.int64)])
        if not len(counts):
            return [], []
        found = self.memory.find(units + [spaced[i].encode() for i in whole])[at]
        doc = np.repeat(np.arange(len(counts)), counts)
        both = [self.memory.gather(found, i) for i in range(2)]
        bad = np.zeros(len(counts), bool)
        for _, sizes in both:
            bad[doc[sizes == 0]] = True
        out = []
        for ids, sizes in both:
            keep = np.repeat(~bad[doc], sizes)
            per = np.bincount(doc, weights=sizes, minlength=len(counts)).astype(np.int64)[~bad]
            out.append((ids[keep].astype(np.int64), per))
        return [i for i, lost in zip([*cut, *whole], bad.tolist()) if not lost], out


def _loaded(first: str, second: str) -> SpeltIds:
    return kept(("alignment", first, second), lambda: SpeltIds(first, second))


def gallop(keys: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each key the first place from ``low`` on (below ``high``) whose end is not below it.

    Steps from ``low`` double while they stay below the key; a binary search follows.
    """
    low, upper = low.copy(), high.copy()
    going, step = np.arange(len(keys)), 1
    while len(going):
        probe = low[going] + (step - 1)
        inside = probe < high[going]
        below = inside.copy()
        below[inside] = ends[probe[inside]] < keys[going[inside]]
        stopped = going[inside & ~below]
        upper[stopped] = low[stopped] + (step - 1)
        going = going[below]
        low[going] += step
        step *= 2
    going = np.nonzero(low < upper)[0]
    while len(going):
        middle = (low[going] + upper[going]) // 2
        below = ends[middle] < keys[going]
        low[going[below]] = middle[below] + 1
        upper[going[~below]] = middle[~below]
        going = going[low[going] < upper[going]]
    return low


def ranks(short: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ends: np.ndarray, low: np.ndarray,
          high: np.ndarray) -> np.ndarray:
    """Place in ``ends`` of each end in ``short``, document by document.

    Document i has the ends from ``begins[i]`` on, ``sizes[i]`` of them, in ``short``, and those from
    ``low[i]`` to ``high[i]`` in ``ends``.
    """
    docs = np.repeat(np.arange(len(sizes)), sizes)
    number = np.arange(len(docs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = begins[docs] + number
    found, start = np.zeros(len(docs), np.int64), low[docs]
    for i, stride in enumerate(STRIDES):
        own = np.nonzero(number % stride == 0)[0]
        if i:
            start = found[np.arange(len(docs)) - number % STRIDES[i - 1]]
        found[own] = gallop(short[at[own]], ends, start[own], high[docs[own]])
    return found


def _ends(ids: np.ndarray, sizes: np.ndarray, bytes_of: list[bytes]) -> np.ndarray:
    """Byte offsets in its document at which each token ends."""
    lengths = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))[ids]
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], ends])[np.cumsum(sizes) - sizes]
    return ends - np.repeat(before, sizes)


class Aligned:
    """The alignment of a stretch of documents, none of them without tokens."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
                 a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.a, self.a_sizes = a
        self.b, self.b_sizes = b
        ends = {"a": _ends(self.a, self.a_sizes, a_bytes), "b": _ends(self.b, self.b_sizes, b_bytes)}
        begins = {"a": np.cumsum(self.a_sizes) - self.a_sizes, "b": np.cumsum(self.b_sizes) - self.b_sizes}
        sizes = {"a": self.a_sizes, "b": self.b_sizes}
        self.common = {"a": np.zeros(len(self.a), bool), "b": np.zeros(len(self.b), bool)}
        links = []
        for short, long, docs in (("a", "b", np.nonzero(self.a_sizes <= self.b_sizes)[0]),
                                  ("b", "a", np.nonzero(self.a_sizes > self.b_sizes)[0])):
            n, low = sizes[short][docs], begins[long][docs]
            rank = ranks(ends[short], begins[short][docs], n, ends[long], low, low + sizes[long][docs])
            first_of_doc = np.cumsum(n) - n
            driver = np.repeat(begins[short][docs] - first_of_doc, n) + np.arange(int(n.sum()))
            both = ends[long][rank] == ends[short][driver]
            self.common[short][driver[both]] = True
            self.common[long][rank[both]] = True
            # A token overlaps from where the one before it ended to where it ends itself.
            first = np.concatenate([[0], (rank + both)[:-1]]) if len(rank) else rank
            first[first_of_doc] = low
            times = rank - first + 1
            total = np.cumsum(times)
            other = np.arange(int(times.sum())) - np.repeat(total - times - first, times)
            ours, doc = np.repeat(driver, times), np.repeat(np.repeat(docs, n), times)
            links.append((doc, ours, other) if short == "a" else (doc, other, ours))
        doc, i, j = (np.concatenate(parts) for parts in zip(*links))
        order = np.argsort(doc, kind="stable")
        self.pairs = (self.a[i] << SECOND_BITS | self.b[j])[order]
        count = len(self.a_sizes)
        self.n_links = np.bincount(doc, minlength=count)
        self.n_groups = np.bincount(np.repeat(np.arange(count), self.a_sizes)[self.common["a"]], minlength=count)

    def written_groups(self, written: list[bytes], a_count: int, b_count: int) -> Iterator[bytes]:
        """The groups of each document as text."""
        a_last, b_last = np.nonzero(self.common["a"])[0], np.nonzero(self.common["b"])[0]
        a_group = np.cumsum(self.common["a"]) - self.common["a"]
        b_group = np.cumsum(self.common["b"]) - self.common["b"]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + np.concatenate([[0], b_last + 1])[a_group]] = (
            self.a + np.where(self.common["a"], a_count, 0))
        after = np.where(self.common["b"], b_count, 0)
        after[np.cumsum(self.b_sizes) - 1] = 2 * b_count
        codes[np.arange(len(self.b)) + (a_last + 1)[b_group]] = 2 * a_count + self.b + after
        end = 0
        for size in (self.a_sizes + self.b_sizes).tolist():
            yield b"".join(map(written.__getitem__, codes[end:end + size].tolist()))
            end += size


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begins and ends of stretches of about TOGETHER_BYTES."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > TOGETHER_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    yield begin, len(texts)


def _packed(numbers: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Numbers below 2^24 of each document, the bytes of equal weight together."""
    planes = [(numbers >> 8 * k & 255).astype(np.uint8).tobytes() for k in range(3)]
    ends = np.cumsum(sizes).tolist()
    return [b"".join(p[a:b] for p in planes) for a, b in zip([0, *ends], ends)]


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row ends."""
    planes = [np.frombuffer(r, np.uint8).reshape(3, -1) for r in rows]
    sizes = np.array([p.shape[1] for p in planes], np.int64)
    held = np.concatenate(planes, axis=1).astype(np.int64) if planes else np.zeros((3, 0), np.int64)
    return held[0] | held[1] << 8 | held[2] << 16, np.cumsum(sizes)


def _aligner(first: str, second: str):
    def chunk_rows(number: int, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        spelt = _loaded(first, second)
        a_bytes, b_bytes = spelt.a.bytes_of, spelt.b.bytes_of
        n = len(texts)
        columns = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        shas, links, found, held = [""] * n, [b""] * n, [], []
        for begin, end in _stretches(texts):
            own, ids = spelt.encode(texts[begin:end])
            if not own:
                continue
            own = [begin + i for i in own]
            some = Aligned(*ids, a_bytes, b_bytes)
            for name, values in (("n_a", some.a_sizes), ("n_b", some.b_sizes),
                                 ("n_groups", some.n_groups), ("n_links", some.n_links)):
                columns[name][own] = values
            for i, text in zip(own, some.written_groups(spelt.written, len(a_bytes), len(b_bytes))):
                shas[i] = hashlib.sha256(text).hexdigest()
            held += own
            found.append(some.pairs)
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if held:
            coded = pa.chunked_array([pa.array(p) for p in found]).combine_chunks().dictionary_encode()
            codes = np.asarray(coded.indices)
            pairs, times = np.asarray(coded.dictionary), np.bincount(codes, minlength=len(coded.dictionary))
            # Frequent pairs have small numbers, which take less room.
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            pairs, times = pairs[order], times[order]
            for i, packed in zip(held, _packed(place[codes], columns["n_links"][held])):
                links[i] = packed
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * (n + 1), pa.int64()), pa.array([*doc_ids.to_pylist(), None], pa.int64()),
             *[pa.array([*v.tolist(), None], pa.int64()) for v in columns.values()],
             pa.array([*shas, None], pa.string()), pa.array([*links, None], pa.binary()),
             pa.array([None] * n + [pairs], longs), pa.array([None] * n + [times], longs)],
            [f.split()[0] for f in ALIGNED_SCHEMA.split(", ")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, held = [], 0, 0
            for i, text in enumerate(batch["text"]):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= CHUNK_BYTES or i == batch.num_rows - 1:
                    # A chunk has the number of its first row.
                    yield chunk_rows(batch["row_no"][begin].as_py(), batch["doc_id"][begin:i + 1], texts)
                    texts, begin, held = [], i + 1, 0
    return align


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Documents and, once for each chunk, its distinct pairs; written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       F.monotonically_increasing_id().alias("row_no"))
    return staged(rows.mapInArrow(_aligner(first, second), ALIGNED_SCHEMA), "aligned")


def pair_counts(aligned_: DataFrame) -> DataFrame:
    """Per pair of ids: pair (the first id, then SECOND_BITS of the second), count (links of the
    corpus that hold it), best (whether no pair of its second id has a higher count)."""
    entries = aligned_.filter("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "times")))
    counts = staged(entries.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << SECOND_BITS) - 1)
    highest = counts.groupBy(second.alias("second")).agg(F.max("count").alias("highest"))
    return counts.withColumn("second", second).join(highest, "second").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _scored(docs: pa.Table, looked: pa.Table) -> pa.Table:
    """Documents of a chunk with the sums over their links; ``looked`` has its pairs."""
    count, best = np.zeros(looked.num_rows, np.int64), np.zeros(looked.num_rows, np.int64)
    at = np.asarray(looked["at"])
    count[at], best[at] = np.asarray(looked["count"]), np.asarray(looked["best"], np.int64)
    codes, ends = _unpacked(docs["links"].to_pylist())
    sums = []
    for values in (best, count):
        running = np.concatenate([[0], np.cumsum(values[codes])])
        sums.append(pa.array(running[ends] - running[np.concatenate([[0], ends[:-1]]).astype(np.int64)]))
    return pa.table([*[docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *sums,
                     docs["groups_sha256"]], names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` is a byte-level tokenizer file and ``second`` a sentencepiece model that every
    executor can open.
    """
    rows = aligned(docs, first, second)
    entries = rows.filter("pairs IS NOT NULL").select(
        F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("at", "pair"))
    looked = entries.join(pair_counts(rows), "pair").select("of_chunk", "at", "count", "best")
    held = rows.filter("pairs IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links",
                                               "groups_sha256", "links")
    return held.groupBy("chunk").cogroup(looked.groupBy("of_chunk")).applyInArrow(_scored, RESULT_SCHEMA)
