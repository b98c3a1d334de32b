"""Packing token sequences into windows by non-negative least squares.

Documents are cut into full windows, one main piece (a multiple of a quantum, shorter than a
window) and a tail shorter than the quantum. Shallow combinations of main lengths that fill a
window exactly are enumerated; non-negative least squares finds how often to repeat each so that
they use up the histogram of main lengths. The repeats are rounded down and corrected until no
length is overdrawn. What is left over, and the tails, are packed greedily: laid end to end, and
cut where a window ends. The last window of each of these two streams is cut into sequences whose
lengths are powers of two, which need no padding.

Tokens are made once and stay where they were made. What moves is the checksum of every quantum,
from which the checksum of any piece follows, and the ids of the tails.

Cases: a null or empty text is just the end id; repeated rows and rows with a null doc_id are
documents of their own; an empty table gives an empty result. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, prefix_sums, release, shares, staged, text_of

#: Pieces in a combination, at most.
DEPTH = 4
#: Tokens in a quantum.
QUANTUM = 64
#: Documents that one task places, about.
CHUNK_DOCUMENTS = 20_000
#: Words that are tokenized together, and bytes of texts whose words are.
TOGETHER, PART_BYTES = 10_000, 4 << 20
#: Bytes of the words that a worker remembers (twice as many before the oldest go), what one takes
#: with its ids, and the most characters of a word that is looked up again.
REMEMBERED_BYTES, WORD_BYTES, LONGEST = 40 << 20, 200, 64
#: A text that shows whether a tokenizer joins across white space or keeps it.
PROBE = "Some words, it's x1 \n\t  and\rMORE |"
# How tokenizers of the given kind normalise a text and cut it.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}

TOKENS_SCHEMA = ("doc_id long, doc_tokens long, windows array<long>, quanta array<long>, "
                 "tail binary")
PIECES_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                 "sequence_id long, offset long, kind string")


class WordIds:
    """Ids of whole texts, put together from the ids of their words.

    The tokenizers this serves drop white space and never join across it, so the ids of a text
    are those of its words in turn, and a word that is remembered is not tokenized again. Literals
    of special tokens, which hold no white space, become these tokens, as Tokenizer.encode has it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if self._of_text(PROBE) != [i for word in PROBE.split() for i in self._of_text(word)]:
            raise ValueError("a tokenizer that drops white space is wanted")
        # A word of ASCII letters is one piece, unless the tokenizer cuts in another way.
        config = json.loads(self.tokenizer.to_str())
        special = any(t["content"].isalpha() for t in config["added_tokens"])
        pieces = config["pre_tokenizer"].get("pretokenizers", [{}])
        self.plain = not special and config["normalizer"] == NORMALIZER and pieces[0].get("pattern") == {"Regex": PATTERN}
        self.model = self.tokenizer.model
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _of_text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Words that are not remembered, with their ids."""
        rest = words
        if self.plain:
            tokenize, rest = self.model.tokenize, []
            for word in words:
                if word.isascii() and word.isalpha():
                    yield word, [t.id for t in tokenize(word.lower())]
                else:
                    rest.append(word)
        for begin in range(0, len(rest), TOGETHER):
            some = rest[begin:begin + TOGETHER]
            for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                yield word, got.ids

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Memory is bounded in bytes: what was not used since the last time it
        was full goes, and long words are not remembered."""
        if self.held > REMEMBERED_BYTES:
            self.older, self.recent, self.held = self.recent, {}, 0
        recent, older = self.recent, self.older
        new = []
        for word in words:
            if word not in recent:
                ids = older.get(word)
                if ids is None:
                    new.append(word)
                else:
                    recent[word] = ids
                    self.held += WORD_BYTES
        long = {}
        for word, ids in self._new(new):
            raw = np.array(ids, self.kind).tobytes()
            if len(word) <= LONGEST:
                recent[word] = raw
                self.held += WORD_BYTES
            else:
                long[word] = raw
        if long:
            return [long[word] if word in long else recent[word] for word in words]
        return list(map(recent.__getitem__, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends in them."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        codes = np.asarray(coded.indices)
        counts = sizes[codes]
        ends = np.cumsum(counts)
        # Where each word's ids are, counted on from where they go.
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - counts)
        at = np.repeat(shift, counts)
        at += np.arange(len(at))
        offsets = np.asarray(words.offsets, np.int64)
        return flat[at], np.concatenate([[0], ends])[offsets[1:] - offsets[0]]

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``encode`` returns, for some MB of texts at a time."""
        begin, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if held and held + size > PART_BYTES:
                yield self.encode(texts[begin:i])
                begin, held = i, 0
            held += size
        yield self.encode(texts[begin:])


def tokenized(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Per document its length, the checksums of its windows and quanta, and the ids of its tail."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("packing", path), lambda: WordIds(path))
        for batch in batches:
            sizes, windows, quanta, tails = [], [], [], []
            for ids in (np.append(flat[a:b], end_id).astype("<u4") for flat, ends in words.parts(batch["text"])
                        for a, b in zip([0, *ends.tolist()], ends.tolist())):
                raw, n = memoryview(ids).cast("B"), len(ids)
                full, main = n // window * window, n // QUANTUM * QUANTUM
                sizes.append(n)
                windows.append([zlib.crc32(raw[4 * i:4 * (i + window)]) for i in range(0, full, window)])
                quanta.append([zlib.crc32(raw[4 * i:4 * (i + QUANTUM)])
                               for i in range(full, main, QUANTUM)])
                tails.append(bytes(raw[4 * main:]))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(windows, longs),
                 pa.array(quanta, longs), pa.array(tails, pa.binary())],
                ["doc_id", "doc_tokens", "windows", "quanta", "tail"])
            release()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
            .mapInArrow(encode, TOKENS_SCHEMA))


def combinations(units: int, depth: int = DEPTH) -> np.ndarray:
    """Multisets of at most ``depth`` lengths below ``units`` that sum to it: a row for each
    length, a column for each multiset, with the number of times it holds the length."""
    columns = [c for size in range(2, depth + 1)
               for c in combinations_with_replacement(range(1, units), size) if sum(c) == units]
    table = np.zeros((units - 1, len(columns)))
    for j, column in enumerate(columns):
        for length in column:
            table[length - 1, j] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-10 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(3 * n + 10):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        if not n or slope.max() <= tolerance:
            break
        passive[slope.argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if trial[passive].min() > 0:
                break
            # Go towards the trial until the first of its variables reaches zero.
            blocked = passive & (trial <= 0)
            share = np.min(x[blocked] / np.maximum(x[blocked] - trial[blocked], 1e-300))
            x = x + share * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                trial = x
                break
        x = trial
    return x


def whole_repeats(table: np.ndarray, counts: list[int]) -> list[int]:
    """Whole repeats of each combination that overdraw no length.

    The solution is rounded down, cut back where it overdraws, and then combinations that still
    fit are added, those repeated most first.
    """
    x = nnls(table, np.asarray(counts, float))
    use = table.astype(int).tolist()
    repeats = [int(v) for v in np.floor(x + 1e-9)]
    rest = [c - sum(u * r for u, r in zip(row, repeats)) for c, row in zip(counts, use)]
    order = sorted(range(len(repeats)), key=lambda j: (-x[j], j))
    held = [[(i, use[i][j]) for i in range(len(counts)) if use[i][j]] for j in range(len(repeats))]
    for j in reversed(order):
        over = max((-(-max(0, -rest[i]) // m) for i, m in held[j]), default=0)
        cut = min(repeats[j], over)
        repeats[j] -= cut
        for i, m in held[j]:
            rest[i] += cut * m
    for j in order:
        more = min((rest[i] // m for i, m in held[j]), default=0)
        if more > 0:
            repeats[j] += more
            for i, m in held[j]:
                rest[i] -= more * m
    return repeats


def crc_shift(count: int) -> list[list[int]]:
    """Tables that carry a CRC-32 past ``count`` bytes: what they add to it is the XOR of one
    entry of each table, so that crc(a + b) = shift(crc(a)) ^ crc(b)."""
    step = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        step.append(v)

    def past(v: int) -> int:
        for _ in range(count):
            v = v >> 8 ^ step[v & 255]
        return v

    bits = [past(1 << i) for i in range(32)]
    tables = []
    for byte in range(4):
        row = [0] * 256
        for v in range(1, 256):
            low = v & -v
            row[v] = row[v ^ low] ^ bits[8 * byte + low.bit_length() - 1]
        tables.append(row)
    return tables


def joined_crc(parts: list[int], shift: list[list[int]]) -> int:
    a, b, c, d = shift
    crc = 0
    for part in parts:
        crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24] ^ part
    return crc


class Stream:
    """Pieces laid end to end: where they fall in sequences of ``size``.

    What doesn't fill the last sequence is cut into sequences of powers of two.
    """

    def __init__(self, total: int, size: int, first: int) -> None:
        self.size, self.first, self.full = size, first, total // size
        self.ends, at = [], self.full * size
        for power in reversed(range(size.bit_length())):
            if total - at >= 1 << power:
                at += 1 << power
                self.ends.append(at)
        self.sequences = self.full + len(self.ends)

    def cut(self, position: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, offset in it, begin in the piece, length) of each part of a piece."""
        begin = 0
        while begin < length:
            at = position + begin
            if at < self.full * self.size:
                number, offset = divmod(at, self.size)
                room = self.size - offset
            else:
                number = next(i for i, end in enumerate(self.ends) if at < end)
                start = self.ends[number - 1] if number else self.full * self.size
                offset, room = at - start, self.ends[number] - at
                number += self.full
            took = min(room, length - begin)
            yield self.first + number, offset, begin, took
            begin += took


class Plan:
    """Where every document's pieces go, from the counts of all and those before its chunk."""

    def __init__(self, window: int, totals: dict) -> None:
        units = window // QUANTUM
        self.window, self.units = window, units
        counts = [totals[f"main{i}"] or 0 for i in range(1, units)]
        table = combinations(units)
        repeats = whole_repeats(table, counts)
        self.first_combination = totals["windows"] or 0
        # For each length: segments of ranks, each belonging to one combination.
        self.segments: list[list[tuple[int, int, int, int]]] = [[] for _ in range(units)]
        self.placed = [0] * units
        sequence = self.first_combination
        for j in range(table.shape[1]):
            if not repeats[j]:
                continue
            offset = 0
            for length in range(1, units):
                copies = int(table[length - 1, j])
                if copies:
                    self.segments[length].append((self.placed[length], copies, sequence, offset))
                    self.placed[length] += copies * repeats[j]
                    offset += copies * length * QUANTUM
            sequence += repeats[j]
        left = sum((c - self.placed[i + 1]) * (i + 1) for i, c in enumerate(counts))
        self.mains = Stream(left, units, sequence)
        self.tails = Stream(totals["tails"] or 0, window, sequence + self.mains.sequences)

    def main(self, length: int, rank: int) -> tuple[int, int] | None:
        """Sequence and offset of the main piece of this rank among its length, or None if it
        is one of those left over."""
        if rank >= self.placed[length]:
            return None
        own = self.segments[length]
        begin, copies, sequence, offset = own[_last_at_most(own, rank)]
        repeat, copy = divmod(rank - begin, copies)
        return sequence + repeat, offset + copy * length * QUANTUM


def _last_at_most(segments: list[tuple[int, int, int, int]], rank: int) -> int:
    low, high = 0, len(segments)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if segments[middle][0] <= rank else (low, middle)
    return low


def _placer(plan: Plan):
    def place(docs: pa.Table, begins: pa.Table) -> pa.Table:
        shift = crc_shift(4 * QUANTUM)
        start = begins.to_pylist()[0]
        window_no, tail_at, left_at = start["windows_before"], start["tails_before"], start["left_before"]
        ranks = [0] + [start[f"main{i}_before"] for i in range(1, plan.units)]
        out: list[tuple] = []
        for doc in docs.sort_by("row_no").to_pylist():
            doc_id, tokens = doc["doc_id"], doc["doc_tokens"]
            for i, crc in enumerate(doc["windows"]):
                out.append((doc_id, i * plan.window, plan.window, crc, tokens, window_no, 0, "window"))
                window_no += 1
            begin = len(doc["windows"]) * plan.window
            quanta = doc["quanta"]
            length = len(quanta)
            if length:
                spot = plan.main(length, ranks[length])
                ranks[length] += 1
                if spot:
                    out.append((doc_id, begin, length * QUANTUM, joined_crc(quanta, shift), tokens,
                                *spot, "combination"))
                else:
                    for sequence, offset, at, took in plan.mains.cut(left_at, length):
                        out.append((doc_id, begin + at * QUANTUM, took * QUANTUM,
                                    joined_crc(quanta[at:at + took], shift), tokens, sequence,
                                    offset * QUANTUM, "residual"))
                    left_at += length
                begin += length * QUANTUM
            tail = doc["tail"]
            for sequence, offset, at, took in plan.tails.cut(tail_at, len(tail) // 4):
                out.append((doc_id, begin + at, took, zlib.crc32(tail[4 * at:4 * (at + took)]), tokens,
                            sequence, offset, "tail"))
            tail_at += len(tail) // 4
        names = [field.split()[0] for field in PIECES_SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()]
        columns = zip(*out) if out else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return place


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, kind.

    ``window`` is a power of two and a multiple of QUANTUM.
    """
    units = window // QUANTUM
    rows = staged(tokenized(docs, path, window, end_id)
                  .withColumn("row_no", F.monotonically_increasing_id()), "tokens")
    chunks = shares(rows.count(), CHUNK_DOCUMENTS)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row_no"), F.lit(chunks)))
    lengths = [f"main{i}" for i in range(1, units)]
    counts = staged(rows.groupBy("chunk").agg(
        F.sum(F.size("windows")).alias("windows"),
        F.sum(F.expr("octet_length(tail) div 4")).alias("tails"),
        *[F.count_if(F.size("quanta") == i).alias(f"main{i}") for i in range(1, units)]),
        "token-counts")
    sums = counts.agg(*[F.sum(name).alias(name) for name in ("windows", "tails", *lengths)])
    plan = Plan(window, sums.first().asDict())
    before = prefix_sums(counts, [], "chunk", {f"{name}_before": F.col(name)
                                               for name in ("windows", "tails", *lengths)})
    left = sum((i * (F.greatest(F.col(f"main{i}_before") + F.col(f"main{i}"), F.lit(plan.placed[i]))
                     - F.greatest(F.col(f"main{i}_before"), F.lit(plan.placed[i])))
                for i in range(1, units)), F.lit(0))
    before = prefix_sums(before.withColumn("left", left), [], "chunk", {"left_before": F.col("left")})
    return rows.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInArrow(
        _placer(plan), PIECES_SCHEMA)
