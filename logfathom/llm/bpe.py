"""Byte-level BPE by a rank queue, and decoding.

Each match of the splitting pattern is encoded separately. Its bytes form a linked list; every
adjacent pair that has a rank waits in the bucket of that rank. A hierarchical bitmap over the
ranks marks the buckets in use: finding the first set bit at each level gives the lowest rank.
Positions in a bucket are merged from left to right; entries whose pair has changed meanwhile
are stale and skipped. A merge takes constant time, so a match of n bytes takes O(n) steps (and
sorting within buckets), where scanning for the lowest rank takes O(n^2). Short matches share a
queue, so that a bucket is worked off for thousands of them at once; long ones have their own.

Cases: a null text is empty and has no ids; repeated rows are encoded alike; a null doc_id stays
null; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, text_of

#: Encoded matches that a worker remembers; longer ones only for the texts at hand.
REMEMBERED = 250_000
#: Matches of more bytes have a queue of their own, and are not remembered.
LONG = 64
#: Texts whose matches are encoded together.
TOGETHER = 1_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base-64 bytes and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Buckets of positions by rank, under three levels of 64-bit words."""

    def __init__(self, ranks: int) -> None:
        words = -(-max(1, ranks) // 64)
        self.leaves = [0] * words
        self.middle = [0] * -(-words // 64)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.put(rank, [position])

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.leaves[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        top = self.top
        if not top:
            return -1
        high = (top & -top).bit_length() - 1
        word = self.middle[high]
        middle = high << 6 | (word & -word).bit_length() - 1
        word = self.leaves[middle]
        return middle << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The bucket of a rank, which is then gone."""
        leaf, middle = rank >> 6, rank >> 12
        self.leaves[leaf] &= ~(1 << (rank & 63))
        if not self.leaves[leaf]:
            self.middle[middle] &= ~(1 << (leaf & 63))
            if not self.middle[middle]:
                self.top &= ~(1 << middle)
        return self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder over a table of ranks that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.size = max(ranks.values(), default=0) + 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # One object for each id, so that what is remembered stays small.
        self.number = list(range(self.size)).__getitem__
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # Every pair of tokens that is a token: the pair as a number, and its rank.
        self.pairs = {ranks[token[:i]] << 32 | ranks[token[i:]]: rank
                      for token, rank in ranks.items() for i in range(1, len(token))
                      if token[:i] in ranks and token[i:] in ranks}
        self.keys = np.array(sorted(self.pairs) or [-1], np.int64)
        self.key_ranks = np.array([self.pairs.get(k, -1) for k in self.keys.tolist()], np.int64)
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.long: dict[str, tuple[int, ...]] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one match of any length; a bucket is a heap, so that the leftmost goes first."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pairs = RankQueue(self.size), self.pairs.get
        waiting = [pairs(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        for i, rank in enumerate(waiting):
            if rank >= 0:
                queue.push(rank, i)
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            heapify(bucket)
            lowest = rank
            while bucket and lowest >= rank:
                i = heappop(bucket)
                if waiting[i] != rank:
                    continue  # stale: one of its two tokens is part of another by now
                gone = after[i]
                ids[i], waiting[i], waiting[gone] = rank, -1, -1
                after[i] = following = after[gone]
                changed = []
                if following < n:
                    before[following] = i
                    changed.append((i, pairs(rank << 32 | ids[following], -1)))
                if before[i] >= 0:
                    changed.append((before[i], pairs(ids[before[i]] << 32 | rank, -1)))
                for position, new in changed:
                    waiting[position] = new
                    if new == rank:
                        heappush(bucket, position)
                    elif new >= 0:
                        queue.push(new, position)
                        lowest = min(lowest, new)
            if bucket:
                queue.put(rank, bucket)  # a merge made a pair of lower rank, which goes first
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of many matches, all of them under one queue.

        The lowest rank of all matches is the lowest rank of those that have it, so each match
        sees its merges in its own order. A bucket is taken as a whole, and of each match its
        leftmost valid position is merged; as that can make a pair of lower rank, what is left of
        the bucket waits until its rank is the lowest again.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        # One slot more than there are bytes stands for the outside of every match.
        ids = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        match = np.repeat(np.arange(len(pieces)), sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = after[n] = n
        before[ends - sizes] = before[n] = n
        alive = np.ones(n, bool)
        # waiting[i]: the rank under which the pair that begins at i is in the queue now.
        waiting = self._ranks_of(ids, ids[after])
        waiting[n] = -1
        queue = RankQueue(self.size)
        spots = np.nonzero(waiting >= 0)[0]
        spots = spots[np.argsort(waiting[spots], kind="stable")]
        ranks, first = np.unique(waiting[spots], return_index=True)
        for rank, own in zip(ranks.tolist(), np.split(spots, first[1:])):
            queue.put(rank, own.tolist())
        while (rank := queue.first()) >= 0:
            spots = np.unique(np.array(queue.take(rank), np.int64))
            spots = spots[waiting[spots] == rank]  # the others are stale
            lead = np.ones(len(spots), bool)
            lead[1:] = match[spots[1:]] != match[spots[:-1]]
            if not lead.all():
                queue.put(rank, spots[~lead].tolist())
                spots = spots[lead]
            gone = after[spots]
            following, previous = after[gone], before[spots]
            ids[spots], alive[gone], waiting[gone] = rank, False, -1
            after[spots], before[following] = following, spots
            waiting[spots] = self._ranks_of(ids[spots], ids[following])
            waiting[previous] = self._ranks_of(ids[previous], ids[spots])
            waiting[n], before[n] = -1, n
            changed = np.concatenate([spots, previous])
            new = waiting[changed]
            for position, found in zip(changed[new >= 0].tolist(), new[new >= 0].tolist()):
                queue.push(found, position)
        tokens, counts = ids[:n][alive].tolist(), np.bincount(match[alive], minlength=len(pieces))
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [tokens[a:b] for a, b in zip(bounds, bounds[1:])]

    def learn(self, matches: set[str]) -> None:
        """Remember the ids of these matches. Memory is bounded: what was not used since the
        last time it was full goes, and long matches go with the next call."""
        self.long = {}
        if len(self.recent) + len(matches) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        new = []
        for match in matches:
            ids = self.older.get(match)
            if ids is None:
                new.append(match)
            else:
                self.recent[match] = ids
        raw = [m.encode() for m in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        merged = self.merge([raw[i] for i in short]) if short else []
        for i, ids in zip(short, merged):
            self.recent[new[i]] = tuple(map(self.number, ids))
        for match, r in zip(new, raw):
            if len(r) > LONG:
                self.long[match] = tuple(map(self.number, self.merge_long(r)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of whole texts, some texts at a time so that their matches share a queue."""
        for begin in range(0, len(texts), TOGETHER):
            split = [self.split(text) for text in texts[begin:begin + TOGETHER]]
            known = self.recent
            self.learn({m for matches in split for m in matches if m not in known})
            known = self.recent
            for matches in split:
                ids: list[int] = []
                add = ids.extend
                try:
                    for match in matches:
                        add(known[match])
                except KeyError:  # a long match, or one looked up before the memory was renewed
                    ids = [i for m in matches for i in known.get(m) or self.long.get(m) or self.older[m]]
                yield ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def loaded(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file, kept by the worker."""
    return kept(("bpe", path, pattern), lambda: ByteBPE(load_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a rank file that every executor can open.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        written = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids in bpe.encode_all(batch["text"].to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(
                    " ".join(map(written.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
            .mapInArrow(encode, SCHEMA))
