"""Lines that many documents share, found in one sorted stream of hashes.

Every line of a counted length becomes a hash with its document and position. The hashes are dealt
out by ranges of (hash, document), largest document first, and sorted within a range, so the line
that stays is the first one of its hash, and a task walks its range once. Ranges end within a hash
where one is so frequent that it fills tasks; the first and the last hash of a range may therefore
go on in others. Their rows are passed on with the first few documents of the hash in the range,
and judged when these have been brought together: a few rows for each range.

The result are compressed bitmaps, one for each document that loses lines; texts do not move until
somebody applies them.

Cases: a null or empty text is one empty line. Documents are told apart by doc_id: rows with the
same doc_id are one document, and so are all rows without one, which come behind every other.
Repeated rows get the same bitmap. An empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfathom.plans.scale import MAX_BROADCAST_ROWS, join_small

from .common import shares, staged, text_of

#: Lines of so many code points in so many documents are repeats.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
#: Lines in a range, about.
RANGE_LINES = 2_000_000
#: Bytes of texts whose lines are made together.
PART_BYTES = 4 << 20
#: Stands for a null doc_id, below every other.
NO_ID = -(1 << 63)
BLANK = " \t\n\v\f\r"

LINES_SCHEMA = "high long, low long, doc long, row_hash long, position int"
#: ``kind``: a line to drop, a line of an open hash, or a document of an open hash.
WALKED_SCHEMA = LINES_SCHEMA + ", kind string"
DROP, OPEN, HEAD = "drop", "open", "head"


def _line_maker(least: int):
    def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            hashes, rows, positions, held = [], [], [], 0

            def written() -> pa.RecordBatch:
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch["doc"].take(at),
                     batch["row_hash"].take(at), pa.array(positions, pa.int32())],
                    ["high", "low", "doc", "row_hash", "position"])

            for row, text in enumerate(batch["text"]):
                text = text.as_py()
                for position, line in enumerate(text.split("\n")):
                    if len(line) >= least and len(line := line.strip(BLANK)) >= least:
                        # Of bytes, only A-Z are lower-cased.
                        hashes.append(xxhash.xxh3_128_digest(line.encode().lower()))
                        rows.append(row)
                        positions.append(position)
                held += len(text)
                if held > PART_BYTES:
                    yield written()
                    hashes, rows, positions, held = [], [], [], 0
            yield written()
    return line_rows


def _identified(docs: DataFrame) -> DataFrame:
    """With ``doc`` and ``row_hash``, which rows with equal texts of a document share."""
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"),
                       F.xxhash64(text_of()).alias("__row_hash"))


_LINE = np.dtype([("high", "<i8"), ("low", "<i8"), ("doc", "<i8"), ("row_hash", "<i8"), ("position", "<i4")])


class _Walk:
    """A walk along a sorted range: the hash it is in, and the first documents of that hash."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.hash: tuple[int, int] | None = None
        self.first = True  # no other hash came before this one
        self.documents: list[int] = []
        self.held: list[np.ndarray] = []  # lines that wait for enough documents

    def take(self, run: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Lines of one hash, which may be the one the walk is in and may go on."""
        key = int(run["high"][0]), int(run["low"][0])
        if key != self.hash:
            yield from self.end(False)
            self.first = self.hash is None
            self.hash, self.documents, self.held = key, [], []
        if len(self.documents) < self.least:
            docs = run["doc"]
            for doc in docs[np.concatenate([[True], docs[1:] != docs[:-1]])].tolist():
                if len(self.documents) < self.least and doc not in self.documents[-1:]:
                    self.documents.append(doc)
        if self.first:
            yield OPEN, run  # may have begun in the range before
        elif len(self.documents) < self.least:
            self.held.append(run)
        else:
            for part in (*self.held, run):
                yield DROP, part[part["doc"] != self.documents[0]]
            self.held = []

    def end(self, last: bool) -> Iterator[tuple[str, np.ndarray]]:
        """The hash is over; with ``last`` the range is, and the hash may go on in the next one."""
        if self.hash is None or not (self.first or last):
            return
        for part in self.held:
            yield OPEN, part
        heads = np.zeros(len(self.documents), _LINE)
        heads["high"], heads["low"] = self.hash
        heads["doc"] = self.documents
        yield HEAD, heads


def _walker(least: int):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(found: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            lines = np.concatenate([part for _, part in found] or [np.zeros(0, _LINE)])
            kinds = [kind for kind, part in found for _ in range(len(part))]
            return pa.RecordBatch.from_arrays(
                [*[pa.array(np.ascontiguousarray(lines[name])) for name in _LINE.names],
                 pa.array(kinds, pa.string())], [*_LINE.names, "kind"])

        walk = _Walk(least)
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = np.zeros(batch.num_rows, _LINE)
            for name in _LINE.names:
                lines[name] = np.asarray(batch[name])
            new = np.concatenate([[True], (lines["high"][1:] != lines["high"][:-1])
                                  | (lines["low"][1:] != lines["low"][:-1])])
            begins = np.nonzero(new)[0]
            sizes = np.diff(np.append(begins, len(lines)))
            # A hash that begins and ends within the batch, with fewer lines than it takes
            # documents, stays as it is.
            taken = sizes >= least
            taken[0] = taken[-1] = True
            yield written([pair for begin, size in zip(begins[taken].tolist(), sizes[taken].tolist())
                           for pair in walk.take(lines[begin:begin + size])])
        yield written(list(walk.end(True)))
    return walked


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    """Bits of the lines up to the last one dropped, 1 for those that stay, compressed."""
    out = []
    for positions in dropped:
        keep = np.ones(int(max(positions)) // 8 * 8 + 8, bool)
        keep[np.asarray(positions)] = False
        out.append(zlib.compress(np.packbits(keep).tobytes(), 6))
    return pd.Series(out)


def kept_lines(text: str, bitmap: bytes) -> list[str]:
    """The lines of a text that a bitmap keeps; those beyond its end stay."""
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).tolist()
    return [line for line, stays in zip_longest(lines, keep[:len(lines)], fillvalue=True) if stays]


def repeats(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The lines to drop: doc, row_hash, position; a line may be named more than once."""
    found = _identified(docs).select(F.col("__doc").alias("doc"), F.col("__row_hash").alias("row_hash"),
                                     text_of().alias("text"))
    lines = staged(found.mapInArrow(_line_maker(least_length), LINES_SCHEMA), "line-hashes")
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, shares(lines.count(), RANGE_LINES))
    order = [F.col("high"), F.col("low"), F.desc("doc"), F.col("row_hash"), F.col("position")]
    walked = staged(lines.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                    .mapInArrow(_walker(least_documents), WALKED_SCHEMA), "walked-lines")
    judged = (walked.filter(F.col("kind") == HEAD).select("high", "low", "doc").distinct()
              .groupBy("high", "low").agg(F.max("doc").alias("stays"), F.count(F.lit(1)).alias("documents"))
              .filter(F.col("documents") >= least_documents).drop("documents"))
    opened = join_small(walked.filter(F.col("kind") == OPEN), judged, ["high", "low"]).filter("doc <> stays")
    columns = ["doc", "row_hash", "position"]
    return walked.filter(F.col("kind") == DROP).select(*columns).union(opened.select(*columns))


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Documents that lose lines: doc (NO_ID without a doc_id), row_hash (of the text), keep (see
    ``kept_lines``), n_dropped."""
    dropped = repeats(docs, least_length, least_documents).groupBy("doc", "row_hash").agg(
        F.collect_set("position").alias("dropped"))
    return staged(dropped.select("doc", "row_hash", _bitmap("dropped").alias("keep"),
                                 F.size("dropped").cast("long").alias("n_dropped")), "keep-bitmaps")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, most_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """All columns of the documents with ``keep`` and ``n_dropped``, null where all lines stay.

    Texts move only where the bitmaps are more than a task may hold.
    """
    named = bitmaps.select(F.col("doc").alias("__doc"), F.col("row_hash").alias("__row_hash"),
                           F.col("keep").alias("__keep"), F.col("n_dropped").alias("__n_dropped"))
    return join_small(_identified(docs), named, ["__doc", "__row_hash"], "left", max_rows=most_rows)


@F.pandas_udf(T.StringType())
def _kept_sha(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else hashlib.sha256("\n".join(kept_lines(t, b)).encode()).hexdigest()
                      for t, b in zip(texts, bitmaps)])


def digests(docs: DataFrame, most_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    marked = with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")),
                          keep_bitmaps(docs), most_rows)
    # Only texts that lose lines go through Python.
    changed = F.when(F.col("__keep").isNotNull(), F.col("text"))
    return marked.select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("__n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce(_kept_sha(changed, F.col("__keep")), F.sha2("text", 256)).alias("kept_sha256"))


def drop_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The documents with all their columns and what is left of their texts; a null text stays null."""
    @F.pandas_udf("string")
    def left(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else "\n".join(kept_lines(t, b)) for t, b in zip(texts, bitmaps)])

    marked = with_bitmaps(docs, keep_bitmaps(docs, least_length, least_documents))
    return marked.withColumn("text", left("text", "__keep")).select(*docs.columns)
