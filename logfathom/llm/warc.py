"""WARC archives written and read by Spark, and their index by an external merge.

Writing: a record is one line of Spark's text sink whose line separator is the end of a WARC
record, so the files are committed and retried as Spark does it, on any file system it knows.
Of records with equal payloads the one with the largest page_id is a response and the others
are revisits that refer to it.

Reading: a task streams through an archive, cut at the separator, and puts records together by
their Content-Length, so it holds a record at a time and archives may be of any size. The captures of an archive
are sorted by (URL key, time, page_id, copy): a run. Runs are cut into ranges of that order, and in
each range a loser tree merges the pieces of the runs into one globally ordered history.
Different payloads of one page_id (or of none) share a record id, so a revisit finds its response by
id and digest.

Cases: a null html is an empty payload; empty payloads are equal to each other; a null url gives
the URL key "-" and no WARC-Target-URI; line ends in a url are escaped; rows with a null page_id
lose against any other and are named "null" in their record. Repeated rows are records of their
own: one of them is the response. An empty table gives an empty result. Only ``page_id``, ``url``
and ``html`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.plans.scale import compute_once, work_path

from .common import shares, staged, text_of

#: Records in an archive, at most: their captures are sorted by one task.
ARCHIVE_RECORDS = 5_000
#: Captures that one task merges, about.
RANGE_CAPTURES = 20_000
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ_SCHEMA = ("archive string, offset long, page_id long, copy long, url string, "
               "url_key string, at string, record_type string, payload_bytes long, "
               "payload_digest string, record_id string, refers_id string")
READ_ARROW = pa.schema([(name, pa.int64() if kind == "long" else pa.string())
                        for name, kind in map(str.split, READ_SCHEMA.split(", "))])
NO_ID = -(1 << 63)


def base32(hexed: Column) -> Column:
    """A SHA-1 in hex as upper-case base 32: eight pieces of 20 bits, four letters each."""
    out = []
    for i in range(8):
        piece = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(piece, 15 - 5 * j).bitwiseAND(31) + 1,
                            F.lit(1)) for j in range(4)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query: com,example)/a?b=1 (SURT order)."""
    bare = F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^.*@|:\d+$", "")
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"^$", "/")
    return F.coalesce(F.concat(labels, F.lit(")"), rest), F.lit("-"))


def typed(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, record type and the record each revisit refers to.

    Only digests are grouped. The payloads move once, to meet their group, and are dealt into
    archives by that same shuffle. Repeated rows (same page_id and html) are numbered as copies.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"),
                        F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    # Joins ask whether their keys are null; the digest must not be made anew for each of its letters.
    rows = compute_once(rows, sha=F.sha1(F.col("html").cast("binary")), bytes=F.octet_length("html"))
    rows = compute_once(rows, digest=base32(F.col("sha"))).drop("sha")
    narrow = staged(rows.select("page", "digest", "bytes"), "payload-digests")
    winners = narrow.groupBy("digest", "bytes").agg(F.max("page").alias("win"))
    marks = narrow.distinct().join(winners, ["digest", "bytes"]).select("page", "digest", "win")
    copies = Window.partitionBy("page", "digest").orderBy("url")
    return (rows.join(marks, ["page", "digest"])
            .withColumn("copy", F.row_number().over(copies))
            .withColumn("revisit", (F.col("page") != F.col("win")) | (F.col("copy") > 1)))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record() -> Column:
    """Header and payload of a record, without the line ends that follow it.

    A revisit has no body: its payload is that of the record it refers to.
    """
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def name(page: Column, copy: Column) -> Column:
        number = F.when(page == NO_ID, "null").otherwise(page.cast("string"))
        return F.concat(F.lit("<urn:page:"), number, F.lit(":"), copy.cast("string"), F.lit(">"))

    # Pages carry no time of capture; the number of the page stands for its second.
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("page", F.lit(10 ** 9))),
                       "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("revisit")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("page"), F.col("copy"))),
        _line("WARC-Date", at),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", uri)).otherwise(""),
        _line("X-URL-Key", F.regexp_replace(url_key(F.col("url")), "[\r\n]", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            _line("WARC-Refers-To", name(F.col("win"), F.lit(1))))).otherwise(""),
        F.lit("Content-Type: text/html\r\n"),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"))
    return F.concat(head, F.when(revisit, "").otherwise(F.col("html")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write what ``typed`` returns as gzip archives; a partition is an archive or several."""
    (pages.select(record().alias("value")).write.option("lineSep", END)
     .option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path))


def parse_archive(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record of an archive that was cut at every ``END``.

    A payload may hold the separator, or line ends that make one with it, so cuts say nothing about
    records: pieces are put together again as far as the record at hand goes. Offsets are those of
    the uncompressed archive.
    """
    end, at, have = END.encode(), 0, bytearray()
    stream = (piece + end for piece in pieces)

    def more() -> None:
        piece = next(stream, None)
        if piece is None:
            raise ValueError(f"the record at byte {at} is cut off")
        have.extend(piece)

    for piece in stream:
        have.extend(piece)
        while have:
            while (split := have.find(end)) < 0:
                more()
            # Behind a last piece that no separator ended, one too many was put.
            if not split and next(stream, None) is None:
                return
            version, *lines = have[:split].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no record at byte {at}")
            headers = dict(line.split(": ", 1) for line in lines)
            begin = split + len(end)
            stop = begin + int(headers["Content-Length"])
            while len(have) < stop + len(end):
                more()
            if have[stop:stop + len(end)] != end:
                raise ValueError(f"the record at byte {at} does not end where it says")
            yield at, headers, bytes(have[begin:stop])
            at += stop + len(end)
            del have[:stop + len(end)]


def _capture(archive: str, offset: int, h: dict[str, str], payload: bytes) -> dict:
    digest, full = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if h["WARC-Type"] == "response":
        full = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{archive}: payload at byte {offset} is not what was written")
    page, copy = h["WARC-Record-ID"][len("<urn:page:"):-1].split(":")
    return {"archive": archive, "offset": offset, "url": h.get("WARC-Target-URI"),
            "page_id": None if page == "null" else int(page), "url_key": h["X-URL-Key"],
            "copy": int(copy), "at": h["WARC-Date"], "record_id": h["WARC-Record-ID"],
            "record_type": h["WARC-Type"], "payload_bytes": full, "payload_digest": digest,
            "refers_id": h.get("WARC-Refers-To")}


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = ((path, piece) for batch in batches
              for path, piece in zip(batch["path"].to_pylist(), batch["piece"].to_pylist()))
    # A task reads one archive after the other, each from its beginning to its end.
    for path, of_archive in groupby(pieces, key=itemgetter(0)):
        archive = path.rsplit("/", 1)[-1]
        found = [_capture(archive, *record) for record in parse_archive(map(itemgetter(1), of_archive))]
        # A run: the captures of one archive in the order of the index.
        yield pa.RecordBatch.from_pylist(sorted(found, key=_order), READ_ARROW)


def _order(capture: dict) -> tuple:
    return (capture["url_key"], capture["at"],
            NO_ID if capture["page_id"] is None else capture["page_id"], capture["copy"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under a path, each archive a sorted run."""
    pieces = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_read, READ_SCHEMA)


def merge_runs(runs: Sequence[Sequence[tuple]]) -> Iterator[tuple[tuple, int]]:
    """Merge sorted runs by a tree of losers: (entry, number of its run) in order.

    An inner node keeps the loser of the match below it and sends the winner up. When the
    overall winner leaves, only the matches on its own path are played again.
    """
    k = len(runs)
    iterators = [iter(run) for run in runs]
    heads: list = [next(it, None) for it in iterators]

    def beats(a: int, b: int) -> bool:
        """Whether the head of run a goes before that of run b; spent runs go last."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [0] * k  # losers[1:] are the inner nodes; leaf i is node k + i

    def play(node: int) -> int:
        if node >= k:
            return node - k
        left, right = play(2 * node), play(2 * node + 1)
        won, lost = (left, right) if beats(left, right) else (right, left)
        losers[node] = lost
        return won

    winner = play(1) if k > 1 else 0
    while k and heads[winner] is not None:
        yield heads[winner], winner
        heads[winner] = next(iterators[winner], None)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    rows: list[dict] = []
    for batch in batches:
        for capture in batch.to_pylist():
            runs.setdefault(capture["archive"], []).append((*_order(capture), len(rows)))
            rows.append(capture)
    # Shuffled pieces of a run mostly arrive in its order, and sorting them is then linear.
    pieces = [sorted(piece) for _, piece in sorted(runs.items())]
    out = [rows[entry[-1]] | {"position": i} for i, (entry, _) in enumerate(merge_runs(pieces))]
    yield pa.RecordBatch.from_pylist(out, READ_ARROW.append(pa.field("position", pa.int64())))


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in the order (URL key, time, record): ``range_no`` and ``position`` in it.

    Ranges are split at sampled keys down to single records, so a URL or host that a third of
    the captures share still goes to many tasks.
    """
    ranges = shares(runs.count(), RANGE_CAPTURES)
    return (runs.repartitionByRange(ranges, "url_key", "at", "page_id", "copy")
            .mapInArrow(_merge, f"{READ_SCHEMA}, position long").withColumn("range_no", F.spark_partition_id()))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as WARC archives, read them back and index them.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, archive,
    offset, range_no, position.
    """
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write_archives(typed(pages), path)
    index = staged(merged_index(staged(read_archives(spark, path), "runs")), "warc-index")
    responses = index.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), "payload_digest", F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"))
    return index.join(responses, ["refers_id", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to", "url_key", "archive", "offset", "range_no",
        "position")
