"""Reading raw log lines, in batch and as a stream."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.scale import path_exists

SAMPLE_LINES = 10
#: Files up to this size are scanned whole for their heads; of a larger one a task reads the beginning.
HEAD_BYTES = 1 << 20
_ROW_BITS = (1 << 33) - 1


def split_paths(paths: str | list[str]) -> list[str]:
    """Paths of a comma-separated list, stripped, empty ones skipped."""
    parts = paths.split(",") if isinstance(paths, str) else list(paths)
    found = [p.strip() for p in parts if p.strip()]
    if not found:
        raise ValueError("no log paths given")
    return found


def source_folder(c="source") -> Column:
    """Last folder of a path: the source of a log that is kept as a folder of rotated segments.

    A ``name=`` prefix, as partitioned writes leave it, is dropped.
    """
    folder = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/]*)/[^/]*$", 1)
    return F.regexp_replace(folder, "^[A-Za-z_]+=", "")


def _position() -> Column:
    """Arrival position of a line within its file.

    Splits of one file start at multiples of the split size and hold fewer lines
    than bytes, so split start plus row number keeps the order of the file.
    """
    return (F.col("_metadata.file_block_start")
            + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))


def _tag(lines: DataFrame, seq: Column) -> DataFrame:
    return (lines.select(F.col("_metadata.file_path").alias("source"),
                         strip("value").alias("line"),
                         seq.alias("seq"),
                         F.col("_metadata.file_modification_time").alias("ingest_ts"))
                 .filter(F.col("line") != ""))


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, line, seq, ingest_ts) of every non-blank line; the source is the file."""
    return _tag(spark.read.text(split_paths(paths)), _position())


def stream_logs(spark: SparkSession, path: str, start_after: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the lines of new files under a folder (or the folders a pattern matches).

    A file is read once, when it is complete; producers rotate files. With
    `start_after` only files changed at or after that time count. Nothing is
    dropped under load: `max_files_per_trigger` bounds a batch instead.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(path)
    if start_after is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time")
                             >= F.lit(start_after).cast("timestamp"))
    # A stream has no row numbers; events take their order from their time (`order_by_time`).
    return _tag(lines, F.lit(None).cast("bigint"))


def head_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first n non-blank lines of a file, of which no more is read than a buffer beyond them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        text = jvm.java.io.InputStreamReader(
            stream if codec is None else codec.createInputStream(stream), "UTF-8")
        reader, found = jvm.java.io.BufferedReader(text), []
        while len(found) < n and (line := reader.readLine()) is not None:
            if line.strip():
                found.append(line.strip())
        return found
    finally:
        stream.close()


def file_heads(spark: SparkSession, files: list[str], n: int = SAMPLE_LINES) -> dict[str, tuple[int, int]]:
    """Of each file, named as `inputFiles` does: how many of its first n non-blank lines there are, and how many of these begin
    with a brace. Tasks read the files; the driver opens none.

    Files up to HEAD_BYTES share the tasks of one scan. A larger one has a task of its own, which is a
    limit over a single split and so ends at the n-th line that is not blank.
    """
    if not files:
        return {}
    mark = F.substring(strip("value"), 1, 1).alias("mark")
    lines = spark.read.text([unquote(f) for f in files]).filter(F.col("_metadata.file_size") <= HEAD_BYTES).select(
        F.col("_metadata.file_path").alias("path"), _position().alias("at"), mark).filter("mark <> ''")
    first = lines.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("at"))) \
                 .filter(F.col("rank") <= n)
    found = {r.path: (r.lines, r.json) for r in first.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("mark") == "{").alias("json")).collect()}
    # A session of its own, in which a file is one split, whatever its size.
    own = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", str(1 << 50))

    def beginning(path: str) -> tuple[int, int]:
        marks = [r.mark for r in own.read.text(unquote(path)).select(mark).filter("mark <> ''").limit(n).collect()]
        return len(marks), marks.count("{")

    rest = [path for path in files if path not in found]
    with ThreadPoolExecutor(8) as pool:
        return found | dict(zip(rest, pool.map(beginning, rest)))


def detect_sources(spark: SparkSession, paths: str | list[str], source=None) -> DataFrame:
    """(source, format) of log files by their first ten non-blank lines, for `parse_logs`.

    Sources of several files are voted on by the first file in the order of names. `source` is as in
    `stream_events`.
    """
    files = sorted(spark.read.text(split_paths(paths)).inputFiles())
    named = spark.createDataFrame([(f, f) for f in files], "path string, source string")
    if source is not None:
        named = named.withColumn("source", source("source"))
    first = {r.source: r.path for r in named.groupBy("source").agg(F.min("path").alias("path")).collect()}
    heads = file_heads(spark, sorted(first.values()))
    formats = [(name, "json" if heads[path][1] > heads[path][0] // 2 else "text") for name, path in first.items()]
    return spark.createDataFrame(formats, "source string, format string")
