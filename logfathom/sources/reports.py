"""Stores for incidents and alert lines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scale import join_small, materialize
from ..schema import INCIDENT_META
from .parts import Parts

#: Row groups of documents, so that a fetch decodes little more than what it wants.
_GROUP_BYTES = 8 << 20
_NAME = re.compile(r"^incident_.*\.json$")


#: What is noted of an incident besides its header: the batch and the file that hold its document.
_HEADER = T.StructType([T.StructField("incident_id", T.StringType()), *INCIDENT_META.fields,
                        T.StructField("batch", T.LongType()), T.StructField("file", T.StringType())])


def _document(reports: DataFrame) -> DataFrame:
    """Reports as one JSON text per incident, with the columns of its header."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    body = ["reason", "source", "peak_eps", "peak_wps", "total_lines", "started_at", "ended_at"]
    body += [c for c in ("hourly_trend_errors", "hourly_trend_warns", "signal_history",
                         "full_context") if c in reports.columns]
    return reports.select("incident_id", *INCIDENT_META.names,
                          F.to_json(F.struct(*body), {"timestampFormat": iso}).alias("document"))


def _newest(headers: DataFrame) -> DataFrame:
    """Of each incident what the last batch wrote."""
    names = [c for c in headers.columns if c not in ("source", "incident_id")]
    return (headers.groupBy("source", "incident_id")
            .agg(F.max_by(F.struct(*names), "batch").alias("kept"))
            .select("source", "incident_id", "kept.*"))


def _headers(spark: SparkSession, path: str) -> Parts:
    return Parts(spark, f"{path.rstrip('/')}/headers", _newest, ddl=_HEADER.simpleString()[len("struct<"):-1])


def write_incidents(reports: DataFrame, path: str, batch: int | None = None) -> None:
    """Add reports to an archive: packed documents, and a table of headers that tells their places.

    The documents of a batch are sorted by source and incident into a few Parquet files under
    ``documents``. They count once their headers are committed, so readers see a batch whole or not
    at all. The identity of an incident is its source and id, and the last batch that wrote it wins.
    The newest batch may be written again under its number and then replaces itself; without a number
    a batch takes the next one. An archive has one writer at a time; replaced documents stay on disk.
    """
    spark = reports.sparkSession
    headers = _headers(spark, path)
    batch = headers.next_number() if batch is None else batch
    folder = f"{path.rstrip('/')}/documents/{batch}-{uuid.uuid4().hex}"
    documents = _document(reports).hint("rebalance").sortWithinPartitions("source", "incident_id")
    documents.write.option("parquet.block.size", _GROUP_BYTES).parquet(folder)
    written = spark.read.schema(documents.schema).parquet(folder)
    place = F.concat(F.lit(folder.rsplit("/", 1)[-1] + "/"), F.col("_metadata.file_name"))
    headers.commit(written.select("incident_id", *INCIDENT_META.names, F.lit(batch).cast("long").alias("batch"),
                                  place.alias("file")), batch)


def list_incidents(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Incident headers, newest first. No document is opened."""
    rows = _headers(spark, path).read()
    if source:
        rows = rows.filter(F.col("source") == source)
    shown = F.translate(F.regexp_replace("incident_id", "^incident_", ""), "_", " ")
    return (_newest(rows).select(F.concat("incident_id", F.lit(".json")).alias("filename"),
                                 shown.alias("timestamp"), *INCIDENT_META.names)
            .orderBy(F.col("filename").desc(), F.col("source").desc()))


def get_incident(spark: SparkSession, path: str, name: str, source: str | None = None) -> DataFrame:
    """The full document of an incident as one `document` string; LookupError when there is none.

    Only files that hold a document of that name are opened, and of these the row groups that may:
    one, unless several sources had an incident in the same second.
    """
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    if not _NAME.match(base):
        raise ValueError(f"not an incident name: {name!r}")
    wanted = F.col("incident_id") == base.removesuffix(".json")
    if source:
        wanted = wanted & (F.col("source") == source)
    rows = _newest(_headers(spark, path).read().filter(wanted)).select("source", "file").distinct()
    # At most one name for each source that had an incident in this second.
    places = rows.collect()
    if not places:
        raise LookupError(base)
    files = sorted({row.file for row in places})
    at = F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name"))
    found = (spark.read.parquet(*[f"{path.rstrip('/')}/documents/{file}" for file in files])
             .filter(wanted).select("source", "document", at.alias("file")))
    return found.join(F.broadcast(spark.createDataFrame(places, "source string, file string")),
                      ["source", "file"], "left_semi").select("source", "document")


def fetch_incidents(names: DataFrame, path: str) -> DataFrame:
    """Documents of many incidents, given as (source, filename): (source, filename, document).

    Names without an incident are left out. The documents are read once, with only the files that
    hold a wanted one.
    """
    spark = names.sparkSession
    wanted = names.select("source", F.regexp_replace("filename", "[.]json$", "").alias("incident_id")).distinct()
    headers = join_small(_newest(_headers(spark, path).read()), wanted, ["source", "incident_id"], "left_semi")
    headers = materialize(headers.select("source", "incident_id", "file"))
    files = [row.file for row in headers.select("file").distinct().toLocalIterator()]
    if not files:
        return spark.createDataFrame([], "source string, filename string, document string")
    at = F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name"))
    rows = spark.read.parquet(*[f"{path.rstrip('/')}/documents/{file}" for file in files]).select(
        "source", "incident_id", "document", at.alias("file"))
    return join_small(rows, headers, ["source", "incident_id", "file"], "left_semi").select(
        "source", F.concat("incident_id", F.lit(".json")).alias("filename"), "document")


def write_alerts(lines: DataFrame, path: str, batch: int | None = None) -> None:
    """Add formatted alert or heartbeat lines to the alert log.

    Lines of a numbered batch have a folder of their own, which the same number replaces; lines
    without a number are appended.
    """
    if batch is None:
        lines.select("line").write.mode("append").text(path)
    else:
        lines.select("line").write.mode("overwrite").text(f"{path.rstrip('/')}/batch-{batch}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All lines of an alert log, of batches and appended ones, as `line`."""
    return spark.read.option("recursiveFileLookup", "true").text(path).withColumnRenamed("value", "line")
