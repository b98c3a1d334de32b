"""Row shapes used throughout the library."""

from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ingest_ts", T.TimestampType()),
])

# `seq` is the arrival position of a line within its source.
EVENT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("ingest_ts", T.TimestampType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
])

PARSED = "struct<event_ts: timestamp, level: string, message: string>"

# The only columns an incident listing reads; the large arrays stay on disk.
INCIDENT_META = T.StructType([
    T.StructField("reason", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("peak_eps", T.DoubleType()),
    T.StructField("peak_wps", T.DoubleType()),
    T.StructField("total_lines", T.LongType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("ended_at", T.StringType()),
])
