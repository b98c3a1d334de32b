"""Materialising reduced tables and broadcasting only what was measured to be small."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast up to so many rows and so many bytes of values.
MAX_BROADCAST_ROWS = 250_000
MAX_BROADCAST_BYTES = 64 << 20
#: Rows that one task of a spread input takes at most.
ROWS_PER_TASK = 50_000

_SCOPE = threading.local()


def shared_dir(spark: SparkSession) -> str | None:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return configured or current
    if configured is None:
        if not context.master.startswith("local"):
            return None
        configured = tempfile.mkdtemp(prefix="logfathom-")
    context.setCheckpointDir(configured)
    return configured


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table written on the way to a result."""
    root = shared_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, matches anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def last_number(spark: SparkSession, path: str, key: str = "epoch") -> int | None:
    """The largest number among the folders ``key=<number>`` of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return max((int(status.getPath().getName().split("=")[1]) for status in found), default=None)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes inside are deleted at the end, as a stream would
    otherwise add some with every batch. Results have to be written before."""
    outer = getattr(_SCOPE, "paths", None)
    _SCOPE.paths = paths = []
    try:
        yield
    finally:
        _SCOPE.paths = outer
        for path in paths:
            delete_path(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """A reduced table, written once to the shared folder so that later passes do not repeat its
    lineage. On a cluster without such a folder this is an error."""
    spark = df.sparkSession
    if shared_dir(spark) is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    paths = getattr(_SCOPE, "paths", None)
    if paths is None:
        return df.checkpoint()
    paths.append(work_path(spark, "table"))
    df.write.parquet(paths[-1])
    return spark.read.schema(df.schema).parquet(paths[-1])


def _value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, nested ones by their text."""
    size = F.lit(8 * len(df.columns))
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is expected to be small.

    The side is written once; its rows and bytes are counted meanwhile. It is broadcast when both
    are within bounds; otherwise the join stays a shuffle join, which AQE can split on skewed keys.
    """
    # A retried task can only add to the counts.
    counted = Observation()
    small = materialize(small.observe(counted, F.count(F.lit(1)).alias("rows"),
                                      F.sum(_value_bytes(small)).alias("bytes")))
    if counted.get["rows"] <= max_rows and (counted.get["bytes"] or 0) <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Input dealt out to all cores, and to as many tasks as keep each at ``rows_per_task`` rows.

    Splits follow files and row groups, so one split can hold any share of a table; the heavy
    per-row work that follows would then grow in one task with the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // rows_per_task))
    return df.repartition(tasks)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns that later stages may use many times.

    Catalyst substitutes projected expressions into filters and later projections, and
    stacked stages then grow exponentially. A one-row lateral view is not substituted,
    stays inside whole-stage code generation, and evaluates each column once per row.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
