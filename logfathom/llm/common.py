"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.plans.scale import work_path

Kept = TypeVar("Kept")


_KEPT: dict[tuple, object] = {}


def release() -> None:
    """Give memory that is no longer used back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def kept(key: tuple, make: Callable[[], Kept]) -> Kept:
    """What a worker keeps from task to task (a tokenizer, a memory), until another is asked for.

    Workers serve one stage after the other, so what an earlier operator kept goes.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder all executors share and read it again.

    Later passes then neither repeat its lineage nor depend on the executors that made it.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shares(rows: int, per_share: int) -> int:
    """Number of shares that hold about ``per_share`` rows each."""
    return max(1, -(-rows // per_share))


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Sum what comes before each row of a reduced table, in the order given.

    With ``keys`` empty all rows pass one task, so the table has to be a reduced one: a row for
    each chunk of tens of thousands of rows.
    """
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[(F.sum(value).over(window) - value).alias(name)
                            for name, value in values.items()])
