from pyspark.sql import functions as F

from logfathom.plans.scale import ROWS_PER_TASK, spread


def test_spread_bounds_rows_of_a_task(spark):
    """Input in as many splits as cores still gets tasks of bounded size, however large it is."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, cores * ROWS_PER_TASK * 2 + 7, numPartitions=cores)
    spread_rows = spread(rows)
    sizes = spread_rows.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= ROWS_PER_TASK
    assert spread_rows.count() == cores * ROWS_PER_TASK * 2 + 7
    assert spread_rows.agg(F.sum("id")).first()[0] == rows.agg(F.sum("id")).first()[0]


def test_spread_small_input_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, numPartitions=1)).rdd.getNumPartitions() == cores
