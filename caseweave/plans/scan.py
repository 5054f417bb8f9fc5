"""Reading tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Inputs of fewer bytes than this may lie in too few row groups to occupy all cores.
SMALL_BYTES = 64 << 20
#: Narrow rows that one task should sort and group at once.
TASK_ROWS = 1 << 19


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores; a larger one has row groups enough and stays as it is.

    A small file is often a single row group, which a single task would read
    and then compute on alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= SMALL_BYTES or df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` in hash partitions of ``key``, so many that each holds about TASK_ROWS rows.

    Rows are counted first, so this is for narrow rows of a table that is cheap
    to read. What a task sorts and groups by ``key`` then stays the same
    however many rows there are.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / TASK_ROWS)), key)
