"""Ranks over a whole table without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.plans.durable import cut

#: monotonically_increasing_id() holds the row of a partition in its lowest 33 bits.
ROW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` in range partitions of ``order``, with ``name``: the row's place in that order, from 0.

    Only the number of rows of each partition meets in one place. Rows that tie
    under ``order`` have neighbouring ranks in any order.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gr_part", F.spark_partition_id()).withColumn("gr_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))))
    sizes = placed.groupBy("gr_part").agg(F.count(F.lit(1)).alias("gr_size"))
    before = sizes.select("gr_part", F.coalesce(F.sum("gr_size").over(Window.orderBy("gr_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gr_before"))
    return placed.join(F.broadcast(before), "gr_part").withColumn(name, F.col("gr_before") + F.col("gr_row")).drop("gr_part", "gr_row", "gr_before")
