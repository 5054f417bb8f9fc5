"""Running totals over a whole table without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.plans.durable import cut


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with each row, by ``order`` (unique).

    Range partitions sum their own rows; the totals of partitions before, one
    row for each, are added.
    """
    placed = cut(df.repartitionByRange(F.col(order)).withColumn("rt_part", F.spark_partition_id()))
    totals = placed.groupBy("rt_part").agg(F.sum(value).alias("rt_sum"))
    before = totals.select("rt_part", F.coalesce(F.sum("rt_sum").over(Window.orderBy("rt_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rt_before"))
    inside = F.sum(value).over(Window.partitionBy("rt_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("rt_inside", inside).join(F.broadcast(before), "rt_part").withColumn(name, F.col("rt_before") + F.col("rt_inside")).drop("rt_part", "rt_inside", "rt_before")
