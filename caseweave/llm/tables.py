"""Reading the tables, and names of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.plans.scan import read_table as table
from caseweave.plans.scan import spread

__all__ = ["documents", "fresh", "named", "shield", "table"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those of a small file dealt over all cores."""
    return spread(table(spark, sf_dir, "documents"))


def named(column: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col(f"`{column.replace('`', '``')}`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made to differ from all columns of ``df`` (the engine ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """(``df`` under column names in_0, in_1, …; those by the names they had; columns that give the names back)."""
    inner = [f"in_{i}" for i in range(len(df.columns))]
    return df.toDF(*inner), dict(zip(df.columns, inner, strict=True)), [F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True)]
