"""Arrow functions over texts, with batches bounded by bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: What one batch may hold, where the session leaves the engine's own defaults (10,000 rows, 64 MB).
BATCH = {ROWS: ("10000", "2000"), BYTES: ("67108864", str(8 << 20))}


def bound_batches(spark: SparkSession | None = None) -> None:
    """Smaller batches for this session, unless it has set its own: rows that hold whole texts are large."""
    spark = spark or SparkSession.active()
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name, default).rstrip("b") == default:
            spark.conf.set(name, ours)


def text_udf(kind):
    """Like ``arrow_udf``, over batches that stay small on both sides of the process boundary."""
    bound_batches()
    return F.arrow_udf(kind)
