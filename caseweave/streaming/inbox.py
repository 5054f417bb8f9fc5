"""Structured Streaming over an inbox folder: each batch of new files becomes documents.

The stream's checkpoint says which files were taken; a batch writes to a folder
named by its number, and a batch that is run again replaces that folder, so
every file is stored once however often executors or the driver are lost.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseweave.sources import ingest


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, casefile: str, once: bool = False) -> StreamingQuery:
    """Start a stream from ``folder`` to the tables ``out/outcomes`` and ``out/documents``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    at = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

    def take(batch: DataFrame, number: int) -> None:
        work = batch.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(0).alias("depth"), "content")
        found, _ = ingest.expand(work)
        found.write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{out}/outcomes/batch={number}")
        ingest.documents(kept, casefile, at).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
