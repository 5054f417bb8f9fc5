"""What a casefile holds of what it was offered: run totals, breaks, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.plans.durable import cut


def limited() -> Column:
    """Whether a run fell short of what it was offered."""
    return (F.col("items_failed") > 0) | (F.col("entries_refused") > 0) | (F.col("files_without_extractor") > 0) | (F.col("exhausted_by") != "")


def run_totals(runs: DataFrame) -> DataFrame:
    """A row for each casefile: runs, limited runs, and the sums of their counters."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return runs.groupBy("casefile_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(limited()).alias("runs_with_limitations"), *(total(c) for c in ("items_ingested", "items_failed", "entries_refused", "files_without_extractor")))


def bounds_reached(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("exhausted_by") != "").select("casefile_id", "exhausted_by").distinct().orderBy("casefile_id", "exhausted_by")


def continuity_breaks(runs: DataFrame) -> DataFrame:
    """For each casefile, runs that began with more documents than the run before had left.

    Runs lie in range partitions; each compares its own, and the first run of a
    casefile in a partition meets the last one of an earlier partition, of which
    there is one row each. So a casefile of any number of runs spreads out.
    """
    order = ["started_at", "id"]
    placed = runs.select("casefile_id", *order, "documents_before", "documents_after").repartitionByRange("casefile_id", *order)
    placed = cut(placed.withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", "casefile_id").orderBy(*order)
    lagged = placed.withColumn("left", F.lag("documents_after").over(here)).withColumn("nth", F.row_number().over(here))
    ends = placed.groupBy("casefile_id", "part").agg(F.max_by("documents_after", F.struct(*order)).alias("last"))
    before = ends.select("casefile_id", "part", F.lag("last").over(Window.partitionBy("casefile_id").orderBy("part")).alias("left_before"))
    joined = lagged.join(before, ["casefile_id", "part"]).withColumn("left", F.when(F.col("nth") == 1, F.col("left_before")).otherwise(F.col("left")))
    return joined.groupBy("casefile_id").agg(F.count_if(F.col("documents_before") > F.col("left")).alias("continuity_breaks"))


def verdicts(casefiles: DataFrame, runs: DataFrame) -> DataFrame:
    """(casefile_id, verdict, ground, …) of every casefile, also of those without a run.

    A recorded shortfall makes it incomplete. Else it is unknown if there is no
    run, if the record breaks off, or if documents were there before the first
    run (the ground named is the first of these); else complete.
    """
    first = runs.groupBy("casefile_id").agg(F.min_by("documents_before", F.struct("started_at", "id")).alias("documents_before_first_run"))
    known = casefiles.select("casefile_id").join(run_totals(runs), "casefile_id", "left").join(continuity_breaks(runs), "casefile_id", "left").join(first, "casefile_id", "left").fillna(0)
    ground = F.when(F.col("runs") == 0, "no-runs").when(F.col("continuity_breaks") > 0, "continuity-break").when(F.col("documents_before_first_run") > 0, "documents-predate").otherwise("")
    verdict = F.when(F.col("runs_with_limitations") > 0, "incomplete").when(ground != "", "unknown").otherwise("complete")
    return known.withColumn("verdict", verdict).withColumn("ground", F.when(F.col("verdict") == "unknown", ground).otherwise(""))


def statistics(documents: DataFrame) -> DataFrame:
    """For each casefile: documents, those ingested and those expanded, and characters."""
    return documents.groupBy("casefile_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("parent_id").isNull()).alias("documents_ingested"), F.count_if(F.col("parent_id").isNotNull()).alias("documents_expanded"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


def by_media_type(documents: DataFrame) -> DataFrame:
    """(media_type, documents), types that are empty or null together as unknown."""
    return documents.groupBy(F.coalesce(F.nullif("media_type", F.lit("")), F.lit("unknown")).alias("media_type")).agg(F.count(F.lit(1)).alias("documents")).orderBy("media_type")


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def limitations() -> Column:
    """One sentence for each way in which a run fell short, as an array."""
    say = lambda c, one, many: F.when(F.col(c) > 0, counted(F.col(c), one, many))
    return F.array_compact(F.array(
        F.when(F.col("exhausted_by") != "", F.concat(F.lit("expansion stopped at a bound: "), F.col("exhausted_by"))),
        say("items_failed", "offered item failed to be read", "offered items failed to be read"),
        say("entries_refused", "container entry was refused", "container entries were refused"),
        say("files_without_extractor", "offered file has no registered extractor", "offered files have no registered extractor"),
    ))


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """A row for each run of ``outcomes(casefile_id, status, location_label)``: counters, limitations, and whether it was complete."""
    n = lambda status: F.count_if(F.col("status") == status)
    totals = outcomes.groupBy("casefile_id").agg(n("ingested").alias("items_ingested"), n("failed").alias("items_failed"), n("refused").alias("entries_refused"), n("skipped").alias("files_without_extractor"), F.count_if((F.col("status") == "ingested") & (F.col("location_label") == "new")).alias("new_locations"))
    out = totals.withColumn("exhausted_by", F.lit("")).withColumn("limitations", limitations())
    return out.withColumn("complete", F.size("limitations") == 0).drop("exhausted_by")
