"""Changes to tables as set algebra: upserts, replacement, repair, carrying forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.errors import ValidationError

IDENTITY = ["casefile_id", "content_hash", "identity_path"]
#: Columns that a document keeps from when it was first stored.
KEPT = ("id", "created_at", "filename", "containment_path")


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with ``incoming`` by identity: a known document keeps id, creation, name and path, and takes the rest."""
    old, new = (df.select(*IDENTITY, F.struct(*(c for c in existing.columns if c not in IDENTITY)).alias(n)) for df, n in ((existing, "old"), (incoming, "new")))
    both = old.join(new, IDENTITY, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in KEPT else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return both.select(*(F.col(c) if c in IDENTITY else pick(c).alias(c) for c in existing.columns))


def merge_places(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Places by (document_id, location_path), each with its earliest sighting."""
    return existing.unionByName(incoming).groupBy("document_id", "location_path").agg(F.min("first_seen_at").alias("first_seen_at"))


def label_sightings(seen: DataFrame, places: DataFrame, documents: DataFrame) -> DataFrame:
    """``seen(document_id, location_path)`` with how each finds the store: ``first``, ``known``, ``new`` or ``unknown``.

    A document that is not stored yet is seen first; a path of the record is
    known; any other is new where the record reaches back to the document's
    creation, and unknown where it does not.
    """
    oldest = places.groupBy("document_id").agg(F.min("first_seen_at").alias("oldest"))
    here = places.select("document_id", "location_path", F.lit(True).alias("there"))
    stored = documents.select(F.col("id").alias("document_id"), "created_at")
    rows = seen.select("document_id", "location_path").join(stored, "document_id", "left").join(oldest, "document_id", "left").join(here, ["document_id", "location_path"], "left")
    label = F.when(F.col("created_at").isNull(), "first").when(F.col("there"), "known").when(F.col("oldest") <= F.col("created_at"), "new").otherwise("unknown")
    return rows.select("document_id", "location_path", label.alias("label"))


def derive_mentions(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Mentions with document, casefile and offset taken from their passages, whatever their finder said.

    A mention of an unknown passage is an error.
    """
    owner = passages.select("chunk_id", "document_id", "casefile_id", F.col("char_start").alias("chunk_start"))
    if not found.join(owner, "chunk_id", "left_anti").isEmpty():
        raise ValidationError("a mention names a passage that isn't there")
    bare = found.drop("document_id", "casefile_id", "document_offset")
    return bare.join(owner, "chunk_id").withColumn("document_offset", F.col("chunk_start") + F.col("char_start")).drop("chunk_start")


def replace_passages(passages: DataFrame, mentions: DataFrame, document_ids: DataFrame, new_passages: DataFrame, new_mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with everything of some documents replaced."""
    keep = lambda df: df.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")
    return keep(passages).unionByName(new_passages), keep(mentions).unionByName(derive_mentions(new_mentions, new_passages).select(*mentions.columns))


def sidecar_without(vectors: DataFrame, passages: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Rows that hang on passages by ``chunk_id``, without those of some documents' passages."""
    kept = passages.select("chunk_id", "document_id").join(document_ids.select("document_id"), "document_id", "left_anti")
    return vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")


def repair_offsets(mentions: DataFrame, passages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with offsets by where passages truly begin, counts of repaired and stale).

    A passage begins at its recorded start if the document says its text there.
    Rows written before starts were trimmed record a window that opens on white
    space; those are put right. A passage whose text is not there is stale: it
    is counted and left.
    """
    from caseweave.functions.text import lstrip

    at = passages.join(documents.select("document_id", F.col("text").alias("whole")), "document_id")
    here = F.expr("substring(whole, char_start + 1, char_end - char_start)")
    lead = F.length(here) - F.length(lstrip(here))
    says = lambda start: F.substring(F.col("whole"), start + 1, F.length("text")) == F.col("text")
    true_start = F.when(says(F.col("char_start")), F.col("char_start")).when(says(F.col("char_start") + lead), F.col("char_start") + lead)
    starts = at.select("chunk_id", true_start.alias("true_start"))
    joined = mentions.join(starts, "chunk_id").withColumn("fixed", F.coalesce(F.col("true_start") + F.col("char_start"), F.col("document_offset")))
    counts = joined.agg(F.count_if(F.col("fixed") != F.col("document_offset")).alias("repaired"), F.countDistinct(F.when(F.col("true_start").isNull(), F.col("chunk_id"))).alias("stale_passages"))
    return joined.withColumn("document_offset", F.col("fixed").cast("int")).select(*mentions.columns), counts


def carry_forward(places: DataFrame, older: DataFrame, root: str) -> DataFrame:
    """Places that an older record has under ``root`` by relative path, merged in with the earliest sighting of each."""
    from caseweave.functions.text import join_location

    moved = older.select("document_id", join_location(F.lit(root), F.col("relative_path")).alias("location_path"), F.col("seen_at").alias("first_seen_at"))
    return merge_places(places, moved)


def within_budget(items: DataFrame, most_items: int, most_bytes: int, order: str = "doc_id", size: str = "size") -> DataFrame:
    """``items`` in order with ``taken`` and ``exhausted_by``: expansion stops for good at the first bound that an item would pass.

    Both bounds are running totals, so the first item past either is where it stops.
    """
    from caseweave.plans.running import running_total

    counted = running_total(running_total(items.withColumn("bu_one", F.lit(1)), order, "bu_one", "bu_items"), order, size, "bu_bytes").drop("bu_one")
    over = F.when(F.col("bu_items") > most_items, f"more than {most_items} expanded documents").when(F.col("bu_bytes") > most_bytes, f"more than {most_bytes} extracted bytes")
    flagged = counted.withColumn("bu_over", over)
    stop = flagged.filter("bu_over is not null").agg(F.min(F.struct(order, "bu_over")).alias("bu_stop"))
    out = flagged.crossJoin(F.broadcast(stop))  # one row
    return out.withColumn("taken", F.coalesce(F.col(order) < F.col(f"bu_stop.{order}"), F.lit(True))).withColumn("exhausted_by", F.when(~F.col("taken"), F.col("bu_stop.bu_over"))).drop("bu_items", "bu_bytes", "bu_over", "bu_stop")
