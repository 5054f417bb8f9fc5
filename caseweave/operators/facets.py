"""Identifier inventories: facets, and the documents that carry one identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.errors import ValidationError
from caseweave.functions.identifiers import KINDS
from caseweave.operators.pages import page
from caseweave.operators.search import carries, clamp, parse_mention

FACETS_MOST, CARRIERS_MOST = 500, 200


def facets(mentions: DataFrame, casefile: str, kind: str = "", limit: int = 50) -> DataFrame:
    """(kind, value, mentions, documents): an occurrence that two passages share counts once."""
    if kind and kind not in KINDS:
        raise ValidationError(f"unknown kind {kind!r}; known kinds: {', '.join(KINDS)}")
    own = mentions.filter(F.col("casefile_id") == casefile)
    if kind:
        own = own.filter(F.col("kind") == kind)
    # one row for each occurrence, then plain counts: a hot identifier spreads over its documents
    per_document = own.groupBy("kind", "normalised", "document_id", "document_offset").agg(F.lit(1).alias("one")).groupBy("kind", "normalised", "document_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_document.groupBy("kind", F.col("normalised").alias("value")).agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("documents"))
    return counted.orderBy(F.desc("mentions"), "value", "kind").limit(clamp(limit, 1, FACETS_MOST))


def carriers(mentions: DataFrame, documents: DataFrame, casefile: str, mention: str) -> DataFrame:
    """Every document of the casefile that carries an identifier: its occurrences and its earliest passage."""
    kind, value = parse_mention(mention)
    if not value:
        raise ValidationError("an enumeration needs an identifier")
    own = mentions.filter(carries(kind, value, casefile))
    counts = own.groupBy("document_id", "casefile_id").agg(F.countDistinct("document_offset").alias("mentions"))
    # the earliest passage is a minimum, so a document of any number of occurrences combines before its shuffle
    earliest = own.groupBy("document_id", "casefile_id").agg(F.min(F.struct("document_offset", "ordinal", "chunk_id")).alias("first"))
    earliest = earliest.select("document_id", "casefile_id", "first.chunk_id", F.col("first.ordinal").alias("first_ordinal"), F.col("first.document_offset").alias("first_offset"))
    return documents.join(counts, ["document_id", "casefile_id"]).join(earliest, ["document_id", "casefile_id"])


def carriers_page(mentions: DataFrame, documents: DataFrame, casefile: str, mention: str, offset: int = 0, limit: int = 50, order: tuple[str, ...] = ("doc_id", "document_id")):
    """A page of carriers, those with most occurrences first."""
    return page(carriers(mentions, documents, casefile, mention), [F.desc("mentions"), *map(F.asc, order)], offset, clamp(limit, 1, CARRIERS_MOST))
