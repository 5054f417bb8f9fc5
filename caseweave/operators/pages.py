"""Bounded pages under total orders, and point and prefix lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.errors import AmbiguousReferenceError, NotFoundError
from caseweave.plans.ranks import global_rank

OFFSET_MOST = 2**63 - 1
PAGE_MOST, READ_MOST = 200, 20_000


@dataclass(frozen=True)
class Page:
    """A slice of a listing, and where it lies in the whole."""

    rows: DataFrame
    total: int
    offset: int
    limit: int

    @property
    def truncated(self) -> bool:
        return self.offset + self.limit < self.total

    @property
    def continue_from(self) -> int | None:
        return self.offset + self.limit if self.truncated else None

    @property
    def beyond_the_end(self) -> bool:
        return self.total > 0 and self.offset >= self.total


def clamped(offset: int, limit: int, most: int = PAGE_MOST) -> tuple[int, int]:
    return max(0, min(int(offset), OFFSET_MOST)), max(1, min(int(limit), most))


def slice_rows(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order."""
    if offset > 2**31 - 1 - limit:  # past what the engine's own offset can say
        ranked = global_rank(df, order, "page_rank")
        return ranked.filter(F.col("page_rank").between(offset, min(offset + limit - 1, OFFSET_MOST))).orderBy(*order).drop("page_rank")
    return df.orderBy(*order).offset(offset).limit(limit).orderBy(*order) if offset else df.orderBy(*order).limit(limit)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50, most: int = PAGE_MOST) -> Page:
    """Count and page under one predicate, that of ``df``."""
    offset, limit = clamped(offset, limit, most)
    return Page(slice_rows(df, order, offset, limit), df.count(), offset, limit)


def select_documents(documents: DataFrame, parent: str | None = None, expanded: bool = False) -> tuple[DataFrame, list[Column], str]:
    """The documents of a listing, their order, and its name: children of a parent, all, or those ingested."""
    if parent is not None:
        return documents.filter(F.col("parent_id") == parent), [F.asc(c) for c in ("containment_path", "created_at", "id")], "children"
    rows = documents if expanded else documents.filter(F.col("parent_id").isNull())
    return rows, [F.desc("created_at"), F.asc("containment_path"), F.asc("id")], "all" if expanded else "ingested"


def every_document(documents: DataFrame, wide: list[str] | None = None) -> DataFrame:
    """All documents in their order of listing, without a bound: for exports and maintenance, not for pages."""
    rows, order, _ = select_documents(documents, expanded=True)
    return (rows if wide is None else rows.select("id", "parent_id", "containment_path", "created_at", *wide)).orderBy(*order)


def casefile_listing(casefiles: DataFrame) -> DataFrame:
    """Casefiles, the newest first."""
    return casefiles.orderBy(F.desc("created_at"), "id")


def document_ids(documents: DataFrame) -> DataFrame:
    """The ids of documents by (created_at, id); a scan of narrow columns alone."""
    return documents.select("created_at", "id").orderBy("created_at", "id").select("id")


def document_passages(passages: DataFrame, document_id: str) -> DataFrame:
    """Every passage of a document by ordinal."""
    return passages.filter(F.col("document_id") == document_id).orderBy("ordinal")


def document_page(documents: DataFrame, wide: list[str], parent: str | None = None, expanded: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of documents with ``child_count``: chosen on narrow columns, which then fetch the wide ones."""
    offset, limit = clamped(offset, limit)
    rows, order, _ = select_documents(documents, parent, expanded)
    chosen = slice_rows(rows.select("id", "parent_id", "containment_path", "created_at"), order, offset, limit)
    children = documents.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("of")).agg(F.count(F.lit(1)).alias("child_count"))
    few = F.broadcast(chosen)  # at most PAGE_MOST rows
    out = few.join(documents.select("id", *wide), "id").join(children.join(F.broadcast(chosen.select(F.col("id").alias("of"))), "of", "left_semi"), F.col("id") == F.col("of"), "left")
    return out.withColumn("child_count", F.coalesce("child_count", F.lit(0))).drop("of").orderBy(*order)


def passage_page(passages: DataFrame, document_id: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    """References to a document's passages, without their texts."""
    offset, limit = clamped(offset, limit)
    rows = passages.filter(F.col("document_id") == document_id).select("chunk_id", "document_id", "ordinal", "heading_path", "char_start", "char_end", F.length("text").alias("characters"))
    return slice_rows(rows, [F.asc(c) for c in ("ordinal", "char_start", "chunk_id")], offset, limit)


def neighbours(passages: DataFrame, radius: int) -> DataFrame:
    """(document_id, ordinal, neighbour): passages within ``radius`` ordinals.

    A join on the neighbour's own ordinal: each passage names the few ordinals
    it is near, so no document is paired with itself as a whole.
    """
    near = F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius))
    asked = passages.select("document_id", "ordinal", near.alias("neighbour"))
    return asked.join(passages.select("document_id", F.col("ordinal").alias("neighbour")), ["document_id", "neighbour"]).select("document_id", "ordinal", "neighbour")


def with_prefix(df: DataFrame, column: str, prefix: str, casefile: str | None = None) -> DataFrame:
    """Rows whose id begins with ``prefix`` (no wildcards, case ignored), in order."""
    out = df if casefile is None else df.filter(F.col("casefile_id") == casefile)
    return out.filter(F.lower(column).startswith(prefix.lower())).orderBy(column)


def resolve(df: DataFrame, reference: str, column: str = "id", slug: str | None = None):
    """The row that a reference names: exactly, by slug, or as the only one with that prefix."""
    for c in [column, *([slug] if slug else [])]:
        if rows := df.filter(F.col(c) == reference).limit(1).collect():
            return rows[0]
    rows = with_prefix(df, column, reference).limit(2).collect() if reference else []
    if len(rows) > 1:
        raise AmbiguousReferenceError(f"{reference!r} names more than one")
    if not rows:
        raise NotFoundError(f"nothing is named {reference!r}")
    return rows[0]


def bounded_read(documents: DataFrame, offset: int, n: int) -> DataFrame:
    """(doc_id, text, characters, truncated, continue_from): ``n`` characters of each text from ``offset``."""
    offset, n = clamped(offset, n, READ_MOST)
    size = F.length("text")
    more = F.lit(offset + n) < size
    return documents.select("doc_id", F.substring("text", offset + 1, n).alias("text"), size.alias("characters"), more.alias("truncated"), F.when(more, F.lit(offset + n)).cast("long").alias("continue_from"))
