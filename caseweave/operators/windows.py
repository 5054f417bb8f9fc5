"""Windows around search hits, and section islands, over DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import windows as kernel
from caseweave.operators.corpus import passage_text
from caseweave.plans.durable import broadcast_if_small, store


def result_windows(hits: DataFrame, passages: DataFrame, documents: DataFrame, budget: int = kernel.BUDGET) -> DataFrame:
    """``hits(query_id, position, chunk_id)`` with window_start, window_end, narrowed, window_text.

    Each hit gets its neighbours by their ordinals and its document's text; the
    hits of a query (at most a page of them) are served together in rank order.
    Hits are narrow rows, stored and counted: passages and texts of documents
    stream past them where they are few enough to broadcast. Passages without
    ``text`` are what their offsets select.
    """
    hits = store(hits.select("query_id", "position", "chunk_id"))
    named = hits.count()
    texts = [F.col("text").alias("passage")] if "text" in passages.columns else []
    own = ["document_id", "ordinal", "char_start", "char_end", "heading_path", *texts, "chunk_id"]
    found = store(passages.select(*own).join(broadcast_if_small(hits, named), "chunk_id"))
    near = found.select("query_id", "position", "document_id", F.explode(F.sequence(F.col("ordinal") - kernel.RADIUS, F.col("ordinal") + kernel.RADIUS)).alias("ordinal"))
    near = passages.select("document_id", "ordinal", "char_start", "char_end", "heading_path").join(broadcast_if_small(near, named * (2 * kernel.RADIUS + 1)), ["document_id", "ordinal"])
    near = near.groupBy("query_id", "position").agg(F.collect_list(F.struct("ordinal", "char_start", "char_end", "heading_path")).alias("near"))
    wholes = documents.select("document_id", F.col("text").alias("whole")).join(broadcast_if_small(found.select("query_id", "position", "document_id"), named), "document_id").drop("document_id")
    full = found.join(near, ["query_id", "position"]).join(wholes, ["query_id", "position"])
    if not texts:
        full = full.withColumn("passage", passage_text())

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        served = kernel.response([kernel.Hit(r.document_id, r.ordinal, r.char_start, r.char_end, r.heading_path, r.passage, r.whole, [(n["ordinal"], n["char_start"], n["char_end"], n["heading_path"]) for n in r.near]) for r in rows.itertuples()], budget)
        return pd.DataFrame({
            "query_id": rows["query_id"], "position": rows["position"], "chunk_id": rows["chunk_id"],
            "window_start": pd.array([s[0] if s else None for s, _ in served], dtype="Int64"), "window_end": pd.array([s[1] if s else None for s, _ in served], dtype="Int64"),
            "narrowed": [n for _, n in served], "window_text": [w[slice(*s)] if s else None for w, (s, _) in zip(rows["whole"], served, strict=True)],
        })

    kind = dict(hits.dtypes)
    return full.groupBy("query_id").applyInPandas(serve, f"query_id {kind['query_id']}, position {kind['position']}, chunk_id string, window_start long, window_end long, narrowed boolean, window_text string")


def section_islands(passages: DataFrame) -> DataFrame:
    """(document_id, heading_path, island, first_ordinal, last_ordinal, low, high): runs of unbroken ordinals under one trail."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    begins = (F.lag("heading_path").over(order).isNull()) | (F.lag("heading_path").over(order) != F.col("heading_path")) | (F.lag("ordinal").over(order) != F.col("ordinal") - 1)
    island = F.sum(F.when(F.col("begins"), 1).otherwise(0)).over(order)
    runs = passages.withColumn("begins", begins).withColumn("island", island)
    return runs.groupBy("document_id", "heading_path", "island").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.min("char_start").alias("low"), F.max("char_end").alias("high"))
