"""Ingest: files to documents, level by level through containers.

A level is one DataFrame of (path, content): routed, read and hashed in one
pass over Arrow batches, its containers' children being the next level, until
none is left or the budget ends it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.errors import ExtractionError
from caseweave.functions.arrow import bound_batches
from caseweave.functions.text import join_location, stable_id
from caseweave.plans.durable import discard, store
from caseweave.sources import readers

# Bounds of one expansion.
DEPTH_MOST, ITEMS_MOST, BYTES_MOST = 8, 50_000, 20 << 30
BOUNDLESS = (1 << 63) - 1

WORK = "path string, parent_path string, depth int, content binary, named_directly boolean, reason string"
OUTCOME = "path string, parent_path string, depth int, status string, reason string, text string, media_type string, extractor string, text_source string, content_hash string, byte_size long, is_container boolean, refusals array<string>"
OUT_SCHEMA = pa.schema([("path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int32()), ("status", pa.string()), ("reason", pa.string()), ("text", pa.string()), ("media_type", pa.string()), ("extractor", pa.string()), ("text_source", pa.string()), ("content_hash", pa.string()), ("byte_size", pa.int64()), ("is_container", pa.bool_()), ("refusals", pa.list_(pa.string()))])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local files, one at a time, up to a byte beyond what a file may have."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path.removeprefix("file://"), "rb") as f:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read(readers.ENTRY_MOST + 1)], pa.binary())], names=["path", "content"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` (or the one file, which is then named directly), with its path relative to it.

    Links, and names that the engine passes over (a leading dot or underscore),
    are looked for where the root is a local folder: links are refused, hidden
    files are read.
    """
    base, links, hidden = root.rstrip("/"), [], []
    local = re.sub("^file:/*", "/", base)
    if "://" not in local and os.path.isdir(local):
        for folder, folders, files in os.walk(local):
            below = [os.path.join(folder, x) for x in (*folders, *files)]
            links += [x for x in below if os.path.islink(x)]
            concealed = any(part[0] in "._" for part in os.path.relpath(folder, local).split("/") if part != ".")
            hidden += [x for x in below if os.path.isfile(x) and not os.path.islink(x) and (concealed or os.path.basename(x)[0] in "._")]
    read = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = read(root).select("path", "content")
    if hidden:
        found = found.unionByName(spark.createDataFrame([(f"file://{x}",) for x in hidden], "path string").repartition(len(hidden) // 64 + 1).mapInArrow(_opened, "path string, content binary"))
    start = local if "://" not in local else base
    relative = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(start) + 1})")
    name, inside = F.element_at(F.split("path", "/"), -1), F.length(relative) > 1
    rows = found.select(F.when(inside, F.regexp_replace(relative, "^/", "")).otherwise(name).alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(0).alias("depth"), "content", (~inside).alias("named_directly"), F.lit(None).cast("string").alias("reason"))
    if not links:
        return rows
    refused = spark.createDataFrame([(os.path.relpath(x, local), None, 0, None, False, "a link is not followed") for x in links], WORK)
    linked = refused.select(F.col("path").alias("link"))
    through = (F.col("path") == F.col("link")) | F.col("path").startswith(F.concat("link", F.lit("/")))
    return rows.join(F.broadcast(linked), through, "left_anti").unionByName(refused)


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            content = r["content"] or b""
            row = dict.fromkeys(OUT_SCHEMA.names) | {k: r[k] for k in ("path", "parent_path", "depth")} | {"refusals": [], "is_container": False, "byte_size": len(content), "content_hash": hashlib.sha256(content).hexdigest()}
            try:
                if r["reason"]:
                    raise ExtractionError(r["reason"])
                got = readers.read(r["path"].rsplit("/", 1)[-1], content)
                row |= {"status": "ingested", "text": got.text, "media_type": got.media_type, "extractor": got.extractor, "text_source": got.text_source, "is_container": got.is_container, "refusals": got.refusals}
            except ExtractionError as e:
                # what nothing reads is refused in a container, skipped in a folder, and failed where it was named itself
                unread = str(e) == "no registered extractor"
                refused = r["parent_path"] and (unread or r["reason"])
                row |= {"reason": str(e), "status": "refused" if refused else "skipped" if unread and not r["named_directly"] else "failed"}
            except Exception as e:  # a reader that trips over a damaged file fails that file
                row |= {"reason": f"{type(e).__name__}: {e}", "status": "failed"}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=OUT_SCHEMA)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of containers, one at a time; those that can't be had with the reason."""
    schema = pa.schema([("path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int32()), ("content", pa.binary()), ("named_directly", pa.bool_()), ("reason", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            for i, (name, data) in enumerate(() if r["reason"] else readers.children(r["path"].rsplit("/", 1)[-1], r["content"] or b"")):
                lost = isinstance(data, ExtractionError)
                own = {"path": f"{r['path']}/{name or i}", "parent_path": r["path"], "depth": r["depth"] + 1, "content": None if lost else data, "named_directly": False, "reason": str(data) if lost else None}
                yield pa.RecordBatch.from_pylist([own], schema=schema)


def outcomes(files: DataFrame) -> DataFrame:
    """The outcome of every file of one level."""
    bound_batches(files.sparkSession)
    return files.select("path", "parent_path", "depth", "content", "named_directly", "reason").mapInArrow(_outcomes, OUTCOME)


def expand(files: DataFrame, depth_most: int = DEPTH_MOST, items_most: int | None = ITEMS_MOST, bytes_most: int | None = BYTES_MOST) -> tuple[DataFrame, str]:
    """(outcomes of files and all that they hold, the bound that stopped it or ""), breadth first.

    Levels are written to the shared folder and go when the next is read; an
    expansion stops at whole items, in order of path, when a bound would be
    passed. Entries that can't be had count for no bound. The bounds of items
    and bytes are for what strangers packed; a caller that knows its archives
    gives None for either, and all of them are expanded.
    """
    items_most, bytes_most = (BOUNDLESS if most is None else most for most in (items_most, bytes_most))
    for name, kind in (("named_directly", "boolean"), ("reason", "string")):
        files = files if name in files.columns else files.withColumn(name, F.lit(None).cast(kind))
    level, done, spent_items, spent_bytes, stopped = store(files), [], 0, 0, ""
    while True:
        done.append(store(outcomes(level)))
        below = store(level.mapInArrow(_children, WORK))
        discard(level)
        held = F.when(F.col("reason").isNull(), F.length("content"))
        rows, n, size, depth = below.agg(F.count(F.lit(1)), F.count(held), F.coalesce(F.sum(held), F.lit(0)), F.max("depth")).first()
        if not rows:
            break
        if depth > depth_most:
            stopped = f"nesting deeper than {depth_most} levels"
            break
        if spent_items + n > items_most or spent_bytes + size > bytes_most:
            from caseweave.operators.records import within_budget

            part = within_budget(below.filter("reason is null").select("path", F.length("content").cast("long").alias("size")), items_most - spent_items, bytes_most - spent_bytes, order="path")
            bound = part.filter("not taken").select("exhausted_by").first()[0]
            stopped = f"more than {items_most} expanded documents" if bound.endswith("documents") else f"more than {bytes_most} extracted bytes"
            taken = below.join(part.filter("taken").select("path"), "path", "left_semi").unionByName(below.filter("reason is not null"))
            done.append(store(outcomes(taken)))
            break
        spent_items, spent_bytes, level = spent_items + n, spent_bytes + size, below
    discard(below)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, stopped


def identified(found: DataFrame, casefile: str) -> DataFrame:
    """Ingested outcomes with their document's id: by content, and for expanded ones by path too."""
    identity = F.when(F.col("parent_path").isNull(), "").otherwise(F.col("path"))
    kept = found.filter("status = 'ingested'").withColumn("identity_path", identity)
    return kept.withColumn("id", stable_id(F.lit(casefile), F.col("content_hash"), F.col("identity_path")))


def sightings(found: DataFrame, casefile: str, root: str) -> DataFrame:
    """(document_id, location_path): every place at which a document was read, also those of its copies."""
    return identified(found, casefile).select(F.col("id").alias("document_id"), join_location(F.lit(root), F.col("path")).alias("location_path")).distinct()


def documents(found: DataFrame, casefile: str, at: str) -> DataFrame:
    """Documents of ingested outcomes, copies of one folder being one: that of the first path."""
    kept = identified(found, casefile)
    first = kept.groupBy("id").agg(F.min("path").alias("path"))
    by_path = kept.select(F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    return kept.join(first, ["id", "path"], "left_semi").join(by_path, "parent_path", "left").select(
        "id", F.lit(casefile).alias("casefile_id"), "content_hash", F.element_at(F.split("path", "/"), -1).alias("filename"), "media_type", "byte_size", F.col("text").alias("extracted_text"), "extractor", "text_source",
        F.lit("").alias("summary"), F.lit("").alias("summary_by"), F.lit(at).cast("timestamp").alias("created_at"), F.lit(at).cast("timestamp").alias("updated_at"), "parent_id", F.col("path").alias("containment_path"), "identity_path",
    )
