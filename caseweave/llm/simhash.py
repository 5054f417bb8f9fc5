"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit for each of 64 hash bits that is set in over half of a
text's word shingles. Two fingerprints link at ``radius`` or fewer differing
bits; documents of linked fingerprints form a class.

Candidates come from block keys: the 64 bits are cut into ``k`` blocks, and two
fingerprints within the radius agree on at least ``k - radius`` whole blocks,
so one key for each choice of ``k - radius`` blocks finds every link. ``k``
follows the count of distinct fingerprints so that keys stay selective.
Inside a bucket, bit planes are stored vertically (64 rows to a machine word),
distances of one fingerprint to 64 others are counted at once by carry-save
adders, and words in which all 64 exceed the radius are abandoned early.

Hot buckets are dealt as :mod:`caseweave.llm.buckets` says, which keeps tasks
bounded and loses no link. Each task gives a star of edges rather than all of
its pairs, and connected components run distributed over those edges.

Defined cases: null or empty text and text without words have fingerprint zero,
linked like any other; repeated rows share a class; a class of rows without an
id has a null component id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf
from caseweave.llm.buckets import bucket_links, by_task, components, near_pairs, task_numbers, union
from caseweave.llm.tables import fresh, named
from caseweave.plans.durable import cut, scratch

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Work items (one fingerprint against 64) in one vectorised step.
STEP = 1 << 15


def fingerprint_of(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, unsigned. bytes.lower() changes A-Z alone."""
    from xxhash import xxh64_intdigest as digest

    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return digest(b" ".join(tokens), seed)
    join, total, n = b" ".join, np.zeros(64, np.int64), len(tokens) - words + 1
    for at in range(0, n, 1 << 16):
        part = tokens[at : at + (1 << 16) + words - 1]
        h = np.array([digest(join(s), seed) for s in zip(*(part[i:] for i in range(words)), strict=False)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: F.Column, words: int = SHINGLE_WORDS) -> F.Column:
    """A long column: the 64 fingerprint bits of ``text``."""

    @text_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint_of(x.as_py(), words) for x in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return simhash(text)


# --- links ---------------------------------------------------------------------------------------


def link_tasks(group: np.ndarray, own: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row, row of its root) of the rows linked within their tasks (contiguous, side by side)."""
    rows = np.arange(len(fps))
    root = rows.copy()
    for x, y in near_pairs(group, own, fps, radius, STEP):
        union(root, x, y)
    linked = np.flatnonzero(root != rows)
    return linked, root[linked]


def task_edges(radius: int) -> Callable:
    """For mapInArrow over tasks (b1, b2, own, node) in order: edges (u, v) between fingerprints."""

    def edges(part):
        b1, b2, own, fp = (part.column(i).to_numpy() for i in range(4))
        u = v = np.empty(0, np.int64)
        if len(fp) > 1:
            f = np.ascontiguousarray(fp)
            a, b = link_tasks(task_numbers(b1, b2), own, f.view(np.uint64), radius)
            u, v = f[a], f[b]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return by_task(edges)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose keys have about as many values as there are fingerprints."""
    want, k = log2(max(n, 2)) - 2, radius + 1
    while 64 * (k - radius) // k < want and k < 16:
        k += 1
    return k


def key_masks(k: int, radius: int) -> list[int]:
    """For each choice of k - radius of the k blocks, the mask of their bits, signed."""
    cuts = [round(64 * i / k) for i in range(k + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = (sum(block[i] for i in chosen) for chosen in combinations(range(k), k - radius))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``nodes(fp)`` whose components are those of all links."""
    masks = key_masks(blocks_for(n, radius), radius)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    keyed = nodes.select(F.col("fp").alias("node"), keys.alias("b")).select("node", F.lit(32).cast("long").alias("size"), "b.t", "b.key")

    def compare(tasks: DataFrame, parts: int, whole: bool) -> DataFrame:
        return tasks.select("b1", "b2", "own", "node").repartition(parts, "b1").sortWithinPartitions("b1", "b2", "own", "node").mapInArrow(task_edges(radius), "u long, v long")

    return bucket_links(keyed, compare)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (id, fp) of every document; classes (fp, component_id, root) of every fingerprint."""
    with scratch() as own:
        rows = own.keep(cut(docs.select(named(id_col).alias("id"), fingerprint_column(named(text_col), words).alias("fp"))))
        nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
        comp = components(links(nodes.select("fp"), nodes.count(), radius)).withColumnRenamed("node", "fp")
        rooted = own.keep(cut(nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))))
    return rows, with_smallest(rooted)


def with_smallest(rooted: DataFrame) -> DataFrame:
    """(fp, component_id, root) of ``rooted(fp, first_id, root)``: the smallest id of each class, null if none of its rows has one."""
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows, classes = simhash_classes(docs, id_col, text_col, radius, words)
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_a_class(docs: DataFrame, found: tuple[DataFrame, DataFrame], key_of: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id.

    ``found`` are the rows and classes of ``docs``, ``key_of`` the key (fp) of a
    text. Where several rows of a class bear that id, the first by key and hash
    stays; rows of other classes with that id do not count. A class whose rows
    all lack an id keeps one row; rows without an id go if their class has one.
    Columns of the input may have any names: those of the operator are made to
    differ from them.
    """
    rows, classes = found[0], cut(found[1])
    ids = rows.join(classes.select(F.col("component_id").alias("id")).distinct(), "id")
    kept = cut(ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows")))
    kept_id, kept_key, kept_fp, kept_root, kept_of, kept_row = (fresh(docs, f"kept_{c}") for c in ("id", "key", "fp", "root", "of", "row"))
    every = [named(c) for c in docs.columns]
    once, more = (docs.join(kept.filter(c).select(F.col("id").alias(kept_id)), named(id_col) == F.col(kept_id), "left_semi") for c in ("rows = 1", "rows > 1"))
    classed = classes.select(F.col("fp").alias(kept_fp), F.col("root").alias(kept_root), F.col("component_id").alias(kept_of))
    order = F.struct(kept_key, F.xxhash64(named(text_col)), F.xxhash64(*every))

    def one_a_root(of: DataFrame) -> DataFrame:
        keyed = of.withColumn(kept_key, key_of(named(text_col))).join(classed, (F.col(kept_key) == F.col(kept_fp)) & F.col(kept_of).eqNullSafe(named(id_col)))
        return keyed.groupBy(kept_root).agg(F.min_by(F.struct(*every), order).alias(kept_row)).select(f"{kept_row}.*")

    out = once
    if not kept.filter("rows > 1").isEmpty():
        out = out.unionByName(one_a_root(more))
    if not rows.filter("id is null").isEmpty():
        out = out.unionByName(one_a_root(docs.filter(named(id_col).isNull())))
    return out
