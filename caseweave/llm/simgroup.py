"""Near duplicates by similarity: wide SimHash over word shingles, compared bit-sliced, then verified.

Documents link if their sets of five-word shingles have a Jaccard similarity of
0.8 or more. A bit of two fingerprints differs with probability acos(c) / pi, c
being the cosine of the sets, and with the sizes of the sets c gives the
similarity, with an error of about 0.03 (one sigma) for 1024 bits. (With 64
bits, near copies at 0.8 differ in 5 to 13 bits, as do many pairs at 0.65, so
no radius tells them apart.)

Equal sets (by a 64-bit hash) are one node from the start, so exact copies cost
nothing. Other candidates share a band, the minima of ROWS hash functions over
the set: pairs at 0.8 share one of BANDS bands with probability 0.9998, closer
ones more surely. What a band does is choose buckets; the comparison in them is
that of :mod:`caseweave.llm.buckets`: vertical bit planes, carry-save counters,
words abandoned once all their lanes exceed the radius, hot buckets dealt in
blocks. The radius leaves SLACK below the similarity; pairs with a set below
SMALL elements are candidates whatever their fingerprints say, if their sizes
alone allow the similarity.

A task has the sets themselves too (32 bits of each shingle's hash), and checks
its candidates on them, the nearest first, until every candidate is checked or
hangs together already by links that hold. So classes are the components of all
candidates that hold, and a pair that fails costs no other pair its check. A
pair that shares several bands is checked in the first alone.

Defined cases: null and empty texts have the empty set, and are one class;
texts of fewer words than a shingle have all their words as one; repeated rows
share a class; a class of rows without an id has a null component id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf
from caseweave.llm.buckets import bucket_links, by_task, components, near_pairs, task_numbers, union
from caseweave.llm.simhash import keep_one_a_class, with_smallest
from caseweave.llm.tables import named
from caseweave.plans.durable import broadcast_if_small, cut, scratch, store

WORDS, SIMILARITY = 5, 0.8
BITS, BANDS, ROWS = 1024, 16, 4
#: How far below the similarity a fingerprint may put a pair that is then verified: over four sigma.
SLACK = 0.12
#: Bits of majority say little of sets of fewer elements: of their pairs in a bucket, fingerprints drop none.
SMALL = 64
#: Work items (one fingerprint against 64) in one vectorised step.
STEP = 1 << 13
#: Elements of sets that are compared in one vectorised step.
ELEMENTS = 1 << 20
#: The golden ratio's fraction, as an odd 64-bit number.
GOLDEN = 0x9E3779B97F4A7C15

SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("elements", T.BinaryType())])


def multipliers(n: int, seed: int = 1, made: dict = {}) -> np.ndarray:  # noqa: B006 - a memo
    """Odd numbers without a pattern: multiples of each other would give hashes that agree too often."""
    if (n, seed) not in made:
        made[n, seed] = drawn_multipliers(n, seed)
    return made[n, seed]


def drawn_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def products(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """(n, k) products modulo 2**64: their order is that of k further hashes, by their high bits."""
    return h[:, None] * by[None, :]


def mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """(n, k) further hashes, good in all bits."""
    x = products(h, by)
    x ^= x >> np.uint64(32)
    x *= np.uint64(GOLDEN)
    x ^= x >> np.uint64(29)
    x *= np.uint64(GOLDEN)
    x ^= x >> np.uint64(32)
    return x


def column_sums(words: np.ndarray) -> np.ndarray:
    """How many rows of (n, w) words have each of their 64 w bits.

    Many rows go through carry-save adders: three words of one weight become a
    sum and a carry of the next.
    """
    if len(words) < 1000:
        return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16).astype(np.int64)
    out, weight = np.zeros(64 * words.shape[1], np.int64), 0
    while True:
        carries = []
        while len(words) >= 3:
            m = len(words) // 3
            a, b, c, rest = words[:m], words[m : 2 * m], words[2 * m : 3 * m], words[3 * m :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, rest))
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        out += np.unpackbits(words[0].view(np.uint8), bitorder="little").astype(np.int64) << weight
        if not carries:
            return out
        words, weight = np.concatenate(carries), weight + 1


def sketch_of(text: bytes | None, n: int = WORDS, bits: int = BITS) -> tuple[int, int, bytes, list[int], bytes]:
    """(node, size of the set, fingerprint, bands, the set as sorted 32-bit hashes) of a UTF-8 text."""
    from xxhash import xxh64_intdigest as digest

    tokens, join = (text or b"").lower().split(), b" ".join
    if not tokens:
        return 0, 0, bytes(bits // 8), [], b""
    grams = zip(*(tokens[i:] for i in range(n)), strict=False) if len(tokens) >= n else [tokens]
    h = np.unique(np.fromiter(map(digest, map(join, grams)), np.uint64))
    total, low = np.zeros(bits, np.int64), np.empty(0, np.uint64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        total += column_sums(mixed(part, multipliers(bits // 64)))
        part = products(part, multipliers(BANDS * ROWS, 2)).min(axis=0)
        low = part if at == 0 else np.minimum(low, part)
    low = low.reshape(BANDS, ROWS)
    bands = [digest(row.tobytes(), b) for b, row in enumerate(low)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    high = (h >> np.uint64(32)).astype(np.uint32)  # in order, as h is
    return signed(digest(h.tobytes())), len(h), np.packbits(2 * total > len(h), bitorder="little").tobytes(), [signed(b) for b in bands], high[np.r_[True, high[1:] != high[:-1]]].tobytes()


def sketch(text: Column) -> Column:
    @text_udf(SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        rows = [sketch_of(v.as_py()) for v in texts.cast(pa.binary())]
        node, size, bits, bands, elements = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(elements, pa.binary())], names=SKETCH.names)

    return run(text)


def radius_for(similarity: float, bits: int = BITS) -> int:
    """The most bits in which fingerprints at that similarity differ, the sizes of their sets being what they may."""
    # for a given similarity, equal sizes have the smallest cosine, 2 J / (1 + J)
    return ceil(bits * acos(2 * similarity / (1 + similarity)) / pi)


def similarity_of(distance: np.ndarray, m: np.ndarray, n: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The similarity of sets of m and n elements whose fingerprints are at that distance."""
    shared = np.cos(np.pi * distance / bits) * np.sqrt(m * n)
    return shared / np.maximum(m + n - shared, 1e-9)


class Sets:
    """Sets of 32-bit elements, one after another, each sorted."""

    def __init__(self, values: pa.Array) -> None:
        values = values.cast(pa.large_binary())
        bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(values) else np.empty(0, np.uint8)
        self.elements = np.ascontiguousarray(data).view(np.uint32).astype(np.uint64)
        self.start, self.size = (bounds[:-1] - bounds[0]) // 4, np.diff(bounds) // 4

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(elements of the rows, each below the number of its row, in order; those numbers)."""
        many = self.size[rows]
        number = np.repeat(np.arange(len(rows)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[rows], many)
        return number.astype(np.uint64) << np.uint64(32) | self.elements[at], number

    def similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Jaccard similarity of the sets of rows x[i] and y[i]; two empty sets have 0."""
        out = np.zeros(len(x))
        work = np.cumsum(self.size[x] + self.size[y])
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + ELEMENTS, "right")))
            a, b = x[at:to], y[at:to]
            (mine, _), (theirs, number) = self.keys(a), self.keys(b)
            if len(mine):
                found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.bincount(number[found], minlength=len(a))
                out[at:to] = both / np.maximum(1, self.size[a] + self.size[b] - both)
            at = to
        return out


def candidates(group: np.ndarray, own: np.ndarray, prints: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (x, y, similarity by fingerprints) of rows that are compared in a task and may have a similarity of ``least``, in steps."""
    for x, y in near_pairs(group, own, prints, radius_for(least - SLACK), STEP):
        s = similarity_of(np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64), size[x], size[y])
        good = (s >= least - SLACK) & (np.minimum(size[x], size[y]) >= SMALL)
        yield x[good], y[good], s[good]
    # all pairs that may have a set below SMALL, as far as their sizes allow
    few = np.flatnonzero(size * least < SMALL)
    for i, j in near_pairs(group[few], own[few], prints[few], None, STEP):
        x, y = few[i], few[j]
        low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        good = (low < SMALL) & (low >= least * high - 1e-9)
        x, y = x[good], y[good]
        yield x, y, similarity_of(np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64), size[x], size[y])


def verified(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], sets: Sets, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows, links that hold on the sets and whose components are those of all that do."""
    root, out = np.arange(len(sets.size)), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for x, y, s in pairs:
        order = np.argsort(-s, kind="stable")
        x, y, at, step = x[order], y[order], 0, 64
        while at < len(x):
            a, b = x[at : at + step], y[at : at + step]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            holds = sets.similarity(a, b) >= least
            if holds.any():
                out.append((a[holds], b[holds]))
                union(root, *out[-1])
            at, step = at + step, min(2 * step, 4096)
    return tuple(np.concatenate(side) for side in zip(*out, strict=True))


def task_edges(least: float, whole: bool) -> Callable:
    """For mapInArrow over tasks (b1, b2, own, node, t, size, bits, bands, elements) in order: links (u, v) that hold.

    With ``whole``, a pair that shares a band before this one is left to the bucket of that band.
    """

    def edges(part):
        b1, b2, own, node, t, size = (part.column(i).to_numpy() for i in range(6))
        u = v = np.empty(0, np.int64)
        if len(node) > 1:
            prints = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(len(node), -1)
            bands = part.column(7).flatten().to_numpy().reshape(len(node), -1)

            def unseen(x, y, s):
                new = node[x] != node[y]
                if whole:
                    new &= ~((bands[x] == bands[y]) & (np.arange(bands.shape[1]) < t[x][:, None])).any(axis=1)
                return x[new], y[new], s[new]

            found = candidates(task_numbers(b1, b2), own, prints, size.astype(np.float64), least)
            a, b = verified((unseen(*f) for f in found), Sets(part.column(8)), least)
            u, v = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return by_task(edges)


def links(nodes: DataFrame, drawn: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) over ``nodes(node, row, size, bands)`` whose components are those of all candidates that hold."""
    with scratch() as own:
        keyed = nodes.select("node", (4 * F.col("size") + BITS // 8 + 8 * BANDS).alias("size"), F.posexplode("bands").alias("t", "key"))
        sets: list[DataFrame] = []

        def fetch(needed: DataFrame) -> None:
            # only sets that share a bucket move, and of copies that of one row
            rows = cut(nodes.join(needed, "node", "left_semi").select("row"))
            sets.append(store(drawn.join(broadcast_if_small(rows, rows.count()), "row", "left_semi").select("node", "size", "bits", "bands", "elements")))

        def compare(tasks: DataFrame, parts: int, whole: bool) -> DataFrame:
            full = tasks.join(sets[0], "node").select("b1", "b2", "own", "node", "t", "size", "bits", "bands", "elements")
            return full.repartition(parts, "b1").sortWithinPartitions("b1", "b2", "own", "node").mapInArrow(task_edges(least, whole), "u long, v long")

        return own.keep(bucket_links(keyed, compare, fetch))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (id, fp) of every document, fp being its node; classes (fp, component_id, root) of every node."""
    with scratch() as own:
        drawn = store(docs.select(named(id_col).alias("id"), sketch(named(text_col)).alias("s")).select("id", F.monotonically_increasing_id().alias("row"), "s.*"))
        rows = own.keep(cut(drawn.select("id", F.col("node").alias("fp"))))
        # rows of a node agree in all else; a hot one combines before its shuffle
        nodes = cut(drawn.groupBy("node").agg(F.min("id").alias("first_id"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands")))
        comp = components(links(nodes, drawn, least))
        rooted = nodes.join(comp, "node", "left").select(F.col("node").alias("fp"), "first_id", F.coalesce("root", "node").alias("root"))
        rooted = own.keep(cut(rooted))
    return rows, with_smallest(rooted)


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, that of the smallest id.

    Repeated ids, rows without an id and columns with clashing names: see
    :func:`caseweave.llm.simhash.keep_one_a_class`.
    """
    return keep_one_a_class(docs, similar_classes(docs, id_col, text_col, least), lambda text: sketch(text)["node"], id_col, text_col)
