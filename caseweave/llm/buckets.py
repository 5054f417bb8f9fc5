"""Comparing the rows of buckets: bit-sliced distances in a task, hot buckets by leaders, components of what links.

Candidates of a similarity search share a bucket, (t, key). A task holds whole
buckets. One above BUCKET_ROWS rows or BUCKET_BYTES bytes is too large for that
and goes in two steps, which lose no pair of it that matters:

1. Its LEADERS first rows by a hash meet all others, which are dealt in blocks:
   a comparison with a few rows, so linear in the bucket. In a group of near
   copies, however large, nearly all rows now hang together.
2. The largest component of the bucket needs no comparison inside itself. All
   other rows are dealt in blocks, every two of which meet in a task, and each
   of which meets every block of the largest component.

Buckets with the same members are one: the first of them is compared.

A task has one or two sides (``own``): rows of side 0 are compared with rows of
side 1, rows of side -1 with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.plans.durable import broadcast_if_small, cut, discard, scratch

#: What one task compares at once; a larger bucket is dealt in blocks of half as much.
BUCKET_ROWS, BUCKET_BYTES = 1024, 32 << 20
LEADERS = 32
#: What a partition of tasks holds, about.
TASK_ROWS, TASK_BYTES = 200_000, 64 << 20


# --- inside a task -----------------------------------------------------------------------------


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Planes of words: bit j of word w in plane k is bit k of fingerprint 64 w + j. A fingerprint has one word or a row of them."""
    n = len(prints)
    own = prints.reshape(n, -1)
    bits = np.zeros((ceil(n / 64) * 64, 64 * own.shape[1]), np.uint8)
    bits[:n] = np.unpackbits(own.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within_radius(prints: np.ndarray, planes: np.ndarray, pivot: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the work items (pivot, word), those with lanes of ``lanes`` within ``radius``, and which.

    Counters are bit-sliced: c[i] holds bit i of 64 distances. Planes come in
    pairs through a full adder; the top counter sticks once a distance has overflowed.
    Items without a lane left are dropped every eighth of the radius.
    """
    width, own = max(1, radius.bit_length()), prints.reshape(len(prints), -1)
    ones, zero, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), np.uint64(1)
    alive, every = lanes, max(8, radius // 8 * 2)
    c = [np.zeros(len(pivot), np.uint64) for _ in range(width + 1)]
    for k in range(0, len(planes), 2):
        fp = own[pivot, k // 64]
        x, y = (planes[i][word] ^ np.where((fp >> np.uint64(i % 64)) & one, ones, zero) for i in (k, k + 1))
        half = c[0] ^ x
        carry = (c[0] & x) | (half & y)
        c[0] = half ^ y
        for i in range(1, width):
            c[i], carry = c[i] ^ carry, c[i] & carry
        c[width] = c[width] | carry
        if (k + 2) % every == 0 or k + 2 >= len(planes):
            alive = alive & ~exceeds(c, radius, width)
            keep = np.flatnonzero(alive)
            if len(keep) < len(alive):
                alive, pivot, word, c = alive[keep], pivot[keep], word[keep], [x[keep] for x in c]
            if not len(keep):
                break
    return pivot, word, alive


def exceeds(c: list[np.ndarray], radius: int, width: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``, by comparing bit-sliced from the top."""
    over, equal = c[width].copy(), ~c[width]
    for i in range(width - 1, -1, -1):
        if radius >> i & 1:
            equal &= c[i]
        else:
            over |= equal & c[i]
            equal &= ~c[i]
    return over


def below(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n bits set, 0 <= n <= 64."""
    one = np.uint64(1)
    return np.where(n >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (one << np.minimum(n, np.uint64(63))) - one)


def partners(group: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row, the rows [low, high) it is compared with; rows are sorted by task and side."""
    n, rows = len(group), np.arange(len(group))
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    many = np.diff(np.r_[start, n])
    end, second = np.repeat(start + many, many), np.repeat(start + np.add.reduceat((own == 0).astype(np.int64), start), many)
    return np.where(own < 0, rows + 1, np.where(own == 0, second, end)), end


def near_pairs(group: np.ndarray, own: np.ndarray, prints: np.ndarray, radius: int | None, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (x, y), x before y, of tasks, in steps: those within the radius, or all if it is None.

    ``step`` work items (one fingerprint against 64) are compared in one vectorised step.
    """
    if not len(group):
        return
    low, high = partners(group, own)
    pivots = np.flatnonzero(low < high)
    if not len(pivots):
        return
    planes = bit_planes(prints) if radius is not None else None
    first = low[pivots] >> 6
    counts = ((high[pivots] - 1) >> 6) - first + 1
    bounds = np.r_[0, np.cumsum(counts)]
    at = 0
    while at < len(pivots):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, "right")) - 1)
        c = counts[at:to]
        pivot = np.repeat(pivots[at:to], c)
        word = np.arange(len(pivot)) - np.repeat(bounds[at:to] - bounds[at], c) + np.repeat(first[at:to], c)
        lanes = below(np.clip(high[pivot] - 64 * word, 0, 64).astype(np.uint64)) & ~below(np.clip(low[pivot] - 64 * word, 0, 64).astype(np.uint64))
        found = (pivot, word, lanes) if radius is None else within_radius(prints, planes, pivot, word, lanes, radius)
        for i in range(0, len(found[0]), 1 << 10):
            p, w, m = (x[i : i + (1 << 10)] for x in found)
            item, lane = np.nonzero(np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield p[item], 64 * w[item] + lane
        at = to


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of rows a[i] and b[i]; root[] then names the smallest row of each class."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(root, np.maximum(x, y), low)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def by_task(edges: Callable) -> Callable:
    """For mapInArrow over rows sorted by task (first two columns): ``edges`` of whole tasks, which may go on in the next batch."""
    import pyarrow as pa

    def run(batches):
        kept = None
        for batch in batches:
            part = batch if kept is None else pa.concat_batches([kept, batch])
            b1, b2 = part.column(0).to_numpy(), part.column(1).to_numpy()
            other = np.flatnonzero((b1 != b1[-1]) | (b2 != b2[-1])) if len(b1) else []
            tail = int(other[-1]) + 1 if len(other) else 0
            kept = part.slice(tail)
            if tail:
                yield edges(part.slice(0, tail))
        if kept is not None and kept.num_rows:
            yield edges(kept)

    return run


def task_numbers(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])


# --- dealing buckets to tasks --------------------------------------------------------------------


def partitions(spark: SparkSession, rows: int, size: int) -> int:
    """Partitions for so many rows and bytes of tasks, the session's own number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / TASK_ROWS), ceil(size / TASK_BYTES))


def blocks(rows: Column, size: Column) -> Column:
    """In how many blocks so many rows and bytes are dealt."""
    return F.greatest(F.ceil(rows / (BUCKET_ROWS // 2)), F.ceil(size / (BUCKET_BYTES // 2))).cast("int")


def span(n: Column) -> Column:
    """0 to n - 1, of which there may be none."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def bucket_links(keyed: DataFrame, compare: Callable[[DataFrame, int, bool], DataFrame], fetch: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all links inside the buckets of ``keyed(node, size, t, key)``.

    ``compare(tasks, partitions, whole)`` gives edges of ``tasks(b1, b2, own, t,
    node)``; with ``whole`` it has all pairs of a bucket before it and may leave
    out a pair that another bucket has too. ``size`` is the bytes that a node
    brings into a task. ``fetch`` gets the nodes that share a bucket first.
    """
    spark, bucket = keyed.sparkSession, ["t", "key"]
    with scratch() as own:
        # near copies share many buckets with the same members: of those the first is enough
        digest = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (3, 4)]
        held = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *digest).filter("rows > 1")
        held = cut(held.groupBy("rows", "x3", "x4").agg(F.min(F.struct(*bucket, "bytes")).alias("b")).select("b.*", "rows"))
        if fetch is not None:
            fetch(keyed.join(held.select(*bucket), bucket, "left_semi").select("node").distinct())
        large = (F.col("rows") > BUCKET_ROWS) | (F.col("bytes") > BUCKET_BYTES)
        rows, size, hot_rows, hot_bytes, n_hot = held.agg(F.coalesce(F.sum(F.when(~large, F.col("rows"))), F.lit(0)), F.coalesce(F.sum(F.when(~large, F.col("bytes"))), F.lit(0)), F.coalesce(F.sum(F.when(large, F.col("rows"))), F.lit(0)), F.coalesce(F.sum(F.when(large, F.col("bytes"))), F.lit(0)), F.count_if(large)).first()
        cold = keyed.join(held.filter(~large).select(*bucket), bucket).select("t", F.xxhash64(*bucket).alias("b1"), F.lit(0).cast("long").alias("b2"), F.lit(-1).alias("own"), "node")
        if not n_hot:
            return own.keep(cut(compare(cold, partitions(spark, rows, size), True).distinct()))
        hot = held.filter(large)
        crowd = cut(keyed.join(broadcast_if_small(hot.select(*bucket, "rows", "bytes"), n_hot), bucket))
        first = cut(compare(leader_tasks(crowd), partitions(spark, 2 * hot_rows, 2 * hot_bytes), False).distinct())
        tasks = crowd_tasks(crowd, hot, n_hot, components(first))
        n, hot_size = tasks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        second = compare(cold.unionByName(tasks.drop("size")), partitions(spark, rows + n, size + hot_size), True)
        return own.keep(cut(first.union(second).distinct()))


def leader_tasks(crowd: DataFrame) -> DataFrame:
    """Tasks in which the first rows of a bucket by a hash (side 0) meet a block of it (side 1)."""
    g = blocks(F.col("rows"), F.col("bytes"))
    order = Window.partitionBy("t", "key").orderBy(F.xxhash64("node", F.lit(1)), "node")
    lead = crowd.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEADERS).withColumn("block", F.explode(span(g)))
    rest = crowd.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), g).cast("int"))
    of = lambda df, side: df.select("t", F.xxhash64("t", "key", "block").alias("b1"), F.col("block").cast("long").alias("b2"), F.lit(side).alias("own"), "node")
    return of(lead, 0).unionByName(of(rest, 1))


def crowd_tasks(crowd: DataFrame, hot: DataFrame, n_hot: int, classes: DataFrame) -> DataFrame:
    """Tasks of hot buckets, with ``size``: all blocks of rows outside the bucket's largest class with each other and with that class."""
    bucket = ["t", "key"]
    classed = cut(crowd.join(classes, "node", "left"))
    counts = classed.filter("root is not null").groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    largest = counts.groupBy(*bucket).agg(F.max_by(F.struct("root", "n", "w"), F.struct("n", "root")).alias("m"))
    sized = hot.join(largest, bucket, "left").select(*bucket, F.col("m.root").alias("main"), F.coalesce("m.n", F.lit(0)).alias("n"), F.coalesce("m.w", F.lit(0)).alias("w"), (F.col("rows") - F.coalesce("m.n", F.lit(0))).alias("others"), (F.col("bytes") - F.coalesce("m.w", F.lit(0))).alias("other_bytes"))
    plan = sized.select(*bucket, "main", blocks(F.col("n"), F.col("w")).alias("bm"), F.when(F.col("others") > 0, F.greatest(F.lit(1), blocks(F.col("others"), F.col("other_bytes")))).otherwise(0).alias("br"))
    dealt = classed.drop("rows", "bytes").join(broadcast_if_small(plan, n_hot), bucket).withColumn("inside", F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.lit(1), F.when(F.col("inside"), F.col("bm")).otherwise(F.col("br")))).cast("int")
    dealt, wide = dealt.withColumn("block", block), (F.col("br") + F.col("bm")).cast("long")
    task = lambda i, j, side: F.struct((i * wide + j).cast("long").alias("b2"), side.cast("int").alias("own"))
    b = F.col("block")
    among = F.transform(span(F.col("br")), lambda j: task(F.least(j, b), F.greatest(j, b), F.when(j == b, -1).when(b < j, 0).otherwise(1)))
    across = F.transform(span(F.col("bm")), lambda k: task(b, F.col("br") + k, F.lit(0)))
    meets = F.transform(span(F.col("br")), lambda i: task(i, F.col("br") + b, F.lit(1)))
    out = dealt.withColumn("task", F.explode(F.when(F.col("inside"), meets).otherwise(F.concat(among, across))))
    return out.select("t", F.xxhash64("t", "key", "task.b2").alias("b1"), F.col("task.b2").alias("b2"), F.col("task.own").alias("own"), "node", "size")


# --- components ----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges(u, v)`` that has one to another node.

    Rounds of large-star and small-star; each is an aggregation of minima, which
    combines before its shuffle, and a join that may split hot nodes. A round's
    edges are cut to the shared folder, and go with the next. It ends when a
    round changes nothing.
    """
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    with scratch() as own:
        e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        last = sign(e)
        while last[0]:
            with scratch() as turn:
                n = last[0]
                both = e.union(e.select("v", "u"))
                # the minima are cut so that the join has exchanges of its own, whose hot nodes may be split
                low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
                star = both.join(broadcast_if_small(low, 2 * n), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.filter("m < u")).distinct()
                star = cut(star, 2 * n)
                low = cut(star.groupBy("u").agg(F.min("v").alias("m")), 2 * n)
                new = turn.keep(cut(star.join(broadcast_if_small(low, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low).distinct(), 2 * n))
            now = sign(new)
            discard(e)
            e = new
            if now == last:
                break
            last = now
        out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        return own.keep(cut(out, 2 * last[0]))
