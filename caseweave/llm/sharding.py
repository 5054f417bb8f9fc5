"""Sharding by extendible hashing.

A document's hash is 60 bits. A bucket is a prefix of those bits; it splits on
its next bit only while it holds more bytes than the limit, so that the leaves
of the directory are the shards: shallow where data are thin, deep where they
are dense. The sums of a few levels come from one pass over hash cells; a level
is added only below cells that are still too large.

What can't be split by bits: a single document above the limit is a shard of
its own (``oversize``). Rows that agree in id and text have one hash, however
many there are; beyond the limit they are dealt by count over several shards of
that hash, ``part`` 0, 1, and so on.

The limit is SHARD_BYTES, or less where READERS readers would not get a shard
each, LEAST_BYTES at least.

Defined cases: null and empty texts weigh 0 bytes and go where their hash goes;
an empty table has no shards. Columns of the input are kept, whatever their
names: inside, they have others.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.mixing import HASH_BITS, hash60, stream_key
from caseweave.llm.tables import fresh, named, shield
from caseweave.plans.durable import broadcast_if_small, cut, scratch
from caseweave.plans.ranks import global_rank

#: The bytes of a shard at most; how many readers there are, and from which size on shards are made smaller for them.
SHARD_BYTES, READERS, LEAST_BYTES = 64 << 20, 64, 64 << 10
#: Levels below the expected depth that the first pass sums, and levels of each later pass.
SLACK, MORE = 3, 4


def prefix(h: F.Column, depth) -> F.Column:
    """The first ``depth`` bits, as a number."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - F.lit(depth)).cast("int"))


def split(keys: DataFrame, top: int, bottom: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, too large at the bottom) of the levels top to bottom: sh_depth, sh_prefix, sh_bytes, sh_rows, sh_keys.

    ``keys`` are hashes with bytes and rows, all of them below buckets that have
    to split above ``top`` (or ``top`` is the root).
    """
    sums = [F.sum(c).alias(c) for c in ("sh_bytes", "sh_rows", "sh_keys")]
    cells = keys.groupBy(prefix(F.col("sh_hash"), bottom).alias("sh_cell")).agg(*sums)
    levels = F.explode(F.transform(F.sequence(F.lit(top), F.lit(bottom)), lambda d: F.struct(d.alias("sh_depth"), F.call_function("shiftright", F.col("sh_cell"), (F.lit(bottom) - d).cast("int")).alias("sh_prefix"))))
    nodes = cut(cells.select(levels.alias("n"), "sh_bytes", "sh_rows", "sh_keys").groupBy("n.sh_depth", "n.sh_prefix").agg(*sums))
    large = (F.col("sh_bytes") > limit) & (F.col("sh_keys") > 1)
    up = nodes.filter(large).select((F.col("sh_depth") + 1).alias("sh_depth"), F.col("sh_prefix").alias("sh_parent"))
    below = nodes.filter(~large).withColumn("sh_parent", F.call_function("shiftright", F.col("sh_prefix"), F.lit(1)))
    leaves = below.filter(F.col("sh_depth") > top).join(up, ["sh_depth", "sh_parent"], "left_semi").unionByName(below.filter(F.col("sh_depth") == top)).drop("sh_parent")
    return leaves, nodes.filter(large & (F.col("sh_depth") == bottom))


def limit_for(total: int) -> int:
    """The byte limit of shards of a table of so many bytes."""
    return max(LEAST_BYTES, min(SHARD_BYTES, total // READERS))


def directory(keys: DataFrame, total: int, limit: int) -> tuple[DataFrame, int]:
    """(leaves with sh_shard, depth of the first pass): every bucket that is not split, numbered in hash order."""
    bits = min(HASH_BITS, max(1, ceil(log2(max(total, 1) / limit)) + SLACK if total > limit else 1))
    leaves, large = split(keys, 0, bits, limit)
    bottom = bits
    while bottom < HASH_BITS and not large.isEmpty():
        top, bottom = bottom + 1, min(HASH_BITS, bottom + MORE)
        dense = large.select(F.col("sh_prefix").alias("sh_p"))
        more, large = split(keys.join(dense, prefix(F.col("sh_hash"), top - 1) == F.col("sh_p"), "left_semi"), top, bottom, limit)
        leaves = leaves.unionByName(more)
    leaves = leaves.unionByName(large)  # two keys that agree in all bits
    first = F.call_function("shiftleft", F.col("sh_prefix"), (F.lit(HASH_BITS) - F.col("sh_depth")).cast("int"))
    return cut(global_rank(leaves.withColumn("sh_first", first), [F.col("sh_first")], "sh_shard")), bits


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """``docs`` with sh_size, sh_shard, sh_part, sh_depth, sh_prefix (bits as text), sh_bytes (of the bucket) and sh_oversize.

    No column of ``docs`` may begin with ``sh_``.
    """
    sized = docs.withColumns({"sh_hash": hash60(stream_key(F.col(id_col), F.col(text_col))), "sh_size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")})
    with scratch() as own:
        keys = cut(sized.groupBy("sh_hash").agg(F.sum("sh_size").alias("sh_bytes"), F.count(F.lit(1)).alias("sh_rows"), F.lit(1).cast("long").alias("sh_keys")))
        total = keys.agg(F.sum("sh_bytes")).first()[0] or 0
        limit = limit_for(total) if limit is None else limit
        leaves, bits = directory(keys, total, limit)
        large = F.col("sh_bytes") > limit
        copies = not leaves.filter(large & (F.col("sh_rows") > 1)).isEmpty()
        # a leaf as a range of hashes, entered under every cell of the first pass that it covers or lies in
        low = F.call_function("shiftright", F.col("sh_first"), F.lit(HASH_BITS - bits))
        last = F.col("sh_first") + F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(HASH_BITS) - F.col("sh_depth")).cast("int")) - 1
        text = F.when(F.col("sh_depth") == 0, "").otherwise(F.expr("lpad(bin(sh_prefix), sh_depth, '0')"))
        cells = F.explode(F.sequence(low, F.call_function("shiftright", last, F.lit(HASH_BITS - bits))))
        entries = own.keep(cut(leaves.select("sh_shard", "sh_depth", text.alias("sh_prefix"), "sh_bytes", "sh_rows", "sh_first", last.alias("sh_last"), cells.alias("sh_cell"))))
    entries = broadcast_if_small(entries, entries.count())
    here = sized.withColumn("sh_cell", prefix(F.col("sh_hash"), bits)).join(entries, "sh_cell").filter(F.col("sh_hash").between(F.col("sh_first"), F.col("sh_last")))
    here = here.withColumn("sh_oversize", F.col("sh_size") > limit).withColumn("sh_copies", large & (F.col("sh_rows") > 1))
    own_columns = ["sh_size", "sh_shard", "sh_part", "sh_depth", "sh_prefix", "sh_bytes", "sh_oversize"]
    out = here.filter("not sh_copies").withColumn("sh_part", F.lit(0).cast("long")).select(*docs.columns, *own_columns)
    if copies:
        out = out.unionByName(deal_copies(here.filter("sh_copies"), docs.columns, limit).select(*docs.columns, *own_columns))
    return out


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``shard_part``, under longer names where the input has those."""
    inner, names, back = shield(docs)
    out = assign(inner, names[id_col], names[text_col], limit)
    return out.select(*back, F.col("sh_shard").alias(fresh(docs, "shard")), F.col("sh_part").alias(fresh(docs, "shard_part")))


def deal_copies(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Rows of one hash each, dealt by count: equal rows are counted, and laid out again part by part."""
    every = [*columns, "sh_size", "sh_shard", "sh_depth", "sh_prefix", "sh_bytes", "sh_oversize", "sh_hash"]
    counted = cut(rows.groupBy(*every).agg(F.count(F.lit(1)).alias("sh_count")))
    per_part = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("sh_size"), F.lit(1))))
    # rows of one hash that differ in other columns follow each other
    from pyspark.sql import Window

    before = F.coalesce(F.sum("sh_count").over(Window.partitionBy("sh_hash").orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = counted.withColumn("sh_before", before).withColumn("sh_per", per_part)
    parts = ranged.withColumn("sh_part", F.explode(F.sequence(F.floor(F.col("sh_before") / F.col("sh_per")), F.floor((F.col("sh_before") + F.col("sh_count") - 1) / F.col("sh_per")))))
    start = F.greatest(F.col("sh_before"), F.col("sh_part") * F.col("sh_per"))
    end = F.least(F.col("sh_before") + F.col("sh_count"), (F.col("sh_part") + 1) * F.col("sh_per"))
    spread = parts.withColumn("sh_n", (end - start).cast("int")).repartition("sh_hash", "sh_part")
    return spread.withColumn("sh_each", F.explode(F.array_repeat(F.lit(0), F.col("sh_n"))))


def shard_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """One row for each document: its size and its shard."""
    narrow = docs.select(named(id_col).alias("in_id"), named(text_col).alias("in_text"))
    return assign(narrow, "in_id", "in_text", limit).select(F.col("in_id").alias(id_col), *(F.col(f"sh_{c}").alias(c) for c in ("size", "shard", "part", "depth", "prefix", "bytes", "oversize")))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> None:
    """Each shard (and part of one) as a folder of its own, its rows brought together by one shuffle."""
    out = with_shards(docs, id_col, text_col, limit)
    shard, part = out.columns[-2:]
    out.repartition(shard, part).write.partitionBy(shard, part).parquet(path)


def oracle_sql(limit: int | None = None) -> str:
    """The same as SQL: all levels of all hashes, of which the first that need not split counts; copies above the limit dealt by count."""
    most = f"greatest({LEAST_BYTES}, least({SHARD_BYTES}, coalesce((SELECT sum(size) FROM d), 0) // {READERS}))" if limit is None else limit
    return f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
m AS (SELECT {most} AS most),
k AS (SELECT h, sum(size) AS bytes, count(*) AS n FROM d GROUP BY h),
x AS (SELECT h, bytes, n, CAST(g AS INTEGER) AS depth, h >> CAST(60 - g AS BIGINT) AS p FROM k, generate_series(0, 60) t(g)),
node AS (SELECT depth, p, sum(bytes) AS bytes, sum(n) AS n, count(*) AS keys FROM x GROUP BY depth, p),
leaf AS (
  SELECT h, min(depth) AS depth FROM x JOIN node USING (depth, p), m
  WHERE node.bytes <= most OR node.keys = 1 OR depth = 60 GROUP BY h),
s AS (SELECT h, l.depth, x.p, node.bytes, node.n FROM leaf l JOIN x USING (h, depth) JOIN node USING (depth, p)),
r AS (SELECT *, dense_rank() OVER (ORDER BY p << CAST(60 - depth AS BIGINT)) - 1 AS shard FROM s)
SELECT doc_id, size, shard,
       CASE WHEN bytes > most AND n > 1 THEN CAST((row_number() OVER (PARTITION BY h) - 1) // greatest(1, most // greatest(size, 1)) AS BIGINT) ELSE 0 END AS part,
       depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS prefix, CAST(bytes AS BIGINT) AS bytes, size > most AS oversize
FROM d JOIN r USING (h), m"""
