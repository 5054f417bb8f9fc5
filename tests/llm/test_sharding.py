import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from caseweave.llm import sharding as S
from tests.llm.fixtures import SF, documents


def brute(rows, limit):
    """Split buckets one bit at a time."""
    h = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
    todo, leaves = [("", [(h(d, t), d, len((t or "").encode())) for d, t in rows])], []
    while todo:
        bits, bucket = todo.pop()
        if sum(b for _, _, b in bucket) > limit and len({x for x, _, _ in bucket}) > 1:
            for bit in "01":
                part = [r for r in bucket if f"{r[0]:060b}"[: len(bits) + 1] == bits + bit]
                if part:
                    todo.append((bits + bit, part))
        elif bucket:
            leaves.append((bits, bucket))
    leaves.sort(key=lambda x: x[0].ljust(60, "0"))
    return sorted((str(d), b, i, len(bits), bits) for i, (bits, bucket) in enumerate(leaves) for _, d, b in bucket)


def rows():
    out = [(i, "é" * (i * 31 % 700)) for i in range(400)] + [(900, None), (901, ""), (902, "x" * 100000), (None, "y")]
    return out


@pytest.mark.parametrize("limit", [300, 5000, 10**9])
def test_against_brute_force(spark, limit):
    df = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("bytes", F.lit(1))
    got = S.shard_table(df, limit=limit).collect()
    assert sorted((str(r.doc_id), r.size, r.shard, r.depth, r.prefix) for r in got) == brute(rows(), limit)
    assert all(r.bytes <= limit or r.oversize and r.size > limit for r in got)


def test_copies_of_one_hash_are_dealt_by_count(spark):
    data = rows() + [(7, "same " * 20)] * 500 + [(None, None)] * 50
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("source", F.when(F.rand(1) < 0.5, "a").otherwise("b"))
    got = S.assign(df, limit=3000).collect()
    assert sorted((str(r.doc_id), r.text or "", r.source) for r in got) == sorted((str(r.doc_id), r.text or "", r.source) for r in df.collect())
    size = defaultdict(int)
    for r in got:
        size[r.sh_shard, r.sh_part] += r.sh_size
    assert all(v <= 3000 for k, v in size.items() if k not in {(r.sh_shard, 0) for r in got if r.sh_oversize})
    assert len({r.sh_part for r in got if r.doc_id == 7 and r.text.startswith("same")}) >= 500 * 100 // 3000


@pytest.mark.parametrize("limit", [None, 50000])
def test_sql_agrees(spark, limit):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(S.oracle_sql(limit)).fetchall()
    got = S.shard_table(documents(spark), limit=limit).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.shard for r in got) > 20


def test_sql_deals_copies_alike(spark, tmp_path):
    data = rows() + [(7, "same " * 20)] * 300 + [(8, "x" * 4000)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    got = S.shard_table(df, limit=3000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(S.oracle_sql(3000)).fetchall(), key=str)
    assert {r.oversize for r in got if r.doc_id == 8 and r.size == 4000} == {True} and max(r.part for r in got) > 5


def test_limits():
    assert [S.limit_for(n) for n in (0, 10**6, 64 << 20, 10**14)] == [S.LEAST_BYTES, S.LEAST_BYTES, 1 << 20, S.SHARD_BYTES]


def test_columns_with_the_operators_own_names(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "doc_id as shard", "doc_id * 2 as sh_size", "doc_id * 3 as in_1", "doc_id * 4 as SH_HASH")
    out = S.with_shards(df, limit=5000)
    assert out.columns == [*df.columns, "shard_", "shard_part"]
    got = out.collect()
    assert all(r.doc_id is None or (r["shard"], r.sh_size, r.in_1, r.SH_HASH) == tuple(r.doc_id * k for k in (1, 2, 3, 4)) for r in got)
    assert sorted((str(r.doc_id), r["shard_"]) for r in got) == sorted((d, s) for d, _, s, _, _ in brute(rows(), 5000))


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    S.write_shards(df, f"{tmp_path}/out", limit=50000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows()) and back.select("shard").distinct().count() > 2


def test_empty(spark):
    assert S.shard_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0
