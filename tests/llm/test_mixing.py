import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from caseweave.llm import mixing as M
from tests.llm.fixtures import SF, documents


def brute_targets(sizes):
    """Resharing source by source, as told."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        goal = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        above = {s for s in free if goal[s] > 2 * sizes[s]}
        if not above:
            return goal
        capped |= above


def check(rows, got):
    sizes, source = defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += len(re.findall(M.WORD, t or ""))
        source[d] = s
    goal, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s], abs=1e-5) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.5


def small():
    rows = [(i, "w " * (i * 37 % 91), f"s{i % 7}") for i in range(300)]
    rows += [(400 + i, "a\tb\x0bc" * (i % 3), None) for i in range(20)] + [(500, None, "s1"), (501, "", "empty"), (502, "  \n", "é"), (503, "one", "é"), (504, "x " * 30000, "s2")]
    return rows


def test_targets_and_taken(spark):
    df = spark.createDataFrame(small(), "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    check(small(), M.mix_report(df).collect())


def test_cells_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(small(), "doc_id long, text string, source string")
    want = sorted(map(tuple, M.mix_report(df).collect()), key=str)
    monkeypatch.setattr(M, "CELL_ROWS", 3)
    assert sorted(map(tuple, M.mix_report(df.repartition(7)).collect()), key=str) == want


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = con.execute(M.oracle_sql()).fetchall()
    got = [tuple(r) for r in M.mix_report(documents(spark)).collect()]
    for a, b in zip(sorted(got), sorted(rows), strict=True):
        assert a[:3] + a[4:5] == b[:3] + b[4:5] and a[3] == pytest.approx(b[3]) and a[5] == pytest.approx(b[5])


def test_stream_is_sorted_whole_and_repeated(spark):
    docs = spark.createDataFrame(small(), "doc_id long, text string, source string").withColumn("mix_extra", F.lit(1))
    report = {r.doc_id: r for r in M.mix_report(docs).collect()}
    docs = docs.selectExpr("*", "doc_id * 2 as mix_size", "doc_id * 3 as Mix_Key", "doc_id * 4 as in_0", "doc_id * 5 as mix_at")
    out = M.mix(docs)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
        assert (r.mix_extra, r.mix_size, r.Mix_Key, r.in_0, r.mix_at) == (1, r.doc_id * 2, r.doc_id * 3, r.doc_id * 4, r.doc_id * 5)
    for d, r in report.items():
        assert abs(count[d] * r.size - r.taken) <= r.size / 2 and count[d] <= 2


def test_schedules_invert(spark):
    for schedule in M.SCHEDULES:
        rows = spark.range(101).select((F.col("id") / 100).alias("d")).select("d", M.inverse(M.segments_column([schedule], F.lit(0)), F.col("d")).alias("t")).collect()
        total = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(schedule, schedule[1:], strict=False))
        for r in rows:
            area = 0.0
            for (a, x), (b, y) in zip(schedule, schedule[1:], strict=False):
                t = min(max(r.t, a), b) - a
                area += x * t + (y - x) / (b - a) * t * t / 2
            assert area / total == pytest.approx(r.d, abs=1e-9)


def test_repeats_of_a_row_are_dealt_by_count(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 3)
    data = [(1, "a b c", "s", i % 2) for i in range(40)] + [(2, "d e", "s", 0)] * 10 + [(3, "f", "t", 0), (4, None, "t", 0), (4, None, "t", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, other int")
    rows = M.assign(df).collect()
    assert sorted((r.doc_id, r.text or "", r.other) for r in rows) == sorted((d, t or "", o) for d, t, _, o in data)
    for source in "st":
        at = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (r.mix_start, r.mix_size)):
            assert r.mix_start == at
            at += r.mix_size
    assert M.mix(df).count() == sum(1 for _ in M.mix(df.repartition(5)).collect())


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a b c", "s")] * 5 + [(None, "d", None)] * 3
    out = M.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 8 and sum(r.taken for r in out if r.doc_id == 1) == round(brute_targets({"s": 15, None: 3})["s"])
    assert M.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    zero = M.mix_report(spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [r.taken for r in zero] == [0, 0]
