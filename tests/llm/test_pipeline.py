from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from caseweave.llm import decontam, langid, mixing, sharding
from tests.llm.fixtures import SF, documents
from tests.llm.test_sharding import brute as brute_shards
from tests.llm.test_simgroup import jaccard, roots, shingles


def test_stages_against_brute_force(spark, tmp_path):
    docs, columns = documents(spark), documents(spark).columns
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs
        assert docs.columns == columns or name == "sharding"
        assert docs.count() > 0
        if name == "simhash_near_dedup":
            ids, sets = zip(*sorted((r.doc_id, shingles(r.text)) for r in before.collect()), strict=True)
            near = [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i]) * 0.8 <= len(sets[j]) <= len(sets[i]) * 1.25 and jaccard(sets[i], sets[j]) >= 0.8]
            assert sorted(r.doc_id for r in docs.collect()) == [ids[i] for i, r in enumerate(roots(len(ids), near)) if i == r]
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in docs.collect() for t in items)
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert 0 < len(gone) < 40
        if name == "source_mixing":
            plan = {r.doc_id: (r.taken, r.size) for r in mixing.mix_report(before).collect()}
            count = Counter(r.doc_id for r in docs.collect())
            assert max(count.values()) <= 2 and all(abs(count[d] * size - taken) <= size / 2 for d, (taken, size) in plan.items())
        if name == "sharding":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            limit = sharding.limit_for(sum(len((t or "").encode()) for _, t in rows))
            assert sorted((str(r.doc_id), r.shard) for r in docs.collect()) == sorted((d, s) for d, _, s, _, _ in brute_shards(rows, limit))
    assert kept["language_id"].count() == documents(spark).count()  # every document of the table has a language


def test_run_is_the_same_and_takes_edges(spark, tmp_path):
    docs = documents(spark).limit(150)
    odd = spark.createDataFrame([(None, "no id and words enough to say", "en", None, 5), (900001, None, None, "src1", 0), (900002, "", "en", "src1", 0), (900003, "1234 !!", "en", "src2", 7)], docs.schema)
    one = docs.limit(1)
    docs.unionByName(odd).unionByName(one).unionByName(one).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    a = sorted(map(str, P.run(spark, str(tmp_path)).collect()))
    assert a == sorted(map(str, P.run(spark, str(tmp_path)).collect()))
    assert not any("90000" in r for r in a)


def test_empty(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
