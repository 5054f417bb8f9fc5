"""Postings by blocks, and documents whose texts are not shuffled."""

import pytest
from pyspark.sql import functions as F

from caseweave.operators import corpus, search, windows
from caseweave.plans.durable import store

PASSAGES = "chunk_id string, document_id string, casefile_id string, ordinal int, text string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_hold_what_postings_do(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 3)
    texts = ["Crème brûlée FOX fox", "the the КИЇВ", "", "fox_dog 12 a1", "!!", "the fox", "İstanbul ΟΔΟΣ ß", "the dog", "fox"] * 3
    rows = store(corpus.numbered(spark.createDataFrame([(f"k{i}", f"d{i // 4}", "ab"[i % 2], i % 4, t) for i, t in enumerate(texts)], PASSAGES).repartition(2)))
    blocks = corpus.posting_blocks(rows)
    assert "Exchange" not in plan_of(blocks) and "Sort" not in plan_of(blocks)
    blocks = store(blocks)
    terms = [r.term for r in blocks.select("term").distinct().collect()]
    kept = ["term", "casefile_id", "chunk_id", "document_id", "ordinal", "dl", "tf"]
    flat = corpus.opened(blocks, [t for t in terms if t]).join(rows.select("passage_no", "chunk_id", "document_id"), "passage_no").select(kept)
    want = corpus.stored_postings(rows).select(kept)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, want.collect())) and flat.count() > 40
    assert sorted(map(tuple, corpus.block_statistics(blocks).collect())) == sorted(map(tuple, corpus.passage_statistics(rows).collect()))
    found = search.postings_leg(blocks, corpus.block_statistics(blocks), rows, "a", ["fox", "the", "fox"], 5)
    other = search.postings_leg(want, corpus.passage_statistics(rows), rows, "a", ["fox", "the", "fox"], 5)
    say = lambda df: [(r.keyword_rank, r.chunk_id, round(r.score, 9)) for r in df.orderBy("keyword_rank").collect()]
    assert say(found) == say(other)


def test_a_posting_is_a_place_and_a_count(spark, monkeypatch):
    """What ranking needs of a passage is stored once for its block, with the columns that blocks carry, and not with each posting."""
    monkeypatch.setattr(corpus, "BLOCK", 4)
    rows = [(f"k{i}", f"d{i // 3}", "abc"[i % 3], i, ["fox fox dog", "", "dog", None, "the fox"][i % 5]) for i in range(23)]
    passages = store(corpus.numbered(spark.createDataFrame(rows, PASSAGES).repartition(2)))
    blocks = store(corpus.posting_blocks(passages, ("chunk_id", "document_id")))
    lists = F.size("passage_no") + F.size("ordinal") + F.size("dl") + F.size("chunk_id") + F.size("document_id")
    assert blocks.filter("term <> ''").agg(F.max(lists)).first()[0] == 0 and blocks.filter("term <> ''").filter(F.size("place") == 0).count() == 0
    own = ["casefile_id", "passage_no", "ordinal", "chunk_id", "document_id"]
    assert sorted(map(tuple, corpus.listed(blocks).select(own).collect())) == sorted(map(tuple, passages.select(own).collect()))
    found = corpus.opened(blocks, ["fox", "dog"]).join(passages, ["passage_no", "casefile_id", "ordinal"]).select("term", "chunk_id", "tf", "dl")
    want = sorted((t, k, text.split().count(t), len(text.split())) for k, _, _, _, text in rows for t in ("fox", "dog") if t in (text or ""))
    assert sorted(map(tuple, found.collect())) == want


def documents_of(spark, folder):
    texts = ["  one a@b.org\n\n# Head\ntwo ", "x " * 2500, "😀 é " * 1500, "", None, "call +49 170 1234567 now", "# A\n" + "y z\n\n" * 900, "x " * 2500]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("most", [10_000, 3])
def test_a_stored_corpus_has_no_texts_of_its_own(spark, tmp_path, monkeypatch, most):
    """Passages are offsets, and their texts come from the documents, few of them or many."""
    from caseweave.plans import catalogue

    monkeypatch.setattr(corpus, "FETCH_MOST", most)
    documents_of(spark, tmp_path)
    chunks = catalogue.ingested(spark, str(tmp_path), "chunks")
    assert "text" not in chunks.columns and "text" not in catalogue.ingested(spark, str(tmp_path), "postings").columns
    columns = ["document_id", "doc_id", "casefile_id", "chunk_id", "ordinal", "char_start", "char_end", "heading_path", "text"]
    fresh = catalogue.chunks_of(spark, str(tmp_path))
    got = catalogue.worded(spark, str(tmp_path))(chunks).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fresh.select(columns).collect())) and got.count() > 8


def test_identifiers_are_those_of_passages_with_their_numbers(spark, tmp_path):
    """Documents without the signs of an identifier are not cut for them, and the others' passages keep their numbers."""
    from caseweave.plans import catalogue

    documents_of(spark, tmp_path)
    chunks, fresh = catalogue.ingested(spark, str(tmp_path), "chunks"), catalogue.chunks_of(spark, str(tmp_path))
    assert "text" not in chunks.columns
    said = ["chunk_id", "kind", "value", "normalised", "char_start", "document_offset"]
    mentions = catalogue.ingested(spark, str(tmp_path), "mentions")
    assert sorted(map(tuple, mentions.select(said).collect())) == sorted(map(tuple, corpus.mentions(fresh, ("email", "phone")).select(said).collect())) and mentions.count() == 2
    numbers = {r.chunk_id: r.passage_no for r in chunks.collect()}
    assert all(r.passage_no == numbers[r.chunk_id] for r in mentions.collect())


def test_vectors_need_no_stored_texts(spark, tmp_path):
    from caseweave.plans import catalogue

    documents_of(spark, tmp_path)
    chunks, fresh = catalogue.ingested(spark, str(tmp_path), "chunks"), catalogue.chunks_of(spark, str(tmp_path))
    assert "text" not in chunks.columns
    vectors = catalogue.ingested(spark, str(tmp_path), "vectors").select("chunk_id", "embedding")
    want = fresh.select("chunk_id", catalogue.digest_vector(F.col("text")).alias("embedding"))
    assert sorted((r.chunk_id, tuple(r.embedding)) for r in vectors.collect()) == sorted((r.chunk_id, tuple(r.embedding)) for r in want.collect())


@pytest.mark.parametrize("copies", [2, 9])
def test_texts_of_documents_are_not_shuffled(spark, copies):
    """Whether copies are few or nearly all, ids are broadcast and texts stay where they are."""
    rows = spark.createDataFrame([(i, f"text {i % (20 // copies)}" if i < 20 else f"own {i}", None if i % 7 == 0 else "en", "s") for i in range(24 if copies == 9 else 90)], "doc_id long, text string, lang string, source string")
    docs = corpus.documents(rows)
    assert "Exchange hashpartitioning" not in plan_of(docs) and "SortMergeJoin" not in plan_of(docs)
    seen = corpus.observations(rows)
    want = seen.groupBy("document_id").agg(F.min("doc_id").alias("doc_id")).collect()
    assert sorted((r.document_id, r.doc_id) for r in docs.collect()) == sorted(map(tuple, want))


def test_windows_stream_texts_past_few_hits(spark):
    docs = spark.createDataFrame([("d", "a" * 3000), ("e", "b" * 3000)], "document_id string, text string")
    passages = corpus.chunks(docs.withColumns({"casefile_id": F.lit("c"), "doc_id": F.lit(1)}))
    hits = passages.filter("ordinal = 0").select(F.lit(1).alias("query_id"), F.when(F.col("document_id") == "d", 1).otherwise(2).alias("position"), "chunk_id")
    found = windows.result_windows(hits, store(passages), store(docs))
    plan = plan_of(found)
    assert plan.count("BroadcastHashJoin") >= 2
    assert [(r.position, r.window_end) for r in found.orderBy("position").collect()] == [(1, 3000), (2, 3000)]


def test_counts_of_terms_have_no_passage_as_key(spark):
    texts = ["Fox fox the", "", "fôx dog", "the 12 12 12", "!!"] * 2
    rows = spark.createDataFrame([(f"k{i}", "d", "c", i, t) for i, t in enumerate(texts)], PASSAGES)
    counts = corpus.term_counts(rows)
    plan = plan_of(counts)
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(chunk_id" not in plan
    postings, _ = corpus.postings(rows)
    want = postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))


def test_a_task_holds_a_bounded_number_of_rows(spark, monkeypatch):
    """However many order lines there are, those that a task sorts and groups stay about as many."""
    from caseweave.plans import catalogue, scan

    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"))
    monkeypatch.setattr(scan, "TASK_ROWS", 500)
    parts = scan.dealt(rows, "k")
    assert parts.rdd.getNumPartitions() == 40 and max(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()) < 1000
    islands = catalogue.section_islands(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity <= 45").count()
    assert islands.rdd.getNumPartitions() == -(-n // 500)  # one shuffle serves groups, windows and islands


def test_a_corpus_is_stored_once_and_goes_with_its_session(spark, tmp_path):
    """Each derived table has one set of files; those of an earlier session of the driver go when a later one derives."""
    import re
    from pathlib import Path

    from caseweave.plans import catalogue, library
    from caseweave.plans.durable import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    shared = Path(re.sub("^file:", "", spark.sparkContext._jsc.sc().getCheckpointDir().get()))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(shared.glob("table-*"))
    names = ["identities", "chunks", "postings", "statistics", "vectors"]
    for name in names:
        catalogue.ingested(spark, str(tmp_path), name)
    mine = set(shared.glob("table-*")) - before
    assert len(mine) == len(names)
    assert any(list(t.glob("*.zstd.parquet")) for t in mine)
    keys = [k for k in library._BUILT if k[1] == str(tmp_path)]
    for k in keys:
        library._BUILT["ended", *k[1:]] = library._BUILT.pop(k)
    catalogue.ingested(spark, str(tmp_path), "identities")
    assert len(set(shared.glob("table-*")) - before) == 1 and not mine & set(shared.glob("table-*"))


@pytest.mark.parametrize("name", ["search_fused_rrf", "search_keyword_filtered"])
def test_what_a_search_stores_is_less_than_its_input(spark, tmp_path, name):
    """All tables of a question's corpus together, postings of every term included, have fewer bytes than the documents they come from."""
    import os
    from pathlib import Path

    from caseweave.plans import catalogue, library
    from caseweave.plans.durable import stored_at

    os.symlink("/root/testdata/sf0.01/documents.parquet", f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() > 0
    tables = {k[2]: stored_at(df) for k, (_, df) in library._BUILT.items() if k[1] == str(tmp_path)}
    assert {"identities", "postings", "chunks", "statistics"} < set(tables)
    assert sum(p.stat().st_size for t in tables.values() for p in Path(t.removeprefix("file:")).glob("*.parquet")) < os.path.getsize(f"{tmp_path}/documents.parquet")


def test_a_corpus_goes_when_the_driver_ends(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from pathlib import Path
from caseweave.plans import catalogue
catalogue.ingested(spark, "/root/testdata/sf0.001", "statistics")
print("stored", len(list(Path("{tmp_path}/shared").glob("*/table-*"))))
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=180)
    assert "stored 4" in out.stdout, out.stderr[-2000:]
    for _ in range(60):  # the driver's JVM outlives its Python for a moment
        if not list(tmp_path.glob("shared/*/table-*")):
            break
        __import__("time").sleep(0.5)
    assert not list(tmp_path.glob("shared/*/table-*"))
