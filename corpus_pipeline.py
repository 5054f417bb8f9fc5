"""The training-data pipeline over ``documents``.

Each stage takes all that the one before kept and gives the columns of
``documents`` again, but for the last, which adds the shard. Its decisions:

1. language ID: documents of no language go (no letter, or noise);
2. SimHash near-dedup: of documents whose five-word shingles have a similarity
   of 0.8 or more, directly or through others, that of the smallest id stays;
3. decontamination: documents that hold a benchmark item go;
4. mixing: documents come as often as their source's target takes them, in
   training order (at most twice; some of a source above its target not at all);
5. sharding: every row gets a shard of bounded bytes.

Null ids, texts, languages and sources, repeated rows, empty tables and further
columns of any names have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import decontam, langid, mixing, sharding, simgroup
from caseweave.llm.tables import documents, table
from caseweave.plans.durable import discard, scratch, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs, langid.usable(F.col("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simgroup.keep_one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints, cross-parsing and WAND are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is a table in the shared folder until the next is written."""
    docs, last = documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch() as own:  # what a stage wrote on its way goes with it
            docs = own.keep(store(stage(spark, docs, sf_dir)))
        if last is not None:
            discard(last)
        last = docs
    return docs
