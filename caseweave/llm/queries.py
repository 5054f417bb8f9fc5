"""The queries opN_<name> over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import chat, decontam, langid, media, mixing, quality, secret_scan, sharding, simhash, urlfilter
from caseweave.llm.tables import documents, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs, langid.usable(F.col("doc_id"))))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digest(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(documents(spark, sf_dir)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_language": op5_language,
    "op6_media": op6_media,
    "op7_secrets": op7_secrets,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {
    "op2_url_filter": urlfilter.oracle_sql(),
    "op8_sharding": sharding.oracle_sql(),
    "op9_mixing": mixing.oracle_sql(),
}
