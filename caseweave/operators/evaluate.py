"""Retrieval quality: recall and reciprocal rank of ranked answers, per leg and language."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.errors import ValidationError
from caseweave.functions.text import SPACE, strip

KS, MRR_AT = (1, 5, 10), 10
TOLERANCE = 0.005


def squeezed(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, f"[{SPACE}]+", " ")))


def is_relevant(filename: Column, text: Column, wanted_file: Column, phrase: Column) -> Column:
    """The named file, and the phrase in it whatever the case and white space."""
    return (filename == wanted_file) & squeezed(text).contains(squeezed(phrase))


def metrics(ranked: DataFrame, queries: DataFrame, by: tuple[str, ...] = ("leg",)) -> DataFrame:
    """Means over queries of ``ranked(query_id, leg, rank, relevant)``: recall at 1, 5, 10 and MRR at 10.

    ``queries(query_id, …)`` are all queries asked of each leg, also those
    without an answer, and bring further columns of ``by``.
    """
    best = ranked.filter("relevant").groupBy("query_id", "leg").agg(F.min("rank").alias("best"))
    asked = queries.crossJoin(F.broadcast(ranked.select("leg").distinct()))  # a handful of legs
    rows = asked.join(best, ["query_id", "leg"], "left")
    recall = [F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in KS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *recall, F.avg(F.when(F.col("best") <= MRR_AT, 1.0 / F.col("best")).otherwise(0.0)).alias("mrr_at_10"))


def regressions(measured: DataFrame, baseline: DataFrame, key: str = "leg", tolerance: float = TOLERANCE) -> DataFrame:
    """(leg, metric, before, now) of every metric that fell by more than the tolerance."""
    names = [f"recall_at_{k}" for k in KS] + ["mrr_at_10"]
    long = lambda df, n: df.select(key, F.explode(F.create_map(*(x for m in names for x in (F.lit(m), F.col(m))))).alias("metric", n))
    return long(baseline, "before").join(long(measured, "now"), [key, "metric"]).filter(F.col("now") < F.col("before") - tolerance)


def comparable(measured: dict, baseline: dict) -> list[str]:
    """The conditions in which two measurements differ; none, if they may be compared."""
    return sorted(k for k in measured.keys() | baseline.keys() if measured.get(k) != baseline.get(k))


def judged(answers: DataFrame, judgements: DataFrame) -> DataFrame:
    """``answers(query_id, leg, rank, filename, text)`` with ``relevant``: whether any judgement of the query is met."""
    wanted = judgements.select("query_id", F.col("filename").alias("wanted_file"), "phrase")
    met = is_relevant(F.col("filename"), F.col("text"), F.col("wanted_file"), F.col("phrase"))
    rows = answers.join(F.broadcast(wanted), "query_id").groupBy("query_id", "leg", "rank").agg(F.max(met).alias("relevant"))
    return rows


def by_leg_and_language(answers: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of each leg, metrics of the fused leg in each language) of the answers to a set of judgements."""
    queries = judgements.select("query_id", "language").distinct()
    rows = judged(answers, judgements)
    fused = metrics(rows.filter("leg = 'fused'"), queries, ("language",))
    return metrics(rows, queries), fused


def measurement(conditions: dict, legs: DataFrame, languages: DataFrame) -> dict:
    """A measurement as plain values."""
    rows = lambda df, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
    return {"conditions": conditions, "metrics": rows(legs, "leg"), "by_language": rows(languages, "language")}


def write_baseline(path: str, conditions: dict, legs: DataFrame, languages: DataFrame) -> dict:
    """Record a measurement as JSON, conditions and all; what was written is returned."""
    out = measurement(conditions, legs, languages)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2, sort_keys=True)
    return out


def load_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, language, filename, phrase) from a JSON list; an ``also`` entry is another row of its query.

    A judgement with an empty field is an error.
    """
    schema = "query string, language string, filename string, phrase string, also array<struct<filename: string, phrase: string>>"
    given = spark.read.schema(schema).option("multiLine", "true").json(path)
    blank = [F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in ("query", "language", "filename", "phrase")]
    if not given.filter(blank[0] | blank[1] | blank[2] | blank[3]).isEmpty():
        raise ValidationError(f"{path} has a judgement with an empty field")
    answers = F.concat(F.array(F.struct("filename", "phrase")), F.coalesce("also", F.array().cast("array<struct<filename: string, phrase: string>>")))
    return given.select(F.xxhash64("query", "language").alias("query_id"), "query", "language", F.explode(answers).alias("a")).select("query_id", "query", "language", "a.filename", "a.phrase")
