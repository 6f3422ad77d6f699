"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe as op9
from corpusloom.llm import knn_join as op7
from corpusloom.llm import license_scan as op3
from corpusloom.llm import minhash_neardup as op13
from corpusloom.llm import periodic_runs as op12
from corpusloom.llm import pii as op5
from corpusloom.llm import quality_model as op10
from corpusloom.llm import quality_rules as op1
from corpusloom.llm import simhash_neardup as op4
from corpusloom.llm import source_divergence as op11
from corpusloom.llm import source_mixing as op2
from corpusloom.llm import toxicity as op6
from corpusloom.llm import warc as op8
from corpusloom.llm.labelled import fold
from corpusloom.session import spread

#: Vocabulary file of the BPE query.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for the operators whose work is in Python workers, on as many tasks as a small table allows."""
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.quality_rules(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.mix_sources(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5.detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == op5.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(op5.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        op5.span_list(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select("doc_id", op3.scan_licenses(F.col("text")).alias("r"))
    return found.select("doc_id", *[f"r.{c}" for c in op3.FIELDS if c != "matches"])


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4.near_duplicates(texts(spark, sf_dir))
    return found.select("doc_id", op4.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _scored(docs: DataFrame, held: Column, score: Column, threshold: float) -> DataFrame:
    rows = docs.select("doc_id", held.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = texts(spark, sf_dir), fold(F.col("doc_id"), 4) == 2
    machine = op6.train(docs, table(spark, sf_dir, "labels"), ~held)
    return _scored(docs, held, op6.score(F.col("text"), machine), op6.THRESHOLD)


def op7_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.round_trip(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", op9.digests(spark, F.col("text"), path).alias("d")).select("doc_id", "d.*")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = texts(spark, sf_dir), fold(F.col("doc_id"), 5) == 0
    network = op10.train(docs, table(spark, sf_dir, "labels"), ~held)
    return _scored(docs, held, op10.score(F.col("text"), network), op10.THRESHOLD)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.divergence(texts(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.periodic_runs(texts(spark, sf_dir))


def op13_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.near_duplicates(texts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_knn_join": op7_knn_join,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_quality_model": op10_quality_model,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash_near_duplicates": op13_minhash_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": op1.ORACLE,
    "op2_mix_sources": op2.ORACLE,
    "op7_knn_join": op7.ORACLE,
    "op8_warc": op8.ORACLE,
    "op11_source_divergence": op11.ORACLE,
    "op12_periodic_runs": op12.ORACLE,
    "op13_minhash_near_duplicates": op13.ORACLE,
}
