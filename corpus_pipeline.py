"""From documents to token digests: toxicity, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Rows without an id are
deduplicated like any other; null and empty texts are one text, of which one row
stays beside every document without it, is mixed by its source's threshold, and
encodes to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import bpe, pii, simhash_neardup, source_mixing, toxicity
from corpusloom.llm.labelled import fold
from corpusloom.session import configure, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return docs.where(toxicity.score(F.col("text"), machine) < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of the smallest id, then of the smallest text hash; null ids last.

    Only ids and text hashes of what goes are joined back; texts move only when
    those outgrow a broadcast.
    """
    marked = docs.select(COLUMNS).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = simhash_neardup.near_duplicates(marked, keep=["_hash"], root="_root")
    rows = stored(rows.select("doc_id", "_root", "_hash"), "components")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")))
    heads = rows.groupBy("_root").agg(least.alias("head")).select("head._id", "head._h")
    # What goes is found by id and hash, each pair once, so a large component is no hot key.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    pairs = stored(rows.groupBy("doc_id", "_hash").agg(F.count("*").alias("n")), "rows-by-hash")
    named = [F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")]
    goes = stored(pairs.join(heads, same, "left_anti").select(named), "near-duplicates")
    left = marked.join(goes, same, "left_anti")
    # Rows repeated under one id, or without one: few, found by id and hash alone.
    again = stored(pairs.where("n > 1").join(heads, same, "left_semi").select(named), "repeated-rows")
    once = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_hash"]))
    return once.select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the detector finds is replaced by a mark of its kind."""
    found = pii.detect(docs, keep=COLUMNS[1:])
    text = pii.redact(F.col("text"), F.concat("base", "added"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = source_mixing.mix_sources(docs, keep=COLUMNS[1:], copies="_copies")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    # Batches bounded by bytes: the stages before leave little of an executor's memory to its workers.
    configure(spark)
    path = public_tokenizers.path(VOCABULARY)
    return docs.select("doc_id", bpe.digests(spark, F.col("text"), path).alias("d")).select("doc_id", "d.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix),
    ("bpe", encode),
]

#: XXH64 fingerprints, trained models and merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
