"""Deterministic embeddings, the ledger of vectors, and staleness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import point_id
from corpusloom.operators.ingest import latest

BATCH = 32


def vectorize(text: str, dim: int) -> np.ndarray:
    """Bytes of SHA-256 over the text and a counter, mapped to [-1, 1], at unit length."""
    blocks = -(-dim // 32)
    raw = b"".join(hashlib.sha256(text.encode() + i.to_bytes(4, "big")).digest() for i in range(blocks))[:dim]
    v = np.frombuffer(raw, dtype=np.uint8) / 127.5 - 1.0
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def deterministic(dim: int) -> Callable[[list[str]], list[np.ndarray]]:
    """A provider: a function from a batch of texts to their vectors."""
    return lambda texts: [vectorize(t, dim) for t in texts]


def embed(text: Column, provider: Callable[[list[str]], list], dim: int, batch: int = BATCH) -> Column:
    """array<float> by any provider, called with at most `batch` texts; counts and sizes are checked."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        items = texts.fillna("").tolist()
        for at in range(0, len(items), batch):
            got = provider(items[at : at + batch])
            if len(got) != len(items[at : at + batch]) or any(len(v) != dim for v in got):
                raise ValueError("the provider gave other vectors than asked for")
            out += [np.asarray(v, dtype=np.float32) for v in got]
        return pd.Series(out)

    return run(text)


def ledger_rows(chunks: DataFrame, provider: str, model: str, version: int, dim: int) -> DataFrame:
    """One ledger row per chunk with its point id."""
    named = [F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(dim).alias("dimension")]
    return chunks.select("chunk_id", "document_id", *named, point_id(F.lit(provider), F.lit(model), F.lit(version), F.col("chunk_id")).alias("point_id"), F.lit("EMBEDDED").alias("status"))


def upsert_ledger(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace those of the same chunk, provider, model and version."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return latest(both, ["chunk_id", "provider", "model", "version"], F.desc("_new")).drop("_new")


def stale(versions: DataFrame, provider: str, model: str, version: int, dim: int) -> DataFrame:
    """Current versions with chunks whose vectors are missing or of another make.

    versions: document_id, is_current, chunk_count, embedding_provider, embedding_model, embedding_version, embedding_dimension, indexed_at.
    """
    same = (
        F.col("embedding_provider").eqNullSafe(F.lit(provider)) & F.col("embedding_model").eqNullSafe(F.lit(model))
        & F.col("embedding_version").eqNullSafe(F.lit(version)) & F.col("embedding_dimension").eqNullSafe(F.lit(dim))
    )
    return versions.where(F.col("is_current") & (F.col("chunk_count") > 0) & (~same | F.col("indexed_at").isNull()))


def delete_points(points: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """Points without those of the named documents, versions or ids."""
    return points.join(gone.select(key).distinct(), key, "left_anti")


def delete_old_versions(points: DataFrame, current: DataFrame) -> DataFrame:
    """Points of versions that are current."""
    return points.join(current.select("document_id", "version_number"), ["document_id", "version_number"], "left_semi")


def payload(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the fields of their version and document that searches filter by."""
    return chunks.join(versions, ["document_id", "version_number"]).join(documents, "document_id")


def check_dimension(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The points, failing at the first vector of another size."""
    wrong = F.raise_error(F.lit(f"a vector is not of size {dim}"))
    return points.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong.cast(dict(points.dtypes)[vector])))
