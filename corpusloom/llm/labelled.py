"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold of their own and give -1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trainable: Column, rows: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, y, text: at most `rows` labelled documents, chosen by hash, the same on every run.

    trainable is a condition on the id. Labels other than 0 and 1 are left out; of
    repeated labels the largest counts. Copies of an id stay, so that callers
    which gather rows reduce them by id first.
    """
    wanted = (
        labels.where(trainable & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    # At most `rows` pairs of numbers: the bound that makes the broadcast safe.
    return docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(wanted), id_col)
