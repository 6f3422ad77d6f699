"""Hosted models as functions that callers pass in: batches, retries, reranking and answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.answer import INSUFFICIENT, MIN_SCORE

#: A provider takes a batch of inputs and gives as many outputs, in their order.
Provider = Callable[[list], Sequence]


def with_retry(provider: Provider, attempts: int = 3, base_seconds: float = 3.0, limited_seconds: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """The provider, asked again after a failure with waits that double; longer ones where it says 429.

    An answer of another length than the batch counts as a failure. The last error is raised.
    """

    def call(batch: list) -> Sequence:
        for attempt in range(max(1, attempts)):
            try:
                got = provider(batch)
                if len(got) != len(batch):
                    raise ValueError("the provider gave another number of results than asked for")
                return got
            except Exception as error:  # noqa: BLE001 - whatever a hosted client raises
                if attempt + 1 >= max(1, attempts):
                    raise
                sleep((limited_seconds if "429" in str(error) else base_seconds) * 2**attempt)
        raise AssertionError

    return call


def in_batches(provider: Provider, items: list, size: int) -> list:
    """Results of all items, asked for `size` at a time."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return [x for at in range(0, len(items), size) for x in provider(items[at : at + size])]


def rerank_scores(query: Column, text: Column, provider: Provider, size: int = 32) -> Column:
    """Scores of (query, text) pairs by a provider, for retrieve.rerank(); tasks ask for their own rows."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(in_batches(provider, list(zip(queries.fillna(""), texts.fillna(""), strict=True)), size), dtype="float64")

    return run(query, text)


def prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """qid, question, prompt, used, grounded: the numbered context and the question, for a language model.

    context: qid, position, chunk_id, text, score. Its size is bounded by the context budget.
    """
    item = F.struct("position", "text", "chunk_id")
    grouped = context.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("_c"), F.max("score").alias("_score"))
    numbered = F.array_join(F.transform("_c", lambda c, i: F.format_string("[%d] %s", i + 1, c["text"])), "\n\n")
    good = F.coalesce(F.col("_score") >= MIN_SCORE, F.lit(False))
    return questions.join(grouped, "qid", "left").select(
        "qid", "question", F.concat(F.lit("Answer from the numbered sources only and cite them as [n].\n\n"), F.coalesce(numbered, F.lit("")), F.lit("\n\nQuestion: "), "question").alias("prompt"),
        F.coalesce(F.transform("_c", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("used"), good.alias("grounded"),
    )


def generated_answers(questions: DataFrame, context: DataFrame, provider: Provider, size: int = 8) -> DataFrame:
    """qid, answer, evidence_status, used: as answer.extractive_answers, with the wording of a provider.

    Questions without evidence are not sent.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        wanted = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        out[wanted] = in_batches(provider, texts[wanted].tolist(), size)
        return out

    rows = prompts(questions, context).withColumn("_a", run(F.when(F.col("grounded"), F.col("prompt"))))
    good = F.col("grounded") & (F.trim(F.coalesce("_a", F.lit(""))) != "")
    return rows.select(
        "qid", F.when(good, F.trim("_a")).otherwise(INSUFFICIENT).alias("answer"), F.when(good, "grounded").otherwise("insufficient").alias("evidence_status"),
        F.when(good, F.col("used")).otherwise(F.array().cast("array<string>")).alias("used"),
    )
