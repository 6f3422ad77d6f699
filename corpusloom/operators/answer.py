"""Extractive answers, citations and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import answer_sentences, query_tokens, trim, ws_tokens

HISTORY = 4
MIN_SCORE = 0.01
MAX_SENTENCES = 3
# Fixed value: the answer where the sources do not suffice.
INSUFFICIENT = "I could not find enough information in the connected sources."


def conversation_query(messages: DataFrame, questions: DataFrame, last: int = HISTORY) -> DataFrame:
    """conv_id, query: the last messages of user and assistant, then the question.

    messages: conv_id, turn, role, content. The last ones are taken before roles
    and blanks are left out.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    recent = messages.withColumn("_p", place).where(F.col("_p") <= last)
    recent = recent.where(F.col("role").isin("user", "assistant") & (trim(F.coalesce("content", F.lit(""))) != ""))
    said = recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", trim(F.col("content")).alias("c")))), lambda m: m["c"]), " ").alias("_said"))
    return questions.join(said, "conv_id", "left").select("conv_id", trim(F.concat_ws(" ", "_said", trim(F.col("question")))).alias("query"))


def best_sentence(text: Column, question: Column) -> Column:
    """The sentence that shares most distinct terms with the question, the first of equals; the trimmed text if it has none."""
    terms = F.array_distinct(query_tokens(question))
    rated = F.transform(answer_sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(terms, query_tokens(s))).alias("n"), (-i).alias("back"), s.alias("s")))
    return F.coalesce(F.array_max(rated)["s"], trim(text))


def extractive_answers(questions: DataFrame, context: DataFrame) -> DataFrame:
    """qid, answer, evidence_status, used: up to three best sentences, each with its number.

    questions: qid, question. context: qid, position, chunk_id, text, score. No
    context, or none of a score over MIN_SCORE, is insufficient.
    """
    rows = context.join(questions, "qid").withColumn("_s", best_sentence(F.col("text"), F.col("question")))
    grouped = rows.groupBy("qid").agg(
        F.max("score").alias("_score"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("_s") != "", F.struct("position", F.col("_s").alias("s"), "chunk_id")))), 1, MAX_SENTENCES).alias("_used"),
    )
    answer = F.array_join(F.transform("_used", lambda u, i: F.format_string("%s [%d]", u["s"], i + 1)), " ")
    good = F.coalesce((F.col("_score") >= MIN_SCORE) & (F.size("_used") > 0), F.lit(False))
    return questions.join(grouped, "qid", "left").select(
        "qid", F.when(good, answer).otherwise(INSUFFICIENT).alias("answer"), F.when(good, "grounded").otherwise("insufficient").alias("evidence_status"),
        F.when(good, F.transform("_used", lambda u: u["chunk_id"])).otherwise(F.array().cast("array<string>")).alias("used"),
    )


def citations(hits: DataFrame) -> DataFrame:
    """qid, index, document_id, version_id, chunk_id: each source once, numbered by first appearance.

    hits: qid, position, document_id, version_id, chunk_id.
    """
    firsts = hits.groupBy("qid", "document_id", "version_id", "chunk_id").agg(F.min("position").alias("_at"))
    return firsts.withColumn("index", F.row_number().over(Window.partitionBy("qid").orderBy("_at"))).select("qid", "index", "document_id", "version_id", "chunk_id")


def token_usage(prompt: Column, answer: Column) -> Column:
    """Words of prompt and answer together."""
    return F.size(ws_tokens(prompt)) + F.size(ws_tokens(answer))
