"""From parsed blocks to clean blocks and one normalised text per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import sha256_text, simhash64
from corpusloom.functions.text import detect_language, is_boilerplate, latin_tokens, normalize_block

PAGE_TYPES = ("paragraph", "heading")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Add normalized_text, dropped and drop_reason (empty, boilerplate)."""
    rows = blocks.withColumn("normalized_text", normalize_block(F.coalesce("text", F.lit("")), F.col("block_type")))
    rows = rows.withColumn("normalized_text", F.when(F.col("normalized_text") != "", F.col("normalized_text")))
    reason = F.when(F.col("normalized_text").isNull(), "empty").when(is_boilerplate(F.col("normalized_text"), F.col("block_type")), "boilerplate")
    return rows.withColumn("drop_reason", reason).withColumn("dropped", F.col("drop_reason").isNotNull())


def drop_page_furniture(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Drop the first and the last live text block of pages where the same text leads or ends two pages or more.

    The footer reason wins where one block is both.
    """
    live = ~F.col("dropped") & F.col("page").isNotNull() & F.col("block_type").isin(*PAGE_TYPES)
    # All windows are within a document: dealt out once by it, and ends of pages are found without an order.
    rows = blocks.repartition(id_col).withColumns({"_live": live, "_text": F.xxhash64("normalized_text")})
    page = Window.partitionBy(id_col, "page", "_live")
    rows = rows.withColumns({"_low": F.min("ordinal").over(page), "_high": F.max("ordinal").over(page)})
    rows = rows.withColumns({"_first": F.col("_live") & (F.col("ordinal") == F.col("_low")), "_last": F.col("_live") & (F.col("ordinal") == F.col("_high"))})
    same = lambda flag: F.sum(F.col(flag).cast("int")).over(Window.partitionBy(id_col, "_text")) >= 2
    reason = F.when(F.col("_last") & same("_last"), "footer").when(F.col("_first") & same("_first"), "header").otherwise(F.col("drop_reason"))
    rows = rows.withColumn("drop_reason", reason).withColumn("dropped", F.col("drop_reason").isNotNull())
    return rows.drop("_live", "_text", "_low", "_high", "_first", "_last")


def normalize_blocks(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return drop_page_furniture(clean_blocks(blocks), id_col)


def fingerprint_text(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text: kept blocks joined by line ends, titles only if nothing else is left."""
    row = F.struct("ordinal", "normalized_text")
    kept = ~F.col("dropped") & F.col("normalized_text").isNotNull()
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda b: b["normalized_text"]), "\n")
    grouped = blocks.groupBy(id_col).agg(
        F.collect_list(F.when(kept, row)).alias("_all"), F.collect_list(F.when(kept & (F.col("block_type") != "title"), row)).alias("_body")
    )
    return grouped.select(id_col, F.when(F.size("_body") > 0, joined(F.col("_body"))).otherwise(joined(F.col("_all"))).alias("text"))


def describe(texts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, language, content_hash, simhash of normalised texts."""
    return texts.select(
        id_col, detect_language(latin_tokens(F.col(text))).alias("language"), sha256_text(F.col(text)).alias("content_hash"), simhash64(F.col(text)).alias("simhash")
    )
