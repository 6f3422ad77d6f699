"""Chunks of documents and of block sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import DOCUMENT_NAMESPACE, uuid5
from corpusloom.functions.text import token_count, trim, ws_tokens

SIZE, OVERLAP, PARENT_MAX = 256, 32, 1024
HEADS = ("title", "heading")
ATOMIC = ("table", "code")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý\"'])")

PIECES = "array<struct<text:string,token_count:int,split:string,window_start:int>>"


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the chunk size")


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array of (text, token_count, window_start): windows of words, the last one reaching the end."""
    check_window(size, overlap)
    step = size - overlap
    tokens = ws_tokens(text)

    def windows(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.ceil((n - size) / F.lit(float(step))), F.lit(0)).cast("int")
        cut = lambda i: F.slice(words, i * step + 1, F.lit(size))
        made = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.array_join(cut(i), " ").alias("text"), F.size(cut(i)).alias("token_count"), (i * step).alias("window_start")),
        )
        return F.when(n > 0, made)

    # The words are bound once, as an element of a one-element array.
    return F.get(F.transform(F.array(tokens), windows), F.lit(0))


def chunk_fixed(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, ordinal, window_start, token_count, text."""
    pieces = F.posexplode(fixed_windows(F.col(text), size, overlap)).alias("ordinal", "c")
    return docs.select(id_col, pieces).select(id_col, "ordinal", "c.window_start", "c.token_count", "c.text")


def recursive_pieces(text: str | None, size: int, overlap: int) -> list[tuple]:
    """(text, words, how, start) of a text split at the widest separators that yield parts, packed greedily.

    An explicit stack of what is still to be cut stands for the recursion; packing
    never mixes the parts of different cuts.
    """
    out: list[tuple] = []
    todo: list[str | list] = [(text or "").strip()]
    while todo:
        body = todo.pop()
        if not isinstance(body, str):
            out.append(body[0])
            continue
        words = body.split()
        if not words:
            continue
        if len(words) <= size:
            out.append((body, len(words), "whole", None))
            continue
        cuts = (("paragraph", body.split("\n\n"), "\n\n"), ("line", body.split("\n"), " "), ("sentence", _SENTENCE.split(body), " "))
        for how, raw, joiner in cuts:
            parts = [p.strip() for p in raw if p.strip()]
            if len(parts) > 1:
                break
        else:
            for start in range(0, max(len(words) - overlap, 1), size - overlap):
                window = words[start : start + size]
                out.append((" ".join(window), len(window), "token", start))
            continue
        queue: list[str | list] = []
        held: list[str] = []
        used = 0
        for part in [*parts, None]:
            n = size + 1 if part is None else len(part.split())
            if held and used + n > size:
                joined = joiner.join(held)
                queue.append([(joined, len(joined.split()), how, None)])
                held, used = [], 0
            if part is not None and n > size:
                queue.append(part)
            elif part is not None:
                held.append(part)
                used += n
        todo.extend(reversed(queue))
    return out


def split_recursive(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array of (text, token_count, split, window_start)."""
    check_window(size, overlap)

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series) -> pd.Series:
        names = ("text", "token_count", "split", "window_start")
        return texts.map(lambda t: [dict(zip(names, p, strict=True)) for p in recursive_pieces(t, size, overlap)])

    return run(text)


def chunk_recursive(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, ordinal, split, window_start, token_count, text."""
    pieces = F.posexplode(split_recursive(F.col(text), size, overlap)).alias("ordinal", "c")
    return docs.select(id_col, pieces).select(id_col, "ordinal", "c.split", "c.window_start", "c.token_count", "c.text")


def active(blocks: DataFrame) -> DataFrame:
    """Blocks that are not dropped and hold more than white space, trimmed."""
    kept = blocks.where(~F.coalesce("dropped", F.lit(False))).withColumn("text", trim(F.coalesce("text", F.lit(""))))
    return kept.where(F.col("text") != "")


def blocks_text(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text: live blocks joined by blank lines."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return active(blocks).groupBy(id_col).agg(F.array_join(F.transform(rows, lambda b: b["text"]), "\n\n").alias("text"))


def sections(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, section_no, title, level, page, parts (text, block_type), body.

    A title or heading begins a section; what stands before the first is a
    section of level 0, named after the section its blocks were given.
    """
    head = F.col("block_type").isin(*HEADS)
    so_far = Window.partitionBy(id_col).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = active(blocks).withColumns({"_head": head, "section_no": F.sum(head.cast("int")).over(so_far)})
    level = F.coalesce(F.when(F.col("heading_level") != 0, F.col("heading_level")), F.when(F.col("block_type") == "title", 1).otherwise(2))
    part = F.struct("ordinal", "text", "block_type")
    first = lambda value, when: F.min(F.when(when, F.struct("ordinal", value.alias("v"))))["v"]
    grouped = rows.groupBy(id_col, "section_no").agg(
        first(F.col("text"), F.col("_head")).alias("_title"),
        first(level, F.col("_head")).alias("_level"),
        first(F.col("section"), ~F.col("_head") & (F.coalesce("section", F.lit("")) != "")).alias("_named"),
        first(F.col("page"), F.col("page").isNotNull()).alias("page"),
        F.array_sort(F.collect_list(F.when(~F.col("_head"), part))).alias("parts"),
    )
    title = F.coalesce("_title", "_named")
    pieces = F.concat(F.when(title.isNotNull(), F.array(title)).otherwise(F.array().cast("array<string>")), F.transform("parts", lambda p: p["text"]))
    return grouped.select(id_col, "section_no", title.alias("title"), F.coalesce("_level", F.lit(0)).alias("level"), "page", "parts", F.array_join(pieces, "\n\n").alias("body"))


def _numbered(chunks: DataFrame, id_col: str, *order: str) -> DataFrame:
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1)


def chunk_heading_aware(blocks: DataFrame, *, id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, ordinal, kind, section, heading_level, page, split, token_count, text.

    A section that fits is one chunk. Else its prose is split first, and tables
    and code follow, whole up to twice the size.
    """
    rows = sections(blocks, id_col)
    texts = lambda wanted: F.transform(F.filter("parts", wanted), lambda p: p["text"])
    prose = F.concat(F.when(F.col("title").isNotNull(), F.array("title")).otherwise(F.array().cast("array<string>")), texts(lambda p: ~p["block_type"].isin(*ATOMIC)))
    unit = lambda text, most: F.struct(text.alias("text"), F.lit(most).alias("most"))
    small = token_count(F.col("body")) <= size
    units = F.when(small, F.array(unit(F.col("body"), size))).otherwise(
        F.concat(F.array(unit(F.array_join(prose, "\n\n"), 0)), F.transform(texts(lambda p: p["block_type"].isin(*ATOMIC)), lambda t: unit(t, 2 * size)))
    )
    rows = rows.select(id_col, "section_no", F.col("title").alias("section"), F.col("level").alias("heading_level"), "page", F.posexplode_outer(units).alias("unit_no", "u"))
    # Outer, as a filter for empty arrays would be tried below the splitter and split every text twice; words are counted once.
    rows = rows.withColumn("_words", F.explode_outer(F.array(token_count(F.col("u.text")))))
    n = F.col("_words")
    whole = (F.col("u.most") > 0) & (n <= F.col("u.most"))
    pieces = split_recursive(F.when(~whole, F.col("u.text")), size, overlap)
    one = F.array(F.struct(F.col("u.text").alias("text"), n.cast("int").alias("token_count"), F.lit("atomic").alias("split"), F.lit(None).cast("int").alias("window_start")))
    rows = rows.withColumns({"_pieces": pieces, "_one": one, "_whole": whole})
    rows = rows.withColumn("_all", F.when(F.col("_whole"), F.col("_one")).otherwise(F.col("_pieces")))
    rows = rows.select(id_col, "section_no", "unit_no", "section", "heading_level", "page", F.posexplode_outer("_all").alias("piece_no", "c")).where(F.col("c").isNotNull())
    rows = _numbered(rows, id_col, "section_no", "unit_no", "piece_no")
    return rows.select(id_col, "ordinal", F.lit("leaf").alias("kind"), "section", "heading_level", "page", "c.split", "c.token_count", "c.text")


def chunk_parent_child(
    blocks: DataFrame, *, id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP, parent_max: int = PARENT_MAX
) -> DataFrame:
    """id, ordinal, kind, parent_ordinal, sole_section, section, heading_level, page, token_count, text.

    Each section is a parent, cut after parent_max words; its children split the
    whole section. A single child equal to its parent is left out.
    """
    rows = sections(blocks, id_col).withColumn("_n", token_count(F.col("body")))
    parent = F.when(F.col("_n") <= parent_max, F.col("body")).otherwise(F.array_join(F.slice(ws_tokens(F.col("body")), 1, parent_max), " "))
    rows = rows.withColumns({"_parent": parent, "_pieces": split_recursive(F.col("body"), size, overlap)})
    sole = (F.size("_pieces") == 1) & (F.get("_pieces", F.lit(0))["text"] == F.col("_parent"))
    rows = rows.withColumn("_sole", sole)
    item = lambda kind, text, n: F.struct(F.lit(kind).alias("kind"), text.alias("text"), n.cast("int").alias("token_count"))
    children = F.when(F.col("_sole"), F.array().cast("array<struct<kind:string,text:string,token_count:int>>")).otherwise(
        F.transform("_pieces", lambda p: item("child", p["text"], p["token_count"]))
    )
    items = F.concat(F.array(item("parent", F.col("_parent"), F.least("_n", F.lit(parent_max)))), children)
    # Never empty; outer, as else a filter for that would split every text twice.
    rows = rows.select(id_col, "section_no", "_sole", F.col("title").alias("section"), F.col("level").alias("heading_level"), "page", F.posexplode_outer(items).alias("item_no", "c"))
    rows = _numbered(rows, id_col, "section_no", "item_no")
    mine = Window.partitionBy(id_col, "section_no")
    up = F.when(F.col("c.kind") == "child", F.min("ordinal").over(mine))
    return rows.select(
        id_col, "ordinal", "c.kind", up.alias("parent_ordinal"), (F.col("_sole") & (F.col("c.kind") == "parent")).alias("sole_section"),
        "section", "heading_level", "page", "c.token_count", "c.text",
    )


def run_chunker(blocks: DataFrame, strategy: str = "parent_child", *, id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP, parent_max: int = PARENT_MAX) -> DataFrame:
    """Chunks of blocks by a named strategy."""
    if strategy == "fixed":
        return chunk_fixed(blocks_text(blocks, id_col), id_col=id_col, size=size, overlap=overlap)
    if strategy == "recursive":
        return chunk_recursive(blocks_text(blocks, id_col), id_col=id_col, size=size, overlap=overlap)
    if strategy == "heading_aware":
        return chunk_heading_aware(blocks, id_col=id_col, size=size, overlap=overlap)
    if strategy == "parent_child":
        return chunk_parent_child(blocks, id_col=id_col, size=size, overlap=overlap, parent_max=parent_max)
    raise ValueError(f"unknown chunk strategy {strategy!r}")


def with_chunk_ids(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add chunk_id, the same for the same version and ordinal, and parent_chunk_id."""
    name = lambda ordinal: uuid5(DOCUMENT_NAMESPACE, F.concat_ws("|", F.col(id_col).cast("string"), ordinal.cast("string")))
    up = F.col("parent_ordinal") if "parent_ordinal" in chunks.columns else F.lit(None).cast("int")
    return chunks.withColumns({"chunk_id": name(F.col("ordinal")), "parent_chunk_id": F.when(up.isNotNull(), name(up))})


def kind_counts(chunks: DataFrame) -> DataFrame:
    """kind, n, tokens."""
    return chunks.groupBy("kind").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
