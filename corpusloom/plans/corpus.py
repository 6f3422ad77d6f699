"""From parsed blocks to searchable chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chunk, embed, normalize, parse


#: Parsers that read the decoded text.
TEXT_PARSERS = ("txt", "markdown", "html")


def _readers(docs: DataFrame, words: DataFrame | None) -> dict:
    readers = {"txt": parse.text_blocks, "markdown": parse.markdown_blocks, "html": lambda d: parse.html_blocks(d, "text")}
    if "data" in docs.columns:
        readers["docx"] = parse.docx_blocks
    if words is not None:
        readers["pdf"] = lambda d: parse.pdf_word_blocks(words.join(d.select("doc_id"), "doc_id", "left_semi"))
    return readers


def blocks_of(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Sealed blocks of documents (doc_id, mime, filename, title, text), by the parser of their type.

    DOCX is read where docs has its bytes in column data, PDF where words, as for
    parse.pdf_word_blocks, are given. unsupported() lists what is not read.
    """
    readers = _readers(docs, words)
    rows = docs.withColumn("_parser", parse.parser_name(F.col("mime")))
    raw = None
    for name, read in readers.items():
        part = read(rows.where(F.col("_parser") == name))
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    return parse.seal(raw, rows.where(F.col("_parser").isin(*readers)))


def unsupported(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, mime of every document that blocks_of() with the same inputs does not read."""
    parser = parse.parser_name(F.col("mime"))
    return docs.where(parser.isNull() | ~parser.isin(*_readers(docs, words))).select("doc_id", "mime")


def unreadable(docs: DataFrame) -> DataFrame:
    """doc_id of DOCX documents (doc_id, mime, data) whose bytes are no such document."""
    found = parse.docx_blocks(docs.where(parse.parser_name(F.col("mime")) == "docx"))
    return found.where("block_type = 'error'").select("doc_id")


def searchable_chunks(blocks: DataFrame, dimension: int = 128, **chunking) -> DataFrame:
    """Chunks of normalised blocks with ids, parents and deterministic vectors."""
    clean = normalize.normalize_blocks(blocks).withColumn("text", F.coalesce("normalized_text", "text"))
    chunks = chunk.with_chunk_ids(chunk.chunk_parent_child(clean, **chunking))
    return chunks.withColumn("vector", embed.embed(F.col("text"), embed.deterministic(dimension), dimension))
