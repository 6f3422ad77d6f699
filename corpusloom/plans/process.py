"""From bytes to chunks with a side for what cannot be read, and from chunks to stored vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chunk, embed, ingest, normalize, parse
from corpusloom.plans import corpus
from corpusloom.session import stored


@dataclass(frozen=True)
class Processed:
    """outcomes: a row per document; chunks of what could be read; quarantine: document_id, reason of what could not."""

    outcomes: DataFrame
    chunks: DataFrame
    quarantine: DataFrame


def process_documents(docs: DataFrame, current: DataFrame, words: DataFrame | None = None, **chunking) -> Processed:
    """Parse, normalise and chunk the documents whose bytes are new or whose work is unfinished.

    docs: document_id, data, mime_type, filename, title. current: document_id,
    content_hash, version_number, state. words: as parse.pdf_word_blocks, for PDF.
    New bytes give a new version; the same bytes in an unfinished state are read
    again under their version. No bytes, a type without a reader and bytes that a
    reader rejects are quarantined; one such document stops no other.
    """
    have = current.select("document_id", F.col("content_hash").alias("_hash"), F.col("version_number").alias("_version"), F.col("state").alias("_state"))
    jobs = docs.withColumn("content_hash", F.sha2("data", 256)).join(have, "document_id", "left")
    same = F.col("content_hash").eqNullSafe(F.col("_hash")) & (F.coalesce("_version", F.lit(0)) > 0)
    readable = [*corpus.TEXT_PARSERS, "docx", *(["pdf"] if words is not None else [])]
    parser = parse.parser_name(F.col("mime_type"))
    jobs = stored(
        jobs.select(
            "document_id", "data", F.col("mime_type").alias("mime"), "filename", "title", "content_hash", F.coalesce(same & F.col("_state").isin(*ingest.FINISHED), F.lit(False)).alias("skip"),
            F.when(same, F.col("_version")).otherwise(F.coalesce("_version", F.lit(0)) + 1).alias("version_number"),
            F.when(F.coalesce(F.octet_length("data"), F.lit(0)) == 0, "no bytes").when(parser.isNull(), "unsupported type").when(~parser.isin(*readable), "no reader for this type").alias("reason"),
        ),
        "jobs",
    )
    todo = jobs.where(~F.col("skip") & F.col("reason").isNull()).withColumn("doc_id", F.col("document_id")).withColumn("text", F.when(F.col("mime").rlike("text|html"), parse.decode_bytes(F.col("data"))))
    blocks = corpus.blocks_of(todo.select("doc_id", "mime", "filename", "title", "text", "data"), words)
    clean = normalize.normalize_blocks(blocks).withColumn("text", F.coalesce("normalized_text", "text"))
    chunks = stored(chunk.with_chunk_ids(chunk.run_chunker(clean, **chunking)).withColumnRenamed("doc_id", "document_id"), "chunks")
    broken = corpus.unreadable(todo.select("doc_id", "mime", "data")).select(F.col("doc_id").alias("document_id"), F.lit("corrupt or unreadable").alias("_broken"))
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    rows = jobs.drop("data").join(broken, "document_id", "left").join(counted, "document_id", "left").withColumn("reason", F.coalesce("reason", "_broken"))
    rows = rows.withColumn("reason", F.when(~F.col("skip"), F.col("reason")))
    status = F.when(F.col("skip"), "SKIPPED_UNCHANGED").when(F.col("reason").isNotNull(), "FAILED").otherwise("SUCCEEDED")
    outcomes = rows.select("document_id", status.alias("status"), "version_number", "content_hash", "reason", F.when(F.col("reason").isNull(), F.coalesce("n_chunks", F.lit(0))).otherwise(0).cast("long").alias("n_chunks"))
    failed = outcomes.where("status = 'FAILED'").select("document_id", "reason")
    return Processed(outcomes, chunks.join(failed.select("document_id"), "document_id", "left_anti"), failed)


def replace_chunks(old: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    """The chunk table after a run: chunks of processed documents go, the fresh ones come."""
    return old.join(processed.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def embed_documents(chunks: DataFrame, ledger: DataFrame, embedder: Callable[[list[str]], list], *, provider: str, model: str, version: int, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(points, ledger): vectors of the chunks that the ledger does not have in this make, and the ledger with them.

    chunks: chunk_id, document_id, text. ledger: as embed.ledger_rows.
    """
    made = ledger.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("version") == version) & (F.col("dimension") == dimension))
    missing = chunks.join(made.select("chunk_id"), "chunk_id", "left_anti")
    rows = embed.ledger_rows(missing, provider, model, version, dimension)
    vectors = missing.select("chunk_id", embed.embed(F.col("text"), embedder, dimension).alias("vector"))
    return rows.select("chunk_id", "document_id", "point_id").join(vectors, "chunk_id"), embed.upsert_ledger(ledger, rows)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the fields of their chunk and document; metadata of both merged, the chunk's entries counting.

    hits: qid, chunk_id, rank, score. chunks: chunk_id, document_id, text, page,
    section, extra (map), parent_chunk_id, token_count. documents: document_id,
    title, source_type, source_url, metadata (map). Needs LAST_WIN maps (session.SETTINGS).
    """
    none = F.create_map().cast("map<string,string>")
    own = F.create_map(F.lit("parent_chunk_id"), F.col("parent_chunk_id").cast("string"), F.lit("token_count"), F.col("token_count").cast("string"))
    merged = F.map_concat(F.coalesce("metadata", none), F.coalesce("extra", none), own)
    return hits.join(chunks, "chunk_id").join(documents, "document_id").withColumn("metadata", merged).drop("extra")


def start_syncs(requests: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """source_id, key, job_id, status, refusal: one active sync for each source.

    requests: source_id, job_id. A source whose sync waits or runs gets that job
    again, otherwise its first request becomes a queued job. jobs: job_id, key, status, created_at.
    """
    first = requests.groupBy("source_id").agg(F.min("job_id").alias("_new"))
    asked = ingest.accepted_work(first, sources, sync=True).withColumn("key", F.concat(F.lit("source-sync:"), F.col("source_id").cast("string")))
    live = ingest.coalesce_jobs(jobs).where(F.col("status").isin("QUEUED", "RUNNING")).select("key", F.col("job_id").alias("_job"), F.col("status").alias("_status"))
    rows = asked.join(live, "key", "left")
    free = F.col("refusal").isNull()
    return rows.select("source_id", "key", F.when(free, F.coalesce("_job", "_new")).alias("job_id"), F.when(free, F.coalesce("_status", F.lit("QUEUED"))).alias("status"), "refusal")


def list_page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of a list in the given order."""
    return rows.orderBy(*order).offset(offset).limit(limit)
