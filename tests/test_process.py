"""Processing with quarantine, providers with retries, hydration, syncs, sitemaps and the paged source, by literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed, provide
from corpusloom.plans import corpus, process
from corpusloom.session import configure
from corpusloom.sources import connectors, feeds

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def test_processing_quarantines_what_it_cannot_read_and_goes_on(spark):
    docs = spark.createDataFrame(
        [("a", bytearray(b"Title\n\nBody of a."), "text/plain", "a.txt", None), ("b", bytearray(b"not a zip"), DOCX, "b.docx", None), ("c", None, "text/plain", "c.txt", None),
         ("d", bytearray(b"x"), "image/png", "d.png", None), ("e", bytearray(b"%PDF"), "application/pdf", "e.pdf", None), ("f", bytearray(b"Same"), "text/plain", "f.txt", None),
         ("g", bytearray(b"Again"), "text/markdown", "g.md", None)],
        "document_id string, data binary, mime_type string, filename string, title string",
    )
    hashes = {r.document_id: r.h for r in docs.select("document_id", F.sha2("data", 256).alias("h")).collect()}
    current = spark.createDataFrame([("f", hashes["f"], 3, "INDEXED"), ("g", hashes["g"], 2, "FAILED"), ("a", "other", 7, "INDEXED")], "document_id string, content_hash string, version_number int, state string")
    done = process.process_documents(docs, current)
    got = {r.document_id: (r.status, r.version_number, r.reason) for r in done.outcomes.collect()}
    assert got == {
        "a": ("SUCCEEDED", 8, None), "b": ("FAILED", 1, "corrupt or unreadable"), "c": ("FAILED", 1, "no bytes"), "d": ("FAILED", 1, "unsupported type"),
        "e": ("FAILED", 1, "no reader for this type"), "f": ("SKIPPED_UNCHANGED", 3, None), "g": ("SUCCEEDED", 2, None),
    }
    assert {r.document_id for r in done.chunks.collect()} == {"a", "g"}
    assert sorted(r.document_id for r in done.quarantine.collect()) == ["b", "c", "d", "e"]
    words = spark.createDataFrame([("e", 1, 10.0, 5.0, 10.0, "Hello"), ("e", 1, 40.0, 5.0, 10.0, "words")], "doc_id string, page int, x0 double, top double, size double, text string")
    got = {r.document_id: r.status for r in process.process_documents(docs, current, words).outcomes.collect()}
    assert got["e"] == "SUCCEEDED"
    assert process.process_documents(docs.limit(0), current).outcomes.count() == 0


def test_unsupported_lists_everything_that_is_not_parsed(spark):
    rows = spark.createDataFrame([(1, "text/plain"), (2, "application/pdf"), (3, DOCX), (4, "image/png"), (5, None)], "doc_id int, mime string")
    assert sorted(r.doc_id for r in corpus.unsupported(rows).collect()) == [2, 3, 4, 5]
    assert sorted(r.doc_id for r in corpus.unsupported(rows.withColumn("data", F.lit(b"x"))).collect()) == [2, 4, 5]


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise RuntimeError("429 too many" if len(calls) == 1 else "down")
        return batch

    assert provide.with_retry(flaky, 4, 3.0, 5.0, waits.append)([1, 2]) == [1, 2] and waits == [5.0, 6.0]
    with pytest.raises(ValueError, match="another number"):
        provide.with_retry(lambda b: b[:1], 2, sleep=waits.append)([1, 2])
    assert provide.in_batches(lambda b: [len(b)] * len(b), list("abcde"), 2) == [2, 2, 2, 2, 1]


def test_generated_answers_and_hosted_scores(spark):
    questions = spark.createDataFrame([("1", "why?"), ("2", "none?")], "qid string, question string")
    context = spark.createDataFrame([("1", 2, "c2", "second", 0.5), ("1", 1, "c1", "first", 0.9), ("2", 1, "c3", "weak", 0.001)], "qid string, position int, chunk_id string, text string, score double")
    model = provide.with_retry(lambda batch: [p.split("\n\n")[1] for p in batch])
    got = {r.qid: r for r in provide.generated_answers(questions, context, model).collect()}
    assert (got["1"].answer, got["1"].evidence_status, got["1"].used) == ("[1] first", "grounded", ["c1", "c2"])
    assert got["2"].evidence_status == "insufficient" and got["2"].used == []
    scores = context.select(provide.rerank_scores(F.col("chunk_id"), F.col("text"), lambda b: [float(len(t)) for _, t in b], 2).alias("s"))
    assert sorted(r.s for r in scores.collect()) == [4.0, 5.0, 6.0]


def test_embedding_skips_what_the_ledger_has(spark):
    chunks = spark.createDataFrame([("c1", "d", "x"), ("c2", "d", "y")], "chunk_id string, document_id string, text string")
    ledger = embed.ledger_rows(chunks.where("chunk_id = 'c1'"), "p", "m", 1, 4)
    points, after = process.embed_documents(chunks, ledger, embed.deterministic(4), provider="p", model="m", version=1, dimension=4)
    assert [r.chunk_id for r in points.collect()] == ["c2"] and after.count() == 2
    assert process.embed_documents(chunks, ledger, embed.deterministic(4), provider="p", model="m", version=2, dimension=4)[0].count() == 2


def test_hydrated_metadata_prefers_the_chunk(spark):
    configure(spark)
    hits = spark.createDataFrame([("q", "c", 1, 0.5)], "qid string, chunk_id string, rank int, score double")
    chunks = spark.createDataFrame([("c", "d", "t", 1, "s", {"k": "chunk"}, "p", 9)], "chunk_id string, document_id string, text string, page int, section string, extra map<string,string>, parent_chunk_id string, token_count int")
    documents = spark.createDataFrame([("d", "T", "files", "u", {"k": "document", "o": "x"})], "document_id string, title string, source_type string, source_url string, metadata map<string,string>")
    assert process.hydrate(hits, chunks, documents).first().metadata == {"k": "chunk", "o": "x", "parent_chunk_id": "p", "token_count": "9"}


def test_sitemaps_and_canonical_addresses(spark):
    body = "<urlset><url><loc> http://a/1?x=1&amp;y=2 </loc><lastmod>2024-01-01</lastmod></url><url>\n<loc>http://a/2</loc></url></urlset>"
    got = sorted(map(tuple, feeds.sitemap_urls(spark.createDataFrame([(body,)], "body string")).collect()))
    assert got == [("http://a/1?x=1&y=2", "2024-01-01"), ("http://a/2", None)]
    previous = spark.createDataFrame([("http://a/1", "e1"), ("http://a/2", "e2"), ("http://a/3", "e3")], "url string, etag string")
    fetched = spark.createDataFrame([("http://a/one", 200, "new", "<link href='http://a/1' rel='canonical'>"), ("http://a/2", 304, "e2", "")], "url string, status int, etag string, html string")
    listed = spark.createDataFrame([("http://a/1",)], "url string")
    assert sorted(map(tuple, feeds.website_changes(previous, fetched, listed).collect())) == [("http://a/1", "upsert"), ("http://a/2", "unchanged"), ("http://a/3", "delete")]
    assert feeds.website_changes(previous, fetched).count() == 2


def test_paged_source_follows_cursors(spark):
    def fetch(url, cursor):
        n = int(cursor or 0)
        return {"items": [{"id": f"{url}-{n}", "deleted": n == 1}], **({"next_cursor": str(n + 1)} if n < 2 else {})}

    spark.dataSource.register(connectors.rest_source(fetch, "fake_pages"))
    pages = spark.read.format("fake_pages").option("url", "s1, s2").load()
    assert pages.count() == 6
    assert sorted((r.id, r.op) for r in feeds.rest_items(pages).collect()) == [(f"s{s}-{n}", "delete" if n == 1 else "upsert") for s in (1, 2) for n in range(3)]
    assert connectors.connector("WEBSITE") is feeds.website_changes
    for bad in ("FILE_UPLOAD", "FAX"):
        with pytest.raises(ValueError, match="sync|unsupported"):
            connectors.connector(bad)


def test_paged_source_as_a_stream_reads_each_page_once(spark, tmp_path):
    """Services grow between runs; a run goes on from the checkpoint of the one before."""
    grown = tmp_path / "grown"
    name = str(grown)

    def fetch(url, cursor):
        with open(name) as f:
            pages = int(f.read())
        n = int(cursor or 0)
        return {"items": [{"id": f"{url}-{n}", "deleted": False}], **({"next_cursor": str(n + 1)} if n + 1 < pages else {})}

    spark.dataSource.register(connectors.rest_source(fetch, "fake_stream"))
    for pages in (2, 2, 5):
        grown.write_text(str(pages))
        stream = spark.readStream.format("fake_stream").option("url", "s1, s2").option("pages_per_batch", "2").load()
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
        rows = spark.read.schema("url string, page int, cursor string, body string").parquet(f"file://{tmp_path}/out")
        assert sorted((r.url, r.page) for r in rows.collect()) == [(s, n) for s in ("s1", "s2") for n in range(pages)]
    assert sorted(r.id for r in feeds.rest_items(rows).collect()) == [f"s{s}-{n}" for s in (1, 2) for n in range(5)]
