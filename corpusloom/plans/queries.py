"""Queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can tell."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import hashing, text
from corpusloom.operators import answer, chunk, dedup, embed, evaluate, ingest, inverted, keyed, normalize, parse, retrieve, vector_index
from corpusloom.plans import corpus, search
from corpusloom.sources import feeds, files, tables
from corpusloom.session import configure, new_folder, spread, stored
from corpusloom.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(configure(spark), sf_dir)

        QUERIES[make.__name__] = run
        if sql is not None:
            ORACLE_SQL[make.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of long texts, whose work is in the row.
TEXTS = ("documents", "pages", "conversations")


# --- tokens, hashes, language -------------------------------------------------------

WINDOWS = """
t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
c AS (SELECT doc_id, CAST(i AS INTEGER) AS ordinal, list_slice(w, i * 224 + 1, i * 224 + 256) AS s
      FROM t, unnest(range(0, CAST(greatest(ceil((len(w) - 256) / 224.0), 0) AS BIGINT) + 1)) r(i) WHERE len(w) > 0)"""
LATIN = "list_transform(regexp_extract_all(text, '[A-Za-z0-9À-ÿ'']+'), lambda x: lower(x))"
QTERMS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda x: lower(x))"


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n_tokens, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS INTEGER) AS n_terms FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"), F.size(text.query_tokens(F.col("text"))).alias("n_terms"))


@query(f"WITH {WINDOWS} SELECT doc_id, ordinal, ordinal * 224 AS window_start, CAST(len(s) AS INTEGER) AS token_count, md5(array_to_string(s, ' ')) AS text_md5 FROM c")
def chunk_fixed(spark, sf_dir):
    rows = chunk.chunk_fixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "ordinal", "window_start", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS content_hash FROM documents")
def normalized_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.sha256_text(text.normalize_text(F.col("text"))).alias("content_hash"))


def _stop_sql() -> str:
    share = lambda words: f"len(list_filter(k, lambda x: list_contains([{', '.join(repr(w) for w in words)}], x)))"
    cols = ", ".join(f"{share(w)} AS {lang}" for lang, w in text.STOPWORDS.items())
    best = "greatest(en, fr, de, es)"
    pick = " ".join(f"WHEN {lang} = {best} THEN '{lang}'" for lang in text.STOPWORDS)
    return f"""WITH a AS (SELECT doc_id, {LATIN} AS k FROM documents), b AS (SELECT doc_id, len(k) AS n, {cols} FROM a)
    SELECT doc_id, CASE WHEN n < 8 OR {best} / greatest(n, 1) < 0.06 THEN 'und' {pick} END AS language FROM b"""


@query(_stop_sql())
def language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(text.latin_tokens(F.col("text"))).alias("language"))


# --- duplicates ----------------------------------------------------------------------


def _fingerprinted(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = hashing.simhash64_md5(docs, "doc_id", "text")
    rows = docs.select("doc_id", hashing.sha256_text(text.normalize_text(F.col("text"))).alias("content_hash")).join(prints.hint("merge"), "doc_id")
    return rows.select((F.col("doc_id") % 3).alias("org"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), "content_hash", "simhash")


HASHED = "h AS (SELECT doc_id, doc_id % 3 AS org, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS hash FROM documents)"


@query(
    f"""WITH {HASHED}, f AS (SELECT *, min(doc_id) OVER (PARTITION BY org, hash) AS first FROM h)
    SELECT org, first AS canonical_id, doc_id AS duplicate_id, 'exact' AS kind, CAST(1.0 AS DOUBLE) AS score FROM f WHERE doc_id > first"""
)
def exact_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 3).alias("org"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"),
        hashing.sha256_text(text.normalize_text(F.col("text"))).alias("content_hash"),
    )
    return dedup.exact_duplicates(rows)


def _near_sql() -> str:
    bits = ", ".join(f"(sum(CAST((v >> {b}) & 1 AS INTEGER) * 2 - 1) >= 0) AS b{b}" for b in range(64))
    value = " | ".join(f"(CASE WHEN b{b} THEN CAST(1 AS UBIGINT) << {b} ELSE CAST(0 AS UBIGINT) END)" for b in range(64))
    return f"""WITH {HASHED},
    k AS (SELECT doc_id, CAST('0x' || substr(md5(u), 1, 16) AS UBIGINT) AS v FROM (SELECT doc_id, unnest({LATIN}) AS u FROM documents)),
    s AS (SELECT doc_id, {value} AS p FROM (SELECT doc_id, {bits} FROM k GROUP BY doc_id)),
    d AS (SELECT h.*, s.p, doc_id > min(doc_id) OVER (PARTITION BY org, hash) AS later FROM h JOIN s USING (doc_id) WHERE s.p <> 0),
    n AS (SELECT org, p, min(doc_id) AS doc_id FROM d GROUP BY org, p)
    SELECT a.org, a.doc_id AS canonical_id, b.doc_id AS duplicate_id, 'near' AS kind, round(1.0 - bit_count(xor(a.p, b.p)) / 64.0, 4) AS score
    FROM n a JOIN d b ON a.org = b.org AND a.doc_id < b.doc_id AND NOT b.later AND bit_count(xor(a.p, b.p)) <= 3"""


@query(_near_sql())
def near_duplicates_md5(spark, sf_dir):
    return dedup.near_duplicates(_fingerprinted(spark, sf_dir))


@query()
def near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("_t", text.normalize_text(F.col("text")))
    rows = docs.select((F.col("doc_id") % 3).alias("org"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), hashing.sha256_text(F.col("_t")).alias("content_hash"), hashing.simhash64(F.col("_t")).alias("simhash"))
    return dedup.near_duplicates(rows)


# --- blocks, sections, chunks ----------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of documents as blocks: every fourth is a heading, three to a page."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return rows.select(
        "doc_id", "ordinal", F.when(F.col("ordinal") % 4 == 0, "heading").otherwise("paragraph").alias("block_type"), "text", F.expr("ordinal div 3").cast("int").alias("page"),
        F.when(F.col("ordinal") % 4 == 0, 2).alias("heading_level"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("dropped"),
    )


LINES = """l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, string_split(text, chr(10))[i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) r(i))"""


@query(
    f"""WITH {LINES}, a AS (SELECT *, trim(text) AS b, ordinal % 4 = 0 AS head FROM l WHERE trim(text) <> ''),
    s AS (SELECT *, CAST(sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS section_no FROM a)
    SELECT doc_id, section_no, max(CASE WHEN head THEN b END) AS title, CAST(max(CASE WHEN head THEN 2 ELSE 0 END) AS INTEGER) AS level, CAST(count(*) FILTER (NOT head) AS INTEGER) AS n_parts,
           md5(string_agg(b, chr(10) || chr(10) ORDER BY ordinal)) AS body_md5
    FROM s GROUP BY doc_id, section_no"""
)
def sections(spark, sf_dir):
    rows = chunk.sections(_lines(spark, sf_dir))
    return rows.select("doc_id", "section_no", "title", "level", F.size("parts").alias("n_parts"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    f"""WITH {LINES}, n AS (SELECT doc_id, ordinal, ordinal // 3 AS page, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS t FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ordinal) = 1 AS f, row_number() OVER (PARTITION BY doc_id, page ORDER BY ordinal DESC) = 1 AS e FROM n
          WHERE t <> '' AND NOT (len(t) <= 120 AND regexp_matches(lower(t), '^all rights reserved\\.?$') AND ordinal % 4 <> 0)),
    r AS (SELECT *, sum(CAST(f AS INTEGER)) OVER (PARTITION BY doc_id, t) AS fs, sum(CAST(e AS INTEGER)) OVER (PARTITION BY doc_id, t) AS es FROM k)
    SELECT n.doc_id, n.ordinal, CASE WHEN n.t = '' THEN 'empty' WHEN r.doc_id IS NULL THEN 'boilerplate' WHEN e AND es >= 2 THEN 'footer' WHEN f AND fs >= 2 THEN 'header' END AS drop_reason
    FROM n LEFT JOIN r USING (doc_id, ordinal)"""
)
def page_furniture(spark, sf_dir):
    return normalize.normalize_blocks(_lines(spark, sf_dir)).select("doc_id", "ordinal", "drop_reason")


@query()
def chunk_recursive(spark, sf_dir):
    return chunk.chunk_recursive(table(spark, sf_dir, "documents"))


@query()
def chunk_heading_aware(spark, sf_dir):
    return chunk.chunk_heading_aware(_lines(spark, sf_dir))


@query()
def chunk_parent_child(spark, sf_dir):
    return chunk.with_chunk_ids(chunk.chunk_parent_child(_lines(spark, sf_dir)))


@query()
def chunk_kinds(spark, sf_dir):
    return chunk.kind_counts(chunk.chunk_parent_child(_lines(spark, sf_dir)))


@query()
def html_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("text/html").alias("mime"), "url", F.lit(None).cast("string").alias("title"), F.col("html").alias("text"))
    return corpus.blocks_of(pages.withColumn("filename", F.lit(None).cast("string")))


@query()
def text_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("text/plain").alias("mime"), F.lit("notes.txt").alias("filename"), F.lit(None).cast("string").alias("title"), "text")
    return corpus.blocks_of(docs)


def _structure_sql(*also: str) -> str:
    blocks = [
        "2, 'heading', 'Doc ' || doc_id, 1, NULL", "4, 'paragraph', t, NULL, NULL", "6, 'list', lang || chr(10) || source, NULL, 'ul'", "8, 'quote', t, NULL, NULL", "10, 'code', t, NULL, 'sql'", *also,
    ]
    rows = " UNION ALL ".join(f"SELECT doc_id, {b} FROM w" for b in blocks)
    return f"""WITH w AS (SELECT doc_id, lang, source, rtrim('w ' || array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')) AS t FROM documents),
    b(doc_id, place, block_type, text, level, extra) AS ({rows})
    SELECT doc_id, place, block_type, md5(text) AS text_md5, CAST(level AS INTEGER) AS level, CAST(extra AS VARCHAR) AS extra FROM b"""


def _structured(spark, sf_dir, markdown: bool) -> DataFrame:
    """Documents written as headings, paragraphs, lists, quotes, code and tables, with all of their words."""
    words = F.rtrim(F.concat(F.lit("w "), F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), " ")))
    number = F.col("doc_id").cast("string")
    parts = [F.lit("# Doc "), number, F.lit("\n\n"), words, F.lit("\n\n- "), F.col("lang"), F.lit("\n- "), F.col("source"), F.lit("\n\n> "), words, F.lit("\n\n```sql\n"), words, F.lit("\n```\n")]
    if markdown:
        parts += [F.lit("\n| id | language |\n|:--|---|\n| "), number, F.lit(" | "), F.col("lang"), F.lit(" |\n\n![picture "), number, F.lit("](x.png)\n")]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))
    blocks = parse.markdown_blocks(docs) if markdown else parse.text_blocks(docs)
    return blocks.where("text <> ''").select("doc_id", F.col("at").alias("place"), "block_type", F.md5(F.col("text").cast("binary")).alias("text_md5"), "level", "extra")


@query(_structure_sql())
def text_structure(spark, sf_dir):
    return _structured(spark, sf_dir, False)


@query(_structure_sql("12, 'table', '| id | language |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |', NULL, NULL", "15, 'image_caption', 'picture ' || doc_id, NULL, NULL"))
def markdown_structure(spark, sf_dir):
    return _structured(spark, sf_dir, True)


LINKS = """a AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1))) AS raw FROM pages),
    h AS (SELECT url, regexp_replace(raw, '#.*$', '') AS href, regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) AS root FROM a),
    k AS (SELECT DISTINCT url, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || href
      WHEN href LIKE '/%' THEN root || href ELSE root || coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/]+(/.*/)', 1), ''), '/') || href END AS link
    FROM h WHERE href <> '')"""


@query(f"WITH {LINKS} SELECT url, link FROM k")
def page_links(spark, sf_dir):
    return parse.page_links(table(spark, sf_dir, "pages"))


# --- retrieval ---------------------------------------------------------------------------

OVERLAP = f"""WITH {WINDOWS},
w AS (SELECT DISTINCT doc_id, ordinal, unnest({QTERMS.format("array_to_string(s, ' ')")}) AS term FROM c),
q AS (SELECT DISTINCT item_id AS qid, unnest({QTERMS.format("text")}) AS term FROM benchmark),
n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid),
o AS (SELECT qid, doc_id, ordinal, count(*) AS hits FROM q JOIN w USING (term) GROUP BY ALL),
r AS (SELECT qid, doc_id, ordinal, round(hits / n, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(hits / n, 9) DESC, doc_id, ordinal) AS INTEGER) AS rank FROM o JOIN n USING (qid))"""


#: Ordinals below this stand in one id with their document's.
ORDINALS = 1 << 20


def _lexical_hits(spark, sf_dir, k: int) -> DataFrame:
    """Chunks that share terms with a query, through an index of all chunks."""
    chunks = chunk.chunk_fixed(table(spark, sf_dir, "documents"))
    index = inverted.build(chunks.select((F.col("doc_id") * ORDINALS + F.col("ordinal")).alias("chunk_id"), "text"))
    asked = _asked(spark, sf_dir)
    hits = inverted.overlap(asked, index, k).join(asked.select("qid", F.size(F.array_distinct(text.query_tokens(F.col("query")))).alias("n_terms")), "qid")
    hits = retrieve.ranked(hits.withColumn("score", F.round(F.col("score") / F.col("n_terms"), 9)), k, F.desc("score"), F.col("chunk_id"))
    return hits.select("qid", F.expr(f"chunk_id div {ORDINALS}").alias("doc_id"), (F.col("chunk_id") % ORDINALS).cast("int").alias("ordinal"), "score", "rank")


@query(f"{OVERLAP} SELECT qid, doc_id, ordinal, score, rank FROM r WHERE rank <= 5")
def lexical_top_chunks(spark, sf_dir):
    return _lexical_hits(spark, sf_dir, 5)


@query(
    f"""{OVERLAP.replace("WITH", "WITH RECURSIVE", 1)}, g AS (SELECT r.qid, r.rank, r.doc_id, CAST(len(c.s) AS INTEGER) AS tokens FROM r JOIN c USING (doc_id, ordinal) WHERE rank <= 10),
    x AS (SELECT qid, 0 AS rank, 0 AS used, CAST([] AS BIGINT[]) AS seen, false AS took, CAST(NULL AS BIGINT) AS doc_id, 0 AS tokens, 0 AS place FROM (SELECT DISTINCT qid FROM g)
      UNION ALL SELECT qid, nr, used + CASE WHEN take THEN nt ELSE 0 END, CASE WHEN take THEN list_append(seen, nd) ELSE seen END, take, nd, nt, place + CAST(take AS INTEGER)
      FROM (SELECT x.*, g.rank AS nr, g.doc_id AS nd, g.tokens AS nt, NOT list_contains(seen, g.doc_id) AND used < 600 AND (used + g.tokens <= 600 OR len(seen) = 0) AS take
            FROM x JOIN g ON g.qid = x.qid AND g.rank = x.rank + 1))
    SELECT qid, place AS position, doc_id, tokens AS token_count FROM x WHERE took"""
)
def context_budget(spark, sf_dir):
    hits = stored(_lexical_hits(spark, sf_dir, 10), "hits")
    # Only documents that were hit, ten a query at most, are cut into chunks again.
    again = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = hits.join(chunk.chunk_fixed(again).select("doc_id", "ordinal", "token_count", "text"), ["doc_id", "ordinal"])
    rows = hits.select("qid", "rank", F.col("doc_id").cast("string").alias("parent_chunk_id"), F.col("doc_id").alias("chunk_id"), "token_count", "text")
    return retrieve.select_context(rows, 600).select("qid", "position", F.col("chunk_id").alias("doc_id"), "token_count")


def _vectors(spark, sf_dir, keep=()) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return (
        rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector")),
        rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), *keep),
    )


DENSE = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS qid, q.label AS want, d.vec_id AS chunk_id, d.label, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM p)"""


@query(f"WITH {DENSE} SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 10")
def dense_top_k(spark, sf_dir):
    return retrieve.dense_top_k(*_vectors(spark, sf_dir), 10, 6).select("qid", "chunk_id", "score", "rank")


@query(
    f"""WITH {DENSE}, rel AS (SELECT q.vec_id AS qid, list(d.vec_id) AS rel FROM e q JOIN e d ON q.label = d.label WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id),
    g AS (SELECT qid, list(chunk_id ORDER BY rank) AS got FROM r WHERE rank <= 10 GROUP BY qid),
    m AS (SELECT qid, got, rel, list_transform(got, lambda x: CAST(list_contains(rel, x) AS INTEGER)) AS hit FROM g JOIN rel USING (qid))
    SELECT qid, round(list_sum(hit) / len(rel), 6) AS recall, round(list_sum(hit) / 10.0, 6) AS precision, round(coalesce(1.0 / nullif(list_position(hit, 1), 0), 0), 6) AS mrr,
      round(list_sum(list_transform(hit, lambda x, i: x / log2(i + 1))) / list_sum(list_transform(range(1, least(len(rel), 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM m"""
)
def retrieval_metrics(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir, ["label"])
    hits = retrieve.dense_top_k(queries, chunks.drop("label"), 10, 6).select("qid", "chunk_id", "rank")
    wanted = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("want"))
    # Only marks and counts are needed: a label's chunks are never gathered.
    members = chunks.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("want")).agg(F.count("*").alias("n"))
    rows = hits.join(chunks.select("chunk_id", "label"), "chunk_id").join(wanted.join(members, "want"), "qid")
    mark = F.struct("rank", F.coalesce(F.col("label") == F.col("want"), F.lit(False)).alias("hit"))
    found = rows.groupBy("qid", "n").agg(F.transform(F.array_sort(F.collect_list(mark)), lambda m: m["hit"]).alias("marks"))
    marks, n = F.col("marks"), F.col("n")
    metrics = {"recall": evaluate.recall_of(marks, n, 10), "precision": evaluate.precision_of(marks, 10), "mrr": evaluate.reciprocal_rank_of(marks), "ndcg": evaluate.ndcg_of(marks, n, 10)}
    return found.select("qid", *[F.round(value, 6).alias(name) for name, value in metrics.items()])


def _vector_index(spark, sf_dir) -> vector_index.VectorIndex:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return vector_index.build(rows, cluster_by=["label"])


@query()
def indexed_top_k(spark, sf_dir):
    """The hits of dense_top_k but for those in cells that a query does not look into."""
    return vector_index.search(_vectors(spark, sf_dir)[0], _vector_index(spark, sf_dir), 10, digits=6)


@query(f"WITH {DENSE} SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 10")
def indexed_top_k_exact(spark, sf_dir):
    return vector_index.search(_vectors(spark, sf_dir)[0], _vector_index(spark, sf_dir), 10, exact=True, digits=6)


@query(
    f"""WITH {DENSE}, f AS (SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM p WHERE label IN (2, 5))
    SELECT qid, chunk_id, score, rank FROM f WHERE rank <= 5"""
)
def filtered_top_k(spark, sf_dir):
    return vector_index.search(_vectors(spark, sf_dir)[0], _vector_index(spark, sf_dir), 5, where=F.col("label").isin(2, 5), exact=True, digits=6)


@query(
    f"""WITH {DENSE}, l AS (SELECT qid, chunk_id, 0 AS list_no, rank FROM r WHERE rank <= 20
      UNION ALL SELECT qid, chunk_id, 1, row_number() OVER (PARTITION BY qid ORDER BY abs(qid - chunk_id), chunk_id) AS rank FROM p QUALIFY rank <= 20),
    f AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list_no, rank)) AS first FROM l GROUP BY qid, chunk_id)
    SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""
)
def rank_fusion(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    dense = retrieve.dense_top_k(queries, chunks, 20, 6).select("qid", F.lit(0).alias("list_no"), "rank", "chunk_id", F.create_map(F.lit("dense"), F.col("score")).alias("scores"))
    near = retrieve.nearest_numbers(queries.select("qid"), chunks.select("chunk_id"), 20)
    near = near.select("qid", F.lit(1).alias("list_no"), "rank", "chunk_id", F.create_map(F.lit("near"), F.col("score")).alias("scores"))
    return retrieve.fuse(dense.unionByName(near)).select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _whole(spark, sf_dir) -> DataFrame:
    """Documents as one chunk each."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("doc_id").alias("ordinal"))


def _index(spark, sf_dir) -> inverted.Index:
    return inverted.build(_whole(spark, sf_dir).select("chunk_id", "text"))


POSTINGS = f"""i AS (SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest({QTERMS.format("text")}) AS term FROM documents) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS qid, unnest({QTERMS.format("text")}) AS term FROM benchmark)"""


@query(
    f"""WITH {POSTINGS}, n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid)
    SELECT qid, chunk_id, CAST(sum(tf) AS BIGINT) AS tf FROM q JOIN i USING (term) JOIN n USING (qid) GROUP BY qid, chunk_id, n HAVING count(*) = n"""
)
def sparse_matches(spark, sf_dir):
    return retrieve.sparse_matches(_asked(spark, sf_dir), _index(spark, sf_dir)).select("qid", "chunk_id", "tf")


@query(
    f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents),
    q AS (SELECT DISTINCT item_id AS qid, unnest({QTERMS.format("text")}) AS term FROM benchmark), n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid),
    p AS (SELECT q.qid, q.term, k.doc_id, k.spot FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS spot FROM w) k JOIN q ON q.term = k.word),
    m AS (SELECT qid, doc_id, n FROM (SELECT qid, doc_id, count(DISTINCT term) AS c FROM p GROUP BY qid, doc_id) JOIN n USING (qid) WHERE c = n),
    x AS (SELECT m.qid, m.doc_id, a.spot, max(CASE WHEN a.term = q.term THEN a.spot END) OVER (PARTITION BY m.qid, m.doc_id, q.term ORDER BY a.spot) AS latest FROM m JOIN p a ON a.qid = m.qid AND a.doc_id = m.doc_id JOIN q ON q.qid = m.qid),
    y AS (SELECT x.qid, x.doc_id, x.spot, min(latest) AS begins FROM x JOIN n USING (qid) GROUP BY x.qid, x.doc_id, x.spot, n.n HAVING count(latest) = n.n),
    z AS (SELECT qid, doc_id, begins, min(spot) AS spot FROM y GROUP BY qid, doc_id, begins),
    c AS (SELECT qid, doc_id AS chunk_id, round(sum(1.0 / (spot - begins + 1)), 9) AS score FROM z GROUP BY qid, doc_id)
    SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"""
)
def sparse_top_k(spark, sf_dir):
    return retrieve.sparse_top_k(_asked(spark, sf_dir), _index(spark, sf_dir), _whole(spark, sf_dir), 10, 9).select("qid", "chunk_id", "score", "rank")


BM25 = f"""{POSTINGS}, l AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS len FROM documents),
s AS (SELECT count(*) AS n, avg(len) AS a FROM l), d AS (SELECT term, count(*) AS df FROM i GROUP BY term),
b AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a))), 6) AS score
      FROM q JOIN i USING (term) JOIN d USING (term) JOIN l USING (chunk_id), s GROUP BY qid, chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM b)"""


def _bm25(spark, sf_dir, k: int) -> DataFrame:
    return retrieve.bm25_top_k(_asked(spark, sf_dir), _index(spark, sf_dir), k, 6)


@query(f"WITH {BM25} SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 10")
def bm25_top_k(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@query(
    f"""WITH {BM25}, o AS (SELECT r.qid, r.chunk_id, r.score AS old, r.rank AS was,
      round((SELECT count(*) FROM q JOIN i USING (term) WHERE q.qid = r.qid AND i.chunk_id = r.chunk_id) / (SELECT count(*) FROM q WHERE q.qid = r.qid), 9) AS score FROM r WHERE rank <= 20)
    SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, old DESC, was) AS INTEGER) AS rank FROM o QUALIFY rank <= 5"""
)
def lexical_rerank(spark, sf_dir):
    asked, chunks = _asked(spark, sf_dir), _whole(spark, sf_dir)
    hits = _bm25(spark, sf_dir, 20).join(chunks.select("chunk_id", "text"), "chunk_id").join(asked, "qid")
    return retrieve.rerank(hits, F.round(retrieve.lexical_overlap(F.col("query"), F.col("text")), 9), 5).select("qid", "chunk_id", "score", "rank")


@query(
    """WITH a AS (SELECT item_id, text, regexp_extract_all(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\S+') AS w FROM benchmark),
    v AS (SELECT item_id, list_concat([trim(text)], CASE WHEN len(w) > 3 THEN [array_to_string(list_slice(w, 1, 4), ' '), array_to_string(list_slice(w, -4, -1), ' ')] ELSE [] END,
      CASE WHEN contains(lower(text), 'how to') OR contains(lower(text), 'how do i') THEN [regexp_replace(text, '(?i)how (to|do i)\\s*', '', 'g') || ' workflow procedure guide']
           WHEN contains(lower(text), 'error') OR contains(lower(text), 'fail') THEN [text || ' fix issue solution troubleshoot'] ELSE [] END) AS v FROM a),
    u AS (SELECT item_id, list_slice(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), 1, 3) AS u FROM v)
    SELECT item_id AS qid, CAST(len(u) AS INTEGER) AS n, array_to_string(u, '|') AS variants FROM u"""
)
def expand_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), retrieve.expand_query(F.col("text")).alias("v"))
    return rows.select("qid", F.size("v").alias("n"), F.array_join("v", "|").alias("variants"))


@query("SELECT item_id AS qid, md5('Overview and policy regarding ' || text || '. This document describes the key principles, guidelines, requirements, and specifications for ' || text || '. Section 1: General definitions and scope. Section 2: Implementation details and procedures.') AS text_md5 FROM benchmark")
def hypothetical_documents(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.md5(retrieve.hypothetical_document(F.col("text")).cast("binary")).alias("text_md5"))


LISTED = "CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) ELSE ['g' || doc_id % 4] END"


def _governed(spark, sf_dir) -> DataFrame:
    """Documents with derived tenants, states and access lists."""
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        d.alias("document_id"), (d % 3).alias("organization_id"), (d % 5).alias("workspace_id"), F.col("lang").alias("language"), F.col("source").alias("source_id"),
        F.lit("files").alias("source_type"), (d % 7 != 0).alias("is_current"), F.when(d % 11 == 0, "DELETED").otherwise("INDEXED").alias("state"),
        F.when(d % 13 == 0, F.lit("2024-01-01")).alias("deleted_at"),
        F.when(d % 5 == 0, F.array(F.concat(F.lit("u"), (d % 10).cast("string")))).otherwise(none).alias("allowed_users"),
        F.when(d % 4 == 0, none).otherwise(F.array(F.concat(F.lit("g"), (d % 4).cast("string")))).alias("allowed_groups"),
    )


@query("SELECT doc_id AS document_id, lang AS language FROM documents WHERE doc_id % 3 = 1 AND doc_id % 5 = 2 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND lang IN ('en', 'fr')")
def metadata_filter(spark, sf_dir):
    return _governed(spark, sf_dir).where(retrieve.metadata_predicate(1, workspace=2, languages=("en", "fr"))).select("document_id", "language")


@query(
    f"""WITH u AS (SELECT c_custkey, 'u' || c_custkey % 10 AS uid, ['g' || c_custkey % 4, 'role:member'] AS g FROM customer),
    a AS (SELECT doc_id % 5 = 0 AS lists_user, 'u' || doc_id % 10 AS uid, {LISTED} AS g, count(*) AS n FROM documents GROUP BY ALL)
    SELECT c_custkey AS principal, CAST(sum(n) AS BIGINT) AS readable FROM u, a
    WHERE (NOT lists_user AND len(a.g) = 0) OR (lists_user AND u.uid = a.uid) OR list_has_any(a.g, u.g) GROUP BY c_custkey"""
)
def readable_documents(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    who = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("qid"), F.concat(F.lit("u"), (F.col("c_custkey") % 10).cast("string")).alias("user_id"), F.concat(key, F.lit("@X.org")).alias("email"),
        retrieve.principal_groups(F.array(F.concat(F.lit("g"), (F.col("c_custkey") % 4).cast("string"))), F.lit("member"), F.lit(1), F.concat(key, F.lit("@X.org"))).alias("member_of"),
    )
    docs = _governed(spark, sf_dir).select("allowed_users", "allowed_groups")
    return retrieve.readable_counts(who, docs).withColumnRenamed("qid", "principal")


@query(
    f"""WITH {POSTINGS}, l AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS len FROM documents),
    s AS (SELECT count(*) AS n, avg(len) AS a FROM l), d AS (SELECT term, count(*) AS df FROM i GROUP BY term),
    v AS (SELECT doc_id AS chunk_id, doc_id % 5 = 0 AS lists_user, 'u' || doc_id % 10 AS uid, {LISTED} AS g FROM documents WHERE doc_id % 3 = 1 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0),
    w AS (SELECT item_id AS qid, 'u' || item_id % 10 AS uid, ['g' || item_id % 4, 'role:member'] AS g FROM benchmark),
    b AS (SELECT q.qid, w.uid, i.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a))), 6) AS score
      FROM q JOIN w ON w.qid = q.qid JOIN i USING (term) JOIN d USING (term) JOIN l ON l.chunk_id = i.chunk_id JOIN v ON v.chunk_id = i.chunk_id, s
      WHERE (NOT lists_user AND len(v.g) = 0) OR (lists_user AND w.uid = v.uid) OR list_has_any(v.g, w.g) GROUP BY q.qid, w.uid, i.chunk_id)
    SELECT qid, uid AS user_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 10"""
)
def principal_search(spark, sf_dir):
    """Each passage asked for by its own principal, in one organization's current documents."""
    asked, index = _asked(spark, sf_dir), _index(spark, sf_dir)
    email = F.concat(F.col("qid").cast("string"), F.lit("@X.org"))
    group = F.array(F.concat(F.lit("g"), (F.col("qid") % 4).cast("string")))
    who = asked.select("qid", F.concat(F.lit("u"), (F.col("qid") % 10).cast("string")).alias("user_id"), email.alias("email"), retrieve.principal_groups(group, F.lit("member"), F.lit(1), email).alias("member_of"))
    docs = _governed(spark, sf_dir).where(retrieve.metadata_predicate(1)).withColumnRenamed("document_id", "chunk_id")
    allowed = retrieve.readable_bitmaps(who, docs, index)
    return retrieve.bm25_top_k(asked, index, 10, 6, allowed).join(who.select("qid", "user_id"), "qid").select("qid", "user_id", "chunk_id", "score", "rank")


def _searchable(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = chunk.with_chunk_ids(chunk.chunk_fixed(docs))
    return chunks.select(
        "chunk_id", "parent_chunk_id", F.col("doc_id").cast("string").alias("document_id"), F.lit("1").alias("version_id"), "ordinal", "token_count", "text",
        embed.embed(F.col("text"), embed.deterministic(32), 32).alias("vector"),
    )


@query()
def hybrid_search(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))
    hits = search.search(asked, _searchable(spark, sf_dir), search.SearchConfig(dimension=32))
    return hits.select("qid", "chunk_id", "document_id", "rank", F.round("score", 9).alias("score"))


@query()
def evaluation_run(spark, sf_dir):
    """Passages as questions; the documents that hold a passage are the relevant ones."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    holders = search.holders(asked.withColumnRenamed("question", "passage"), docs).groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))
    records = stored(asked.join(holders, "qid", "left").select("qid", "question", F.col("question").alias("expected_answer"), F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant")), "records")
    chunks = stored(_searchable(spark, sf_dir), "chunks")
    return search.experiment(records, chunks, search.SearchConfig(dimension=32))


# --- answers ---------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations),
    s AS (SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS s FROM m WHERE p <= 4 AND role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id)
    SELECT conv_id, md5(trim(coalesce(s || ' ', '') || 'what next')) AS query_md5 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id)"""
)
def conversation_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id").distinct().withColumn("question", F.lit("what next"))
    rows = answer.conversation_query(turns.withColumnRenamed("text", "content"), asked)
    return rows.select("conv_id", F.md5(F.col("query").cast("binary")).alias("query_md5"))


@query(
    f"""WITH {BM25},
    h AS (SELECT r.qid, r.rank, r.chunk_id, r.score, regexp_replace(x.text, '^\\s+|\\s+$', '', 'g') AS t, list_distinct({QTERMS.format("y.text")}) AS terms FROM r JOIN documents x ON x.doc_id = r.chunk_id JOIN benchmark y ON y.item_id = r.qid WHERE rank <= 5),
    c AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda e: regexp_replace(e, '^\\s+|\\s+$', '', 'g')), lambda e: e <> '') AS parts FROM h),
    k AS (SELECT *, list_transform(parts, lambda e: len(list_intersect(terms, list_transform(regexp_extract_all(e, '[A-Za-z0-9_]+'), lambda v: lower(v))))) AS hits FROM c),
    e AS (SELECT qid, rank, chunk_id, score, coalesce(parts[list_position(hits, list_max(hits))], t) AS best FROM k),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM e WHERE best <> ''),
    g AS (SELECT qid, string_agg(best || ' [' || place || ']', ' ' ORDER BY place) AS answer, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY place) AS used FROM o WHERE place <= 3 GROUP BY qid),
    m AS (SELECT qid, max(score) AS top FROM e GROUP BY qid)
    SELECT item_id AS qid, CASE WHEN top >= 0.01 AND answer IS NOT NULL THEN answer ELSE 'I could not find enough information in the connected sources.' END AS answer,
      CASE WHEN top >= 0.01 AND answer IS NOT NULL THEN 'grounded' ELSE 'insufficient' END AS evidence_status, CASE WHEN top >= 0.01 AND answer IS NOT NULL THEN used ELSE '' END AS used
    FROM benchmark LEFT JOIN g ON g.qid = item_id LEFT JOIN m ON m.qid = item_id"""
)
def extractive_answers(spark, sf_dir):
    asked, chunks = _asked(spark, sf_dir), _whole(spark, sf_dir)
    context = _bm25(spark, sf_dir, 5).join(chunks.select("chunk_id", "text"), "chunk_id").select("qid", F.col("rank").alias("position"), F.col("chunk_id").cast("string").alias("chunk_id"), "text", "score")
    return answer.extractive_answers(asked.withColumnRenamed("query", "question"), context).select("qid", "answer", "evidence_status", F.array_join("used", ",").alias("used"))


@query(
    f"""WITH {BM25}, h AS (SELECT qid, rank, chunk_id % 50 AS document_id FROM r WHERE rank <= 10),
    f AS (SELECT qid, document_id, min(rank) AS place FROM h GROUP BY qid, document_id)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS index, document_id FROM f"""
)
def citations(spark, sf_dir):
    d = F.col("chunk_id") % 50
    hits = _bm25(spark, sf_dir, 10).select("qid", F.col("rank").alias("position"), d.alias("document_id"), F.lit(1).alias("version_id"), d.alias("chunk_id"))
    return answer.citations(hits).select("qid", "index", "document_id")


def _answer_sql() -> str:
    claim = ", ".join(repr(w) for w in evaluate.CLAIM_STOPWORDS)
    asked = ", ".join(repr(w) for w in evaluate.QUESTION_STOPWORDS)
    words = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '\\S+'), lambda w: NOT list_contains([{1}], lower(w))), lambda w: trim(lower(w), '{2}')))"
    ws = "list_filter(list_transform(regexp_extract_all(s, '\\S+'), lambda w: trim(lower(w), '.,!?;:')), lambda w: NOT list_contains([" + claim + "], w) AND len(w) > 2)"
    return f"""WITH a AS (SELECT c.conv_id, c.turn, c.text AS answer, p.text AS question, [p.text] AS ctx FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
      WHERE c.role = 'assistant' AND trim(c.text) <> '' AND trim(p.text) <> ''),
    b AS (SELECT *, lower(array_to_string(ctx, ' ')) AS blob, list_filter(regexp_extract_all(lower(answer), '\\S+'), lambda t: len(t) > 2) AS t,
      list_filter(list_transform(string_split(replace(answer, chr(10), '. '), '.'), lambda s: trim(s)), lambda s: s <> '') AS ss, {words.format("question", asked, "?,!.")} AS qw FROM a),
    u AS (SELECT *, regexp_extract_all(blob, '\\S+') AS known, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS bg FROM b),
    f AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (len(w) = 0 OR len(list_filter(w, lambda x: contains(blob, x))) * 2 >= len(w)) AS ok FROM
      (SELECT conv_id, turn, blob, {ws} AS w FROM (SELECT conv_id, turn, blob, unnest(ss) AS s FROM b)) GROUP BY conv_id, turn)
    SELECT u.conv_id, u.turn,
      round(CASE WHEN len(t) = 0 THEN 0 WHEN len(bg) > 0 THEN 0.5 * len(list_filter(t, lambda x: list_contains(known, x))) / len(t) + 0.5 * len(list_filter(bg, lambda x: contains(blob, x))) / len(bg)
        ELSE len(list_filter(t, lambda x: list_contains(known, x))) / len(t) END, 6) AS groundedness,
      round(coalesce(ok / n, 0), 6) AS faithfulness, round(CASE WHEN len(qw) = 0 THEN 1.0 ELSE len(list_filter(qw, lambda x: contains(lower(answer), x))) / len(qw) END, 6) AS relevance
    FROM u LEFT JOIN f USING (conv_id, turn)"""


@query(_answer_sql())
def answer_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"]).where((F.trim("text") != "") & (F.trim("question") != ""))
    a, q, ctx = F.col("text"), F.col("question"), F.array("question")
    return rows.select(
        "conv_id", "turn", F.round(evaluate.groundedness(a, ctx), 6).alias("groundedness"), F.round(evaluate.faithfulness(a, ctx), 6).alias("faithfulness"),
        F.round(evaluate.answer_relevance(a, q, F.lit("")), 6).alias("relevance"),
    )


# --- ingestion ---------------------------------------------------------------------------


@query("SELECT doc_id, sha1(unhex('6ba7b8149dad41d180b400c04fd430c8') || encode(concat_ws('|', CAST(doc_id % 3 AS VARCHAR), 'files', 'c1', source || '/' || doc_id))) AS name_sha1 FROM documents")
def document_names(spark, sf_dir):
    name = F.concat_ws("|", (F.col("doc_id") % 3).cast("string"), F.lit("files"), F.lit("c1"), F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    space = F.unhex(F.lit(hashing.DOCUMENT_NAMESPACE.replace("-", "")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.concat(space, name.cast("binary"))).alias("name_sha1"))


@query(
    """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8149dad41d180b400c04fd430c8') || encode(concat_ws('|', CAST(doc_id % 3 AS VARCHAR), 'files', 'c1', source || '/' || doc_id))) AS s FROM documents)
    SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS document_id FROM h"""
)
def document_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", hashing.document_id(F.col("doc_id") % 3, F.lit(" Files "), F.lit("c1"), F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("document_id"))


@query(
    """WITH f AS (SELECT doc_id, 'dir/f' || doc_id || ['.txt', '.MD', '.html', '.pdf', '.exe', ''][1 + doc_id % 6] AS filename, ['text/plain', 'text/x-markdown; charset=utf-8', '', 'application/octet-stream'][1 + doc_id % 4] AS declared, CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 60000000 ELSE n_chars END AS size_bytes FROM documents),
    t AS (SELECT *, coalesce(CASE doc_id % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/pdf' END, CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' END) AS mime_type FROM f)
    SELECT doc_id, mime_type, CASE WHEN size_bytes <= 0 THEN 'empty' WHEN size_bytes > 52428800 THEN 'too large' WHEN mime_type IS NULL THEN 'unknown type' END AS rejection FROM t"""
)
def upload_types(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (d % n).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("dir/f"), d.cast("string"), pick([".txt", ".MD", ".html", ".pdf", ".exe", ""], 6)).alias("filename"),
        pick(["text/plain", "text/x-markdown; charset=utf-8", "", "application/octet-stream"], 4).alias("declared_mime"),
        F.when(d % 17 == 0, 0).when(d % 19 == 0, 60000000).otherwise(F.col("n_chars")).alias("size_bytes"),
    )
    return ingest.validate_uploads(rows).select("doc_id", "mime_type", "rejection")


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as first seen, and later without every seventh and with every fifth changed."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.when(F.col("doc_id") % 9 == 0, "FAILED").otherwise("INDEXED").alias("state"), F.lit(1).alias("version_number"), F.lit(True).alias("is_current"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return old, docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("document_id"), F.sha2(body.cast("binary"), 256).alias("content_hash"))


@query("SELECT doc_id AS document_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END) AS content_hash FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 9 = 0)")
def changed_documents(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return ingest.changed(new, old)


@query("SELECT doc_id AS document_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 9 <> 0")
def unchanged_documents(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return ingest.unchanged(new, old)


@query(
    """SELECT doc_id AS document_id, 1 AS version_number, sha256(text) AS content_hash, NOT (doc_id % 7 <> 0 AND doc_id % 5 = 0) AS is_current FROM documents
    UNION ALL SELECT doc_id, 2, sha256(text || ' changed'), true FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0"""
)
def version_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return ingest.upsert_versions(old.drop("state"), new)


@query(
    """WITH a AS (SELECT user_id AS document_id, event_type AS content_hash, event_id AS arrived, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    f AS (SELECT * FROM a WHERE b IS NULL OR b <> content_hash)
    SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY arrived) AS INTEGER) AS version_number, content_hash, arrived, lead(arrived) OVER (PARTITION BY document_id ORDER BY arrived) IS NULL AS is_current FROM f"""
)
def version_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("content_hash"), F.col("event_id").alias("arrived"))
    return ingest.versions(rows)


#: Slices in which events reach a stream, one after another.
SLICES = 3


@query(
    """WITH a AS (SELECT user_id AS document_id, event_type AS content_hash, event_id AS arrived, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY arrived) AS INTEGER) AS version_number, content_hash, arrived FROM a WHERE b IS NULL OR b <> content_hash"""
)
def streamed_versions(spark, sf_dir):
    """Events that arrive in slices; each run of the stream goes on from the checkpoint and the state of the one before."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("content_hash"), F.col("event_id").alias("arrived"))
    inbox, outbox, checkpoint = (new_folder(spark, name) for name in ("inbox", "outbox", "checkpoint"))
    ends = rows.agg(F.min("arrived").alias("low"), F.max("arrived").alias("high")).first()
    width = ((ends.high or 0) - (ends.low or 0)) // SLICES + 1
    for i in range(SLICES):
        begin = (ends.low or 0) + i * width
        rows.where((F.col("arrived") >= begin) & (F.col("arrived") < begin + width)).write.mode("append").parquet(inbox)
        stream = sync.file_stream(spark, inbox, rows.schema, 1_000_000)
        sync.run_available(sync.version_stream(stream), outbox, checkpoint)
    return spark.read.schema("document_id long, version_number int, content_hash string, arrived long").parquet(outbox)


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'DELETED' WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'INDEXED' END AS state, doc_id % 7 <> 0 AS is_current FROM documents")
def tombstones(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    gone = old.select("document_id").join(new, "document_id", "left_anti")
    return ingest.tombstone(old, gone).select("document_id", "state", "is_current")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op,
      CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text || ' changed') END AS sha FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0"""
)
def manifest_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    as_paths = lambda rows: rows.select(F.col("document_id").cast("string").alias("path"), F.col("content_hash").alias("sha"))
    return feeds.manifest_diff(as_paths(old), as_paths(new))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    import datetime

    page = tables.keyset_page(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", (datetime.datetime(1995, 6, 1), 100), 500)
    return page.select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS op, count(*) AS n FROM orders GROUP BY 1")
def soft_deletes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("op", tables.change_op(F.col("o_orderstatus") == "F"))
    return rows.groupBy("op").agg(F.count("*").alias("n"))


STATE_NAMES = list(ingest.NEXT_STATES)


def _state_sql() -> str:
    names = ", ".join(repr(s) for s in STATE_NAMES)
    pairs = ", ".join(f"('{s}', '{t}')" for s, ts in ingest.NEXT_STATES.items() for t in sorted({*ts, "DELETED", "FAILED"} - ({"FAILED"} if s == "FAILED" else set())))
    return f"""WITH e AS (SELECT user_id, event_id, [{names}][1 + (event_id * 7 + user_id) % {len(STATE_NAMES)}] AS state FROM events),
    l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM e), ok(s, t) AS (VALUES {pairs})
    SELECT user_id, event_id, previous, state FROM l WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ok WHERE s = previous AND t = state)"""


@query(_state_sql())
def invalid_transitions(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in STATE_NAMES])
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.get(names, ((F.col("event_id") * 7 + F.col("user_id")) % len(STATE_NAMES)).cast("int")).alias("state"))
    return ingest.invalid_transitions(log, "user_id", "event_id").select("user_id", "event_id", "previous", "state")


JOBS = "j AS (SELECT event_id AS job_id, concat_ws(':', 'upload', event_type, CAST(user_id AS VARCHAR)) AS key, ['QUEUED', 'RUNNING', 'SUCCEEDED', 'FAILED'][1 + event_id % 4] AS status, ts AS created_at FROM events)"


def _jobs(spark, sf_dir) -> DataFrame:
    status = F.get(F.array(*[F.lit(s) for s in ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED")]), (F.col("event_id") % 4).cast("int"))
    key = F.concat_ws(":", F.lit("upload"), "event_type", F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), key.alias("key"), status.alias("status"), F.col("ts").alias("created_at"))


@query(f"WITH {JOBS} SELECT job_id, key, status FROM j QUALIFY status IN ('SUCCEEDED', 'FAILED') OR row_number() OVER (PARTITION BY key, status IN ('QUEUED', 'RUNNING') ORDER BY created_at, job_id) = 1")
def coalesced_jobs(spark, sf_dir):
    return ingest.coalesce_jobs(_jobs(spark, sf_dir)).select("job_id", "key", "status")


@query(f"WITH {JOBS} SELECT job_id, key FROM j WHERE status = 'FAILED'")
def dead_letters(spark, sf_dir):
    return ingest.dead_letters(_jobs(spark, sf_dir)).select("job_id", "key")


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS calls, greatest(count(*) - 2, 0) AS denied FROM events GROUP BY ALL")
def fixed_window_rate(spark, sf_dir):
    rows = ingest.fixed_window_denials(table(spark, sf_dir, "events"), 2, 3600)
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """SELECT event_id, coalesce(ts < max(ts) OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOUR, false) AS is_late FROM events"""
)
def late_events(spark, sf_dir):
    """Events arrive in an order that is not that of their times."""
    rows = table(spark, sf_dir, "events").withColumn("arrived", F.struct((F.col("event_id") * 7919) % 10007, F.col("event_id")))
    return ingest.late_events(rows, 12 * 3600, "event_type", "ts", "arrived").select("event_id", "is_late")


@query(
    """SELECT event_type AS source, count(*) AS discovered, count(*) FILTER (value >= 20) AS fetched, count(*) FILTER (value >= 20 AND user_id % 3 <> 0) AS queued,
      count(*) FILTER (value >= 20 AND user_id % 3 = 0) AS skipped, count(*) FILTER (value < 20) AS deleted FROM events GROUP BY 1"""
)
def sync_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") < 20, "delete").otherwise("upsert").alias("op"), (F.col("user_id") % 3 == 0).alias("unchanged"))
    return ingest.sync_outcomes(rows, ["source"])


@query("SELECT 'counter' AS kind, event_type AS name, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type UNION ALL SELECT 'gauge', event_type, count(*), round(max_by(value, event_id), 4) FROM events GROUP BY event_type")
def metric_series(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("counter"), F.lit("gauge"))).alias("kind"), F.col("event_type").alias("name"), F.lit("").alias("labels"), "value", F.col("event_id").alias("at"))
    return evaluate.series(rows).select("kind", "name", "n", F.round("value", 4).alias("value"))


@query(
    """SELECT user_id AS run_id, 'run' AS name, round(max(value) FILTER (event_type = (SELECT min(event_type) FROM events)), 6) AS first_metric, round(max(value) FILTER (event_type = (SELECT max(event_type) FROM events)), 6) AS last_metric
    FROM events GROUP BY user_id"""
)
def compare_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.lit("run").alias("name"), F.col("event_type").alias("metric")).agg(F.max("value").alias("value"))
    wide = evaluate.compare_runs(rows)
    names = sorted(c for c in wide.columns if c not in ("run_id", "name"))
    return wide.select("run_id", "name", F.round(names[0], 6).alias("first_metric"), F.round(names[-1], 6).alias("last_metric"))


@query(
    """SELECT doc_id AS chunk_id, 1 AS version, doc_id AS document_id FROM documents
    UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 ELSE doc_id END FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0"""
)
def ledger_upsert(spark, sf_dir):
    """Every chunk has version 1 and every second also 2; a batch brings version 2 of every third."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    named = [F.lit("deterministic").alias("provider"), F.lit("sha256").alias("model")]
    versions = F.when(d % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    old = docs.select(d.alias("chunk_id"), d.alias("document_id"), *named, F.explode(versions).alias("version"))
    new = docs.where("doc_id % 3 = 0").select(d.alias("chunk_id"), (d + 1000000).alias("document_id"), *named, F.lit(2).alias("version"))
    name = f"ledger_{uuid.uuid4().hex}"
    ledger = keyed.create(old, name, ["chunk_id", "provider", "model", "version"])
    ledger.upsert(new, F.desc("document_id"))
    return ledger.read().select("chunk_id", "version", "document_id")


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id % 7 <> 0 AND n_chars > 100 AND (doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0)")
def stale_vectors(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        d.alias("document_id"), (d % 7 != 0).alias("is_current"), F.expr("n_chars div 101").cast("int").alias("chunk_count"), F.lit("deterministic").alias("embedding_provider"),
        F.when(d % 3 != 0, "sha256").alias("embedding_model"), F.lit(1).alias("embedding_version"), F.when(d % 4 == 0, 64).otherwise(128).alias("embedding_dimension"),
        F.when(d % 5 != 0, F.lit("2024-01-01")).alias("indexed_at"),
    )
    return embed.stale(rows, "deterministic", "sha256", 1, 128).select("document_id")


@query("SELECT doc_id, concat_ws('/', 'raw', source, CAST(doc_id AS VARCHAR), 'v1', 'original.txt') AS raw_key FROM documents")
def raw_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.raw_key(F.concat(F.lit("/"), F.col("source")), F.col("doc_id"), F.lit(1), F.lit("..original.txt/")).alias("raw_key"))


@query(
    """WITH h AS (SELECT doc_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00'::BLOB) || sha256(encode(text) || '\\x00\\x00\\x00\\x01'::BLOB) AS hex FROM documents),
    v AS (SELECT doc_id, list_transform(range(0, 64), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS INTEGER) / 127.5 - 1) AS v FROM h),
    n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
    SELECT doc_id, 64 AS dimension, round(v[1] / n, 4) AS first, round(v[33] / n, 4) AS middle, round(v[64] / n, 4) AS last FROM n"""
)
def deterministic_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", embed.embed(F.col("text"), embed.deterministic(64), 64).alias("v"))
    part = lambda i: F.round(F.get("v", F.lit(i)).cast("double"), 4)
    return rows.select("doc_id", F.size("v").alias("dimension"), part(0).alias("first"), part(32).alias("middle"), part(63).alias("last"))


HOST = "lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#]+)', 1))"


@query(
    f"""WITH RECURSIVE {LINKS}, s AS (SELECT {HOST.format("url")} AS host, min(url) AS url FROM pages GROUP BY 1),
    x AS (SELECT url, 0 AS depth FROM s UNION SELECT k.link, x.depth + 1 FROM x JOIN k ON k.url = x.url
      WHERE x.depth < 19 AND k.link IN (SELECT url FROM pages) AND {HOST.format("k.link")} IN (SELECT host FROM s))
    SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM x GROUP BY url"""
)
def crawl(spark, sf_dir):
    """From the first page of every host."""
    pages = table(spark, sf_dir, "pages")
    first = pages.groupBy(feeds.host(F.col("url"))).agg(F.min("url").alias("url")).select("url")
    return feeds.crawl(pages.select("url", "html"), first)


@query("SELECT url, CASE page_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'retry' ELSE CASE WHEN page_id % 2 = 0 THEN 'unchanged' ELSE 'upsert' END END AS op FROM pages")
def crawl_changes(spark, sf_dir):
    p = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    status = F.when(p % 5 == 0, 404).when(p % 5 == 1, 304).when(p % 5 == 2, 500).otherwise(200)
    return feeds.crawl_changes(pages.select("url", F.lit("a").alias("etag")), pages.select("url", status.alias("status"), F.when(p % 2 == 0, "a").otherwise("b").alias("etag")))
