"""Queries over change feeds, sources and the control tables of ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.operators import answer, embed, ingest, parse, retrieve
from corpusloom.plans.queries import POSTINGS, query, table
from corpusloom.plans import queries as base
from corpusloom.sources import feeds, files, tables


def _pick(names, at):
    return F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))


@query(
    """WITH l AS (SELECT user_id, arg_max({'v': value, 'e': event_id}, event_id) AS c FROM events GROUP BY user_id)
    SELECT user_id AS file_id, CASE WHEN c.v < 5 OR c.e % 11 = 0 OR c.e % 4 NOT IN (1, 2) THEN 'delete' ELSE 'upsert' END AS op FROM l"""
)
def drive_changes(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e.alias("seq"), F.col("user_id").alias("file_id"), (F.col("value") < 5).alias("removed"), (e % 11 == 0).alias("trashed"),
        F.array(F.concat(F.lit("p"), (e % 4).cast("string"))).alias("parents"),
    )
    return feeds.drive_changes(rows, ["p1", "p2"])


@query(
    """WITH p AS (SELECT c_custkey % 500 AS f, CASE WHEN c_custkey % 97 = 0 THEN 'anyone' ELSE ['user', 'group', 'domain'][1 + c_custkey % 3] END AS t,
      lower(c_name || '@X.org') AS e, 'domain:d' || c_custkey % 4 AS d, c_custkey % 7 = 0 AS gone FROM customer),
    g AS (SELECT f, coalesce(bool_or(t = 'anyone') FILTER (NOT gone), false) AS open, list_sort(list(DISTINCT e) FILTER (t = 'user' AND NOT gone)) AS u,
      list_sort(list(DISTINCT CASE WHEN t = 'group' THEN e ELSE d END) FILTER (t IN ('group', 'domain') AND NOT gone)) AS g FROM p GROUP BY f)
    SELECT f AS file_id, CASE WHEN open THEN '' ELSE coalesce(array_to_string(u, ','), '') END AS users, CASE WHEN open THEN '' ELSE coalesce(array_to_string(g, ','), '') END AS groups FROM g"""
)
def drive_permissions(spark, sf_dir):
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        (c % 500).alias("file_id"), F.when(c % 97 == 0, "anyone").otherwise(_pick(["user", "group", "domain"], c % 3)).alias("type"), F.concat("c_name", F.lit("@X.org")).alias("email"),
        F.concat(F.lit("D"), (c % 4).cast("string")).alias("domain"), F.when(c % 5 == 0, "owner").otherwise("reader").alias("role"), (c % 7 == 0).alias("deleted"),
    )
    lists = feeds.drive_permissions(rows)
    return lists.select("file_id", F.array_join("allowed_users", ",").alias("users"), F.array_join("allowed_groups", ",").alias("groups"))


@query(
    """SELECT conv_id || '-' || turn AS id, role AS title, md5(text) AS content_md5, CASE WHEN turn % 3 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM conversations"""
)
def rest_items(spark, sf_dir):
    """Conversations as JSON pages of a paged API, and the pages read back as items."""
    item = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.col("text").alias("content"), (F.col("turn") % 3 == 0).alias("deleted")
    )
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("items"))
    bodies = pages.select(F.to_json(F.struct("items", F.lit("next").alias("next_cursor"))).alias("body"))
    return feeds.rest_items(bodies).select("id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), "op")


@query("SELECT doc_id || '.0001' AS arxiv_id, md5(trim(regexp_replace(text, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), ' ')) AS summary_md5 FROM documents")
def atom_entries(spark, sf_dir):
    """Documents as Atom feeds, their texts escaped or in CDATA, and the feeds read back as entries."""
    xml = F.col("text")
    for mark, name in (("&", "&#38;"), ("<", "&lt;"), (">", "&#x3E;")):
        xml = F.replace(xml, F.lit(mark), F.lit(name))
    data = F.concat(F.lit("<![CDATA["), F.replace(F.col("text"), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    body = F.concat(
        F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>f</a:title><a:entry><a:id>http://arxiv.org/abs/'), F.col("doc_id").cast("string"),
        F.lit('.0001v2</a:id><a:title type="text">t</a:title><a:author><a:name>n</a:name></a:author><a:updated>u</a:updated><a:summary>'),
        F.when(F.col("doc_id") % 2 == 0, xml).otherwise(data), F.lit("</a:summary></a:entry></a:feed>"),
    )
    found = feeds.atom_entries(table(spark, sf_dir, "documents").select(body.alias("body")))
    return found.select("arxiv_id", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


@query(
    """SELECT o_orderkey, '# ' || o_orderpriority || chr(10) || chr(10) || 'State: ' || o_orderstatus || chr(10) || chr(10) || o_custkey AS body FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01'"""
)
def changed_issues(spark, sf_dir):
    import datetime

    rows = table(spark, sf_dir, "orders").withColumn("updated_at", F.col("o_orderdate"))
    rows = feeds.updated_since(rows, datetime.datetime(1995, 6, 1))
    return rows.select("o_orderkey", feeds.item_markdown(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("body"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(md|markdown)$') THEN 'text/markdown' WHEN regexp_matches(lower(url), '\\.html?$') THEN 'text/html' ELSE 'text/plain' END AS mime,
      regexp_extract(url, '^[a-zA-Z]+://[^/]+/(.*)$', 1) LIKE 'a/%' OR regexp_extract(url, '^[a-zA-Z]+://[^/]+/(.*)$', 1) = 'a' AS included FROM pages"""
)
def included_paths(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/]+/(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", feeds.path_mime(F.col("url")).alias("mime"), feeds.included(path, ["a/"]).alias("included"))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS body FROM customer""")
def rows_as_json(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tables.rows_as_json(table(spark, sf_dir, "customer"), ["c_name", "c_custkey", "c_mktsegment"]).alias("body"))


@query(
    """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('local:sha256:1:' || doc_id)) AS s FROM documents)
    SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS point_id FROM h"""
)
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.point_id(F.lit("local"), F.lit("sha256"), F.lit(1), F.col("doc_id")).alias("point_id"))


@query("SELECT doc_id AS document_id, 1 + doc_id % 2 AS version_number FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 1")
def live_points(spark, sf_dir):
    """Points of versions 1 and 2, without deleted documents and versions that are not current (2 is)."""
    d = F.col("doc_id")
    points = table(spark, sf_dir, "documents").select(d.alias("document_id"), (1 + d % 2).alias("version_number"))
    left = embed.delete_points(points, points.where("document_id % 3 = 0"))
    return embed.delete_old_versions(left, left.select("document_id", F.lit(2).cast("long").alias("version_number"))).select("document_id", "version_number")


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 'DISCOVERED' WHEN doc_id % 7 = 0 THEN 'DELETED' ELSE 'INDEXED' END AS state FROM documents")
def undeleted(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(d.alias("document_id"), F.when(d % 7 == 0, "DELETED").otherwise("INDEXED").alias("state"))
    return ingest.undelete(docs, docs.where("document_id % 2 = 0")).select("document_id", "state")


@query(
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE 'old ' END || doc_id AS title, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'a=1' WHEN doc_id % 2 = 0 THEN 'a=1,original_filename=f,source=files,z=2' ELSE 'original_filename=f,source=files,z=2' END AS metadata,
      CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'me' WHEN doc_id % 5 = 0 THEN 'you' ELSE CAST(doc_id % 4 AS VARCHAR) END AS users, CASE WHEN doc_id % 3 = 0 AND (doc_id % 2 <> 0 OR doc_id % 7 = 0) THEN 'DISCOVERED' WHEN doc_id % 7 = 0 THEN 'DELETED' ELSE 'INDEXED' END AS state
    FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0"""
)
def merged_documents(spark, sf_dir):
    """Every second document is known, every third is discovered."""
    d = F.col("doc_id")
    named = [d.alias("document_id"), (d % 4).alias("organization_id")]
    docs = table(spark, sf_dir, "documents")
    title = lambda word: F.concat(F.lit(word), d.cast("string")).alias("title")
    old = docs.where("doc_id % 2 = 0").select(
        *named, title("old "), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("source_url"), F.create_map(F.lit("a"), F.lit("1")).alias("metadata"),
        F.array(F.lit("me")).alias("allowed_users"), F.array().cast("array<string>").alias("allowed_groups"), F.when(d % 7 == 0, "DELETED").otherwise("INDEXED").alias("state"),
    )
    lists = F.when(d % 5 == 0, F.array(F.lit("you")))
    seen = docs.where("doc_id % 3 = 0").select(
        *named, title("new "), F.lit("text/html").alias("mime_type"), F.lit("u").alias("source_url"), F.create_map(F.lit("z"), F.lit("2")).alias("metadata"),
        lists.alias("allowed_users"), F.lit(None).cast("array<string>").alias("allowed_groups"), F.lit("f").alias("filename"), F.lit("files").alias("source_type"),
    )
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return ingest.merge_documents(old, seen).select("document_id", "title", entries.alias("metadata"), F.array_join("allowed_users", ",").alias("users"), "state")


@query(
    """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'disconnected' WHEN 2 THEN 'nothing to sync' WHEN 4 THEN 'unknown source' END AS refusal FROM events"""
)
def accepted_work(spark, sf_dir):
    sources = spark.createDataFrame([(0, "PAUSED", "WEBSITE"), (1, "DISCONNECTED", "WEBSITE"), (2, "ACTIVE", "FILE_UPLOAD"), (3, "ACTIVE", "WEBSITE")], "source_id long, status string, source_type string")
    items = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).cast("long").alias("source_id"))
    return ingest.accepted_work(items, sources, sync=True).select("event_id", "refusal")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decoded_bytes(spark, sf_dir):
    """Texts as UTF-8, UTF-8 with a mark and UTF-16, read back by what they begin with."""
    d, t = F.col("doc_id"), F.col("text")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))
    data = F.when(d % 3 == 0, F.encode(t, "UTF-8")).when(d % 3 == 1, marked).otherwise(F.encode(t, "UTF-16"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(parse.decode_bytes(data).cast("binary")).alias("text_md5"))


@query(f"WITH {POSTINGS}, n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid) SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM (SELECT qid, chunk_id, n FROM q JOIN i USING (term) JOIN n USING (qid) GROUP BY qid, chunk_id, n HAVING count(*) = n))")
def queries_without_hits(spark, sf_dir):
    asked = base._asked(spark, sf_dir)
    return retrieve.without_hits(asked, retrieve.sparse_matches(asked, base._index(spark, sf_dir))).select("qid")


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\\S+')) + len(regexp_extract_all(role, '\\S+')) AS INTEGER) AS tokens FROM conversations")
def token_usage(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.token_usage(F.col("text"), F.col("role")).alias("tokens"))


@query("SELECT doc_id, 'staging/' || doc_id % 3 || '/job' || doc_id || '/f.txt' AS staging_key, source || '/a/' || doc_id AS source_key FROM documents")
def staging_keys(spark, sf_dir):
    d = F.col("doc_id")
    messy = F.concat(F.lit(" //"), F.col("source"), F.lit("\\a//"), d.cast("string"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", files.staging_key(d % 3, F.concat(F.lit("job"), d.cast("string")), F.lit("f.txt")).alias("staging_key"), hashing.normalize_source_id(messy).alias("source_key"))


@query()
def markdown_blocks(spark, sf_dir):
    return parse.markdown_blocks(table(spark, sf_dir, "documents"))
