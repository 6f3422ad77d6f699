"""Change feeds: manifests, item lists, drive changes, paged JSON, Atom entries and crawls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.parse import page_links
from corpusloom.session import drop_stored, new_folder, stored


def included(path: Column, prefixes: Sequence[str]) -> Column:
    """Under one of the prefixes, or any path if there are none."""
    if not prefixes:
        return F.lit(True)
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/")
    return hit


def manifest_diff(previous: DataFrame, current: DataFrame, truncated: bool = False) -> DataFrame:
    """path, op, sha: new and changed paths are upserts, missing ones deletes unless the listing was cut short."""
    old = previous.select("path", F.col("sha").alias("_old"), F.lit(True).alias("_was"))
    new = current.select("path", "sha", F.lit(True).alias("_is"))
    op = F.when(F.col("_is").isNull(), "delete").when(F.col("_was").isNull() | ~F.col("sha").eqNullSafe(F.col("_old")), "upsert")
    rows = old.join(new, "path", "full_outer").select("path", op.alias("op"), "sha").where(F.col("op").isNotNull())
    return rows.where("op <> 'delete'") if truncated else rows


def updated_since(items: DataFrame, since) -> DataFrame:
    """Items changed after a time; all without one."""
    return items if since is None else items.where(F.col("updated_at") > F.lit(since))


def item_markdown(title: Column, state: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\nState: "), F.coalesce(state, F.lit("unknown")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def path_mime(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.(md|markdown)$"), "text/markdown").when(F.lower(path).rlike(r"\.html?$"), "text/html").otherwise("text/plain")


def drive_changes(changes: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """file_id, op: the last change per file. changes: seq, file_id, removed, trashed, parents.

    Removed, trashed or moved out of the wanted folders is a delete.
    """
    last = changes.groupBy("file_id").agg(F.max_by(F.struct("removed", "trashed", "parents"), "seq").alias("c"))
    outside = ~F.arrays_overlap(F.coalesce("c.parents", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in folders])) if folders else F.lit(False)
    gone = F.coalesce("c.removed", F.lit(False)) | F.coalesce("c.trashed", F.lit(False)) | outside
    return last.select("file_id", F.when(gone, "delete").otherwise("upsert").alias("op"))


def drive_permissions(permissions: DataFrame, config_users: Sequence[str] = (), config_groups: Sequence[str] = (), owner_reads: bool = True) -> DataFrame:
    """file_id, allowed_users, allowed_groups. permissions: file_id, type, email, domain, role, deleted.

    `anyone` makes a file public. Owners are listed as readers unless owner_reads is
    off: without that a file that only its owner may read would have no list and be public.
    """
    live = permissions.where(~F.coalesce("deleted", F.lit(False)))
    if not owner_reads:
        live = live.where(F.coalesce("role", F.lit("")) != "owner")
    kind = F.col("type")
    user = F.when((kind == "user") & (F.col("email") != ""), F.lower("email"))
    group = F.when((kind == "group") & (F.col("email") != ""), F.lower("email")).when((kind == "domain") & (F.col("domain") != ""), F.concat(F.lit("domain:"), F.lower("domain")))
    given = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    grouped = permissions.select("file_id").distinct().join(
        live.groupBy("file_id").agg(F.collect_set(user).alias("u"), F.collect_set(group).alias("g"), F.max(kind == "anyone").alias("open")), "file_id", "left"
    )
    none = given(())
    listed = lambda found, names: F.when(F.coalesce("open", F.lit(False)), none).otherwise(F.array_sort(F.array_union(F.coalesce(found, none), given(names))))
    return grouped.select("file_id", listed("u", config_users).alias("allowed_users"), listed("g", config_groups).alias("allowed_groups"))


def rest_items(pages: DataFrame, item_schema: str = "id string, title string, content string, deleted boolean") -> DataFrame:
    """item fields and op of JSON pages {"items": [...], "next_cursor": ...}."""
    body = F.from_json("body", f"items array<struct<{', '.join(f.replace(' ', ':', 1) for f in item_schema.split(', '))}>>, next_cursor string")
    rows = pages.select(F.explode(body["items"]).alias("i")).select("i.*")
    return rows.withColumn("op", F.when(F.coalesce("deleted", F.lit(False)), "delete").otherwise("upsert"))


#: What is read of a feed's entries; elements may stand in any namespace, and may have attributes.
ATOM = """entry array<struct<id: string, title: string, summary: string, updated: string, published: string,
    author: array<struct<name: string>>, category: array<struct<_term: string>>>>"""
#: Characters that XML 1.0 forbids, for which a blank stands.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def _entries(body: Column) -> Column:
    clean = F.regexp_replace(body, NOT_XML, " ")
    return F.from_xml(clean, ATOM, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})["entry"]


def atom_entries(feeds: DataFrame) -> DataFrame:
    """arxiv_id, title, summary, updated, authors, categories of Atom documents in column body, read as XML.

    CDATA and entities of any kind count as the text they stand for; runs of white
    space are one blank. Documents that are not XML give no rows (see unread_feeds).
    """
    rows = feeds.select(F.explode(_entries(F.col("body"))).alias("e"))
    field = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    paper = F.regexp_extract(field(F.col("e.id")), r"abs/([^\s]+?)(?:v\d+)?$", 1)
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.filter(F.transform(c, field), lambda x: x != ""), none)
    return rows.select(
        paper.alias("arxiv_id"), *[field(F.col(f"e.{n}")).alias(n) for n in ("title", "summary", "updated")],
        listed(F.col("e.author.name")).alias("authors"), listed(F.col("e.category._term")).alias("categories"),
    )


def unread_feeds(feeds: DataFrame) -> DataFrame:
    """Rows of feeds whose body has an entry tag and cannot be read as XML, to be kept aside."""
    return feeds.where(F.col("body").rlike(r"<(\w+:)?entry[\s>]") & _entries(F.col("body")).isNull())


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))


def crawl(pages: DataFrame, start: DataFrame, max_pages: int | None = None, max_depth: int | None = None) -> DataFrame:
    """url, depth: pages reached from the start urls over links on the start urls' hosts.

    pages (url, html) is what a fetcher has brought in. Each level is one anti-join
    of the links found with what was seen; the walk ends when a level is empty, or
    at max_pages or max_depth levels where the caller sets them. Only with
    max_pages do urls go in order within a level.
    """
    spark = pages.sparkSession
    links = stored(page_links(pages), "links")
    have = pages.select("url").distinct()
    begin = stored(start.select("url").distinct(), "crawl-start")
    hosts = begin.select(host(F.col("url")).alias("host")).distinct()
    known = links.select("link").distinct().join(have, F.col("link") == have["url"], "left_semi")
    known = stored(known.join(hosts, host(F.col("link")) == hosts["host"], "left_semi"), "crawl-known")
    level = stored(begin.join(have, "url", "left_semi").select("url", F.lit(0).alias("depth")), "crawl")
    path, depth, n, new = new_folder(spark, "crawl-seen"), 0, 0, level.count()
    while True:
        level.write.mode("append").parquet(path)
        seen, n, depth = spark.read.schema(level.schema).parquet(path), n + new, depth + 1
        if not new or (max_pages is not None and n >= max_pages) or (max_depth is not None and depth >= max_depth):
            break
        found = links.join(level.select("url"), "url", "left_semi").select("link").distinct().join(known, "link", "left_semi")
        found = found.select(F.col("link").alias("url")).join(seen.select("url"), "url", "left_anti")
        if max_pages is not None:
            found = found.orderBy("url").limit(max_pages - n)
        following = stored(found.withColumn("depth", F.lit(depth)), "crawl")
        drop_stored(spark, level)
        level, new = following, following.count()
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def crawl_changes(previous: DataFrame, fetched: DataFrame) -> DataFrame:
    """url, op: by status and hash. previous: url, etag. fetched: url, status, etag.

    304 and an equal tag are unchanged, 404 and 410 are deletes, other errors are left for the next time.
    A fetched row gives one row, also where the url is known several times: any of its tags may be equal.
    """
    known = previous.where(F.col("etag").isNotNull()).select("url", "etag").distinct().withColumn("_same", F.lit(True))
    rows = fetched.join(known, ["url", "etag"], "left")
    same = (F.col("status") == 304) | ((F.col("status") == 200) & F.col("_same").isNotNull())
    op = F.when(F.col("status").isin(404, 410), "delete").when(same, "unchanged").when(F.col("status") == 200, "upsert").otherwise("retry")
    return rows.select("url", op.alias("op"))


def missing_from(listed: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Known keys that a complete listing no longer has."""
    return known.select(key).join(listed.select(key), key, "left_anti").withColumn("op", F.lit("delete"))


SITEMAP = "url array<struct<loc: string, lastmod: string>>"


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """url, lastmod of sitemap documents in column body, read as XML."""
    clean = F.regexp_replace("body", NOT_XML, " ")
    rows = sitemaps.select(F.explode(F.from_xml(clean, SITEMAP, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})["url"]).alias("e"))
    at, changed = F.trim(F.coalesce("e.loc", F.lit(""))), F.trim("e.lastmod")
    return rows.select(at.alias("url"), F.when(changed != "", changed).alias("lastmod")).where("url != ''").distinct()


def canonical_url(url: Column, html: Column) -> Column:
    """The address that a page gives as its own, else the one it was read from."""
    link = F.regexp_extract(html, r"(?is)(<link\s[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*>)", 1)
    named = F.regexp_extract(link, r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(url)


def website_changes(previous: DataFrame, fetched: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """url, op of a crawl under canonical addresses, with deletes for known pages that a complete sitemap no longer lists.

    previous: url, etag. fetched: url, status, etag, html. listed: url.
    """
    named = fetched.withColumn("url", canonical_url(F.col("url"), F.col("html"))).select("url", "status", "etag").distinct()
    changes = crawl_changes(previous, named)
    if listed is None:
        return changes
    gone = missing_from(listed, previous).join(named.select("url"), "url", "left_anti")
    return changes.unionByName(gone.select("url", "op"))
