"""Versioned, incremental ingestion: hash skips, versions, tombstones, states, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Document states and where each may go; every live state may also fail or be deleted.
NEXT_STATES = {
    "DISCOVERED": ("FETCHING",),
    "FETCHING": ("FETCHED",),
    "FETCHED": ("FETCHING", "PARSING"),
    "PARSING": ("PARSED",),
    "PARSED": ("NORMALIZING", "PARSING", "FETCHING"),
    "NORMALIZING": ("NORMALIZED",),
    "NORMALIZED": ("CHUNKING", "PARSING", "NORMALIZING", "FETCHING"),
    "CHUNKING": ("CHUNKED",),
    "CHUNKED": ("EMBEDDING", "CHUNKING", "PARSING", "NORMALIZING", "FETCHING"),
    "EMBEDDING": ("EMBEDDED",),
    "EMBEDDED": ("INDEXING", "FETCHING"),
    "INDEXING": ("INDEXED",),
    "INDEXED": ("FETCHING", "PARSING", "EMBEDDING", "INDEXING"),
    "FAILED": ("FETCHING", "PARSING", "NORMALIZING", "CHUNKING", "EMBEDDING", "INDEXING"),
}
FINISHED = ("NORMALIZED", "CHUNKED", "EMBEDDED", "INDEXED")
UNFINISHED = ("FETCHED", "PARSING", "PARSED", "NORMALIZING", "NORMALIZED", "CHUNKING", "FAILED")
# Types by file extension, other names of types, and the types and size that uploads may have.
EXTENSION_TYPES = {
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
TYPE_ALIASES = {"text/x-markdown": "text/markdown", "application/x-pdf": "application/pdf"}
UNKNOWN_TYPE = "application/octet-stream"
MAX_UPLOAD = 50 * 1024 * 1024


def _lookup(key: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for k, v in table.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def upload_mime(filename: Column, declared: Column) -> Column:
    """Type by extension where the extension is known, else the declared one; null if neither tells."""
    clean = F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1))))
    stated = F.coalesce(_lookup(clean, TYPE_ALIASES), F.when(clean != "", clean))
    named = _lookup(F.lower(F.regexp_extract(filename, r"[^/\\]+(\.[^./\\]+)$", 1)), EXTENSION_TYPES)
    return F.coalesce(named, F.when(stated != UNKNOWN_TYPE, stated))


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Add mime_type and rejection (null if accepted). uploads: filename, declared_mime, size_bytes."""
    rows = uploads.withColumn("mime_type", upload_mime(F.col("filename"), F.col("declared_mime")))
    reason = (
        F.when(F.col("size_bytes") <= 0, "empty")
        .when(F.col("size_bytes") > MAX_UPLOAD, "too large")
        .when(F.col("mime_type").isNull(), "unknown type")
        .when(~F.col("mime_type").isin(*sorted(set(EXTENSION_TYPES.values()))), "type not allowed")
    )
    return rows.withColumn("rejection", reason)


def can_transition(state: Column, target: Column) -> Column:
    allowed = F.lit(False)
    for s, targets in NEXT_STATES.items():
        also = {"DELETED"} | ({"FAILED"} - {s})
        allowed = F.when(state == s, target.isin(*targets, *sorted(also))).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def successors(state: str) -> set[str]:
    """States that may follow a state."""
    return {*NEXT_STATES[state], "DELETED", "FAILED"} - ({"FAILED"} if state == "FAILED" else set()) if state in NEXT_STATES else set()


def transitions(spark: SparkSession) -> DataFrame:
    """state, target: the whole table, for joins."""
    rows = [(s, t) for s in NEXT_STATES for t in sorted(successors(s))]
    return spark.createDataFrame(rows, "state string, target string")


def invalid_transitions(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a state log that do not follow from the row before of the same key."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("previous", before).where(F.col("previous").isNotNull() & ~can_transition(F.col("previous"), F.col("state")))


def unchanged(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming rows whose bytes the current version already has, in a state that needs no more work.

    incoming: document_id, content_hash. current: document_id, content_hash, version_number, state.
    """
    have = current.where((F.col("version_number") > 0) & F.col("state").isin(*FINISHED)).select("document_id", "content_hash")
    return incoming.join(have, ["document_id", "content_hash"], "left_semi")


def changed(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """What unchanged() leaves: the work of this run."""
    have = current.where((F.col("version_number") > 0) & F.col("state").isin(*FINISHED)).select("document_id", "content_hash")
    return incoming.join(have, ["document_id", "content_hash"], "left_anti")


def versions(arrivals: DataFrame) -> DataFrame:
    """document_id, version_number, content_hash, arrived, is_current of arrivals in order.

    An arrival with the hash of the one before adds no version.
    """
    order = Window.partitionBy("document_id").orderBy("arrived")
    fresh = arrivals.withColumn("_before", F.lag("content_hash").over(order)).where(~F.col("content_hash").eqNullSafe(F.col("_before")))
    last = F.lead("arrived").over(order).isNull()
    return fresh.select("document_id", F.row_number().over(order).alias("version_number"), "content_hash", "arrived", last.alias("is_current"))


def upsert_versions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The version table after a batch: changed documents retire their current version and gain one.

    current: document_id, version_number, content_hash, is_current. incoming: one row per document.
    """
    now = current.where("is_current").select("document_id", F.col("content_hash").alias("_hash"))
    top = current.groupBy("document_id").agg(F.max("version_number").alias("_top"))
    fresh = incoming.join(now, "document_id", "left").join(top, "document_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("_hash")))
    added = fresh.select("document_id", (F.coalesce("_top", F.lit(0)) + 1).alias("version_number"), "content_hash", F.lit(True).alias("is_current"))
    retired = added.select("document_id", F.lit(True).alias("_gone"))
    kept = current.join(retired, "document_id", "left").withColumn("is_current", F.col("is_current") & F.col("_gone").isNull()).drop("_gone")
    return kept.select(added.columns).unionByName(added)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Keyed upsert: of the rows of a key the last one in order counts."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def tombstone(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents named by gone become DELETED, without a current version; others stay."""
    names = gone.select("document_id", F.lit(True).alias("_gone")).distinct()
    rows = documents.join(names, "document_id", "left").withColumn("_gone", F.col("_gone").isNotNull())
    return rows.withColumns({"state": F.when(F.col("_gone"), "DELETED").otherwise(F.col("state")), "is_current": F.col("is_current") & ~F.col("_gone")}).drop("_gone")


def undelete(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Deleted documents that are discovered again begin anew as DISCOVERED."""
    names = seen.select("document_id", F.lit(True).alias("_seen")).distinct()
    rows = documents.join(names, "document_id", "left")
    again = F.col("_seen").isNotNull() & (F.col("state") == "DELETED")
    return rows.withColumn("state", F.when(again, "DISCOVERED").otherwise(F.col("state"))).drop("_seen")


def merge_documents(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """The document table after a discovery: new ones enter as DISCOVERED, known ones take the new fields.

    documents: document_id, organization_id, title, mime_type, source_url, metadata,
    allowed_users, allowed_groups, state. seen: one row per document with the same
    fields but state, and filename, source_type. Metadata is merged, the new entry
    of a name counts. Documents without lists are readable by their organization. A
    deleted document begins anew; an id of another organization fails the job.
    Needs LAST_WIN maps (session.SETTINGS).
    """
    own = seen.withColumn("metadata", F.map_concat(F.create_map(F.lit("original_filename"), F.col("filename"), F.lit("source"), F.col("source_type")), F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    org = F.col("organization_id").cast("string")
    unlisted = F.col("allowed_users").isNull() & F.col("allowed_groups").isNull()
    none = F.array().cast("array<string>")
    own = own.select(
        "document_id", "organization_id", "title", "mime_type", "source_url", "metadata",
        F.when(unlisted, F.array(org)).otherwise(F.coalesce("allowed_users", none)).alias("allowed_users"),
        F.when(unlisted, F.array(F.concat(F.lit("org:"), org))).otherwise(F.coalesce("allowed_groups", none)).alias("allowed_groups"),
    )
    old, new = documents.alias("o"), own.alias("n")
    both = old.join(new, F.col("o.document_id") == F.col("n.document_id"), "full_outer")
    known, fresh = F.col("o.document_id").isNotNull(), F.col("n.document_id").isNotNull()
    clash = known & fresh & ~F.col("o.organization_id").eqNullSafe(F.col("n.organization_id"))
    org_id = F.when(clash, F.raise_error(F.lit("a document id is used by two organizations")).cast(dict(documents.dtypes)["organization_id"])).otherwise(F.coalesce("o.organization_id", "n.organization_id"))
    newer = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    metadata = F.when(known & fresh, F.map_concat(F.coalesce("o.metadata", F.create_map().cast("map<string,string>")), "n.metadata")).otherwise(F.coalesce("n.metadata", "o.metadata"))
    state = F.when(~known | (fresh & (F.col("o.state") == "DELETED")), "DISCOVERED").otherwise(F.col("o.state"))
    return both.select(
        F.coalesce("o.document_id", "n.document_id").alias("document_id"), org_id.alias("organization_id"), newer("title"), newer("mime_type"), newer("source_url"),
        metadata.alias("metadata"), newer("allowed_users"), newer("allowed_groups"), state.alias("state"),
    )


def accepted_work(items: DataFrame, sources: DataFrame, sync: bool = False) -> DataFrame:
    """Items with a refusal, null where their source takes work. items: source_id, ...; sources: source_id, status, source_type.

    Paused, disconnected and unknown sources refuse; uploads have nothing to sync.
    """
    states = sources.select("source_id", F.col("status").alias("_status"), F.col("source_type").alias("_type"))
    reason = F.when(F.col("_status").isNull(), "unknown source").when(F.col("_status") == "PAUSED", "paused").when(F.col("_status") == "DISCONNECTED", "disconnected")
    if sync:
        reason = F.coalesce(reason, F.when(F.col("_type") == "FILE_UPLOAD", "nothing to sync"))
    return items.join(states, "source_id", "left").withColumn("refusal", reason).drop("_status", "_type")


def update_sources(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources with the status, the settings (map, merged) and the checkpoint (reset: emptied) of an update each.

    Needs LAST_WIN maps (session.SETTINGS).
    """
    new = updates.select("source_id", F.col("status").alias("_status"), F.col("config").alias("_config"), F.coalesce("reset", F.lit(False)).alias("_reset"))
    empty = F.create_map().cast("map<string,string>")
    return sources.join(new, "source_id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "config": F.map_concat(F.coalesce("config", empty), F.coalesce("_config", empty)),
            "checkpoint": F.when(F.coalesce("_reset", F.lit(False)), F.lit("{}")).otherwise(F.col("checkpoint")),
        }
    ).drop("_status", "_config", "_reset")


def needs_work(state: Column, job_type: Column) -> Column:
    return (job_type == "REPROCESS") | state.isin(*UNFINISHED)


def job_key(source: Column, document: Column, content_hash: Column, kind: str = "upload") -> Column:
    return F.concat_ws(":", F.lit(kind), source.cast("string"), document.cast("string"), content_hash)


def coalesce_jobs(jobs: DataFrame) -> DataFrame:
    """One job per key among those that wait or run; finished ones stay. jobs: job_id, key, status, created_at."""
    live = F.col("status").isin("QUEUED", "RUNNING")
    place = F.row_number().over(Window.partitionBy("key", live).orderBy("created_at", "job_id"))
    return jobs.withColumn("_n", place).where(~live | (F.col("_n") == 1)).drop("_n")


def dead_letters(jobs: DataFrame) -> DataFrame:
    """Failed jobs, to be fed again."""
    return jobs.where(F.col("status") == "FAILED")


def sync_outcomes(items: DataFrame, by: list[str]) -> DataFrame:
    """Counts of discovered, fetched, queued, skipped and deleted items. items: op, unchanged."""
    deleted, skipped = F.col("op") == "delete", (F.col("op") != "delete") & F.col("unchanged")
    return items.groupBy(*by).agg(
        F.count("*").alias("discovered"), F.count_if(~deleted).alias("fetched"), F.count_if(~deleted & ~F.col("unchanged")).alias("queued"),
        F.count_if(skipped).alias("skipped"), F.count_if(deleted).alias("deleted"),
    )


def late_events(events: DataFrame, seconds: int, key: str = "user_id", at: str = "ts", arrived: str = "event_id") -> DataFrame:
    """Events with is_late: more than so many seconds behind the latest event of their key that arrived before them.

    What a watermark drops is kept beside the rest, as a side table with is_late.
    """
    before = Window.partitionBy(key).orderBy(arrived).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.col(at).cast("timestamp")).over(before)
    return events.withColumn("is_late", F.coalesce(F.col(at).cast("timestamp") < seen - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False)))


def fixed_window_denials(events: DataFrame, limit: int, seconds: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """key, window_start, calls, denied: calls per epoch-aligned window, and how many are over the limit."""
    window = F.window(F.col(at).cast("timestamp"), f"{seconds} seconds")
    calls = events.groupBy(key, window.alias("w")).agg(F.count("*").alias("calls"))
    return calls.select(key, F.col("w.start").alias("window_start"), "calls", F.greatest(F.col("calls") - limit, F.lit(0)).alias("denied"))
