"""Exact and near duplicate edges between documents."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hamming, similarity
from corpusloom.session import stored

MAX_HAMMING = 3
KEY_BLOCKS = 3
SCORE_DIGITS = 4

EDGE = ["org", "canonical_id", "duplicate_id", "kind", "score"]


def current_candidates(docs: DataFrame) -> DataFrame:
    """Current versions of documents that are not deleted."""
    return docs.where(F.col("is_current") & (F.col("state") != "DELETED"))


def _shared(docs: DataFrame) -> DataFrame:
    """o, h, _first of each organization and hash with more than one document: its earliest, as (created_at, id).

    Summed beside the scan before anything is sent, so that a group of any size is one row.
    """
    groups = docs.groupBy("org", "content_hash").agg(F.min(F.struct("created_at", "id")).alias("_first"), F.count("*").alias("_n"))
    return stored(groups.where("_n > 1").select(F.col("org").alias("o"), F.col("content_hash").alias("h"), "_first"), "shared-hashes")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Edges from the earliest document of equal hash in an organization to each later one.

    docs: org, id, created_at, content_hash. A group of n copies gives n - 1 edges,
    and its documents meet its one row where they lie or in the parts that a skewed
    join is split into.
    """
    docs = stored(docs.select("org", "id", "created_at", "content_hash"), "hashed-documents")
    same = F.col("org").eqNullSafe(F.col("o")) & F.col("content_hash").eqNullSafe(F.col("h"))
    return (
        docs.join(_shared(docs).hint("merge"), same)
        .where(F.struct("created_at", "id") > F.col("_first"))
        .select("org", F.col("_first.id").alias("canonical_id"), F.col("id").alias("duplicate_id"), F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    )


def near_links(nodes: DataFrame, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """org, a, b: pairs of fingerprints, either way round and each with itself, that differ in at most max_hamming bits.

    nodes: org, simhash, distinct. A fingerprint is cut into max_hamming + 3 blocks;
    any two near ones agree in some three of them. Keys are the bits of three
    blocks, about half of all, so that few of them meet by chance however many there are.
    """
    if not 0 <= max_hamming <= MAX_HAMMING:
        raise ValueError(f"links are found up to {MAX_HAMMING} bits")
    blocks = max_hamming + KEY_BLOCKS
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.col("simhash").bitwiseAND(F.lit(signed(sum(masks[i] for i in some))).cast("long")) for some in combinations(range(blocks), KEY_BLOCKS)])
    keyed = nodes.select("org", "simhash", F.posexplode(keys).alias("blocks", "key"))
    a, b = keyed.withColumnRenamed("simhash", "a"), keyed.withColumnRenamed("simhash", "b")
    # Both sides grow with the documents: never broadcast, which would bring them to the driver.
    near = a.join(b.hint("merge"), ["org", "blocks", "key"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= max_hamming)).select("org", "a", "b").distinct()
    same = nodes.select("org", F.col("simhash").alias("a"), F.col("simhash").alias("b"))
    return near.unionByName(near.select("org", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)


def near_duplicates(docs: DataFrame, max_hamming: int = MAX_HAMMING, every_pair: bool = False) -> DataFrame:
    """Edges to earlier documents whose fingerprints differ in at most max_hamming bits.

    docs: org, id, created_at, content_hash, simhash. A document with an exact
    match before it has no near edges, and fingerprint 0 has none. Equal
    fingerprints are one node. A document has one edge to each near node, to the
    node's earliest document, so that n documents of one fingerprint give n - 1
    edges; the node's other documents are reached through theirs. With every_pair
    each earlier document of a near node gets an edge of its own.
    """
    # Read four times below; written once, so that fingerprints are made once.
    docs = stored(docs.select("org", "id", "created_at", "content_hash", "simhash"), "fingerprints")
    order = F.struct("created_at", "id")
    fresh = docs.where(F.col("simhash") != 0).withColumn("_at", order)
    same = F.col("org").eqNullSafe(F.col("o")) & F.col("content_hash").eqNullSafe(F.col("h"))
    fresh = fresh.join(_shared(fresh).hint("merge"), same, "left").withColumn("_exact", F.coalesce(F.col("_first") < F.col("_at"), F.lit(False))).drop("o", "h", "_first")
    nodes = stored(fresh.groupBy("org", "simhash").agg(F.min("_at").alias("_old")), "fingerprint-nodes")
    links = near_links(nodes.select("org", "simhash"), max_hamming)
    earlier = (fresh if every_pair else nodes).select("org", F.col("simhash").alias("a"), F.col("_at" if every_pair else "_old").alias("_old"))
    later = fresh.where(~F.col("_exact")).select("org", F.col("simhash").alias("b"), F.col("_at").alias("_new"))
    return (
        links.hint("merge").join(earlier.hint("merge"), ["org", "a"]).join(later.hint("merge"), ["org", "b"])
        .where(F.col("_old") < F.col("_new"))
        .select(
            "org", F.col("_old.id").alias("canonical_id"), F.col("_new.id").alias("duplicate_id"), F.lit("near").alias("kind"),
            F.bround(similarity(F.col("a"), F.col("b")), SCORE_DIGITS).alias("score"),
        )
    )


def replace_edges(edges: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges after a re-run: those that touch a re-run document go, the fresh ones come."""
    ids = touched.select(F.col("id").alias("_id")).distinct()
    left = edges.join(ids, edges["canonical_id"] == ids["_id"], "left_anti")
    left = left.join(ids, left["duplicate_id"] == ids["_id"], "left_anti")
    return left.unionByName(fresh)


def duplicates_of(edges: DataFrame, document_id) -> DataFrame:
    """Edges on either side of a document."""
    return edges.where((F.col("canonical_id") == document_id) | (F.col("duplicate_id") == document_id))
