"""Filters, access, dense and sparse top-k, fusion, rewriting, reranking and context.

Everything works on batches: queries (qid, ...) against chunks (chunk_id, ...),
with hits as (qid, chunk_id, score, rank, ...). Ranks are total orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import query_tokens, token_count, trim, ws_tokens
from corpusloom.operators import inverted
from corpusloom.operators.inverted import Index
from corpusloom.session import stored

RRF_K = 60
CONTEXT_BUDGET = 4000
#: Queries that are sent to every task at once; more go in blocks of so many.
QUERY_BLOCK = 2000
ROW_BLOCK = 20_000
#: Queries of a block that are multiplied at a time.
SLICE = 256


# --- predicates -----------------------------------------------------------------


def metadata_predicate(
    organization, *, workspace=None, source=None, source_types: Sequence = (), document_ids: Sequence = (), languages: Sequence = (), deletions: bool = True
) -> Column:
    """Tenant and version predicate, with optional narrowing; pushed down to the scan as a conjunction."""
    keep = (F.col("organization_id") == organization) & F.col("is_current")
    if deletions:
        keep = keep & F.col("deleted_at").isNull() & (F.col("state") != "DELETED")
    for name, value in (("workspace_id", workspace), ("source_id", source)):
        if value is not None:
            keep = keep & (F.col(name) == value)
    for name, values in (("source_type", source_types), ("document_id", document_ids), ("language", languages)):
        if values:
            keep = keep & F.col(name).isin(*values)
    return keep


def can_read(users: Column, groups: Column, user_id: Column, email: Column, member_of: Column) -> Column:
    """No list at all is public; else the user, the lower-cased e-mail, or a shared group must be listed."""
    none = F.array().cast("array<string>")
    users, groups, member_of = F.coalesce(users, none), F.coalesce(groups, none), F.coalesce(member_of, none)
    public = (F.size(users) == 0) & (F.size(groups) == 0)
    listed = F.coalesce(F.array_contains(users, user_id), F.lit(False)) | F.coalesce(F.array_contains(users, F.lower(email)), F.lit(False))
    return public | listed | F.coalesce(F.arrays_overlap(groups, member_of), F.lit(False))


def principal_groups(stored_groups: Column, role: Column, organization: Column, email: Column) -> Column:
    """Stored groups with the groups that every principal has by role, organization and e-mail."""
    own = F.array(F.concat(F.lit("role:"), role), F.concat(F.lit("org:"), organization.cast("string")), F.concat(F.lit("email:"), F.lower(email)))
    return F.array_union(F.coalesce(stored_groups, F.array().cast("array<string>")), own)


def _access_lists(docs: DataFrame) -> DataFrame:
    """docs with acl, their users and groups in order, and the names that open it: '*' for everyone."""
    none = F.array().cast("array<string>")
    ordered = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(c), none), lambda x: x.isNotNull())))
    # A list that holds nothing but nulls names nobody, and is still a list.
    public = (F.size(F.coalesce("allowed_users", none)) == 0) & (F.size(F.coalesce("allowed_groups", none)) == 0)
    return docs.withColumn("acl", F.struct(public.alias("public"), ordered("allowed_users").alias("u"), ordered("allowed_groups").alias("g")))


def _tagged(tag: str, names: Column) -> Column:
    return F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(tag), x))


def _opened(principals: DataFrame, lists: DataFrame) -> DataFrame:
    """qid, acl: which of the distinct lists each principal may read. They meet on what the lists name."""
    none = F.array().cast("array<string>")
    names = F.when(F.col("acl.public"), F.array(F.lit("*"))).otherwise(F.concat(_tagged("u:", F.col("acl.u")), _tagged("g:", F.col("acl.g"))))
    own = F.concat(F.array(F.lit("*")), _tagged("u:", F.array_distinct(F.array("user_id", F.lower("email")))), _tagged("g:", F.array_distinct(F.coalesce("member_of", none))))
    held = principals.select("qid", F.explode(own).alias("name"))
    return held.join(lists.select("acl", F.explode(names).alias("name")), "name").select("qid", "acl").distinct()


def readable_counts(principals: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, readable: how many documents each principal may read; principals that may read none are left out.

    principals: qid, user_id, email, member_of. docs: allowed_users, allowed_groups.
    Documents are first counted by their lists, and the few distinct lists meet
    principals, so that no pair of principal and document is made.
    """
    lists = _access_lists(docs).groupBy("acl").agg(F.count("*").alias("n"))
    return _opened(principals, lists).join(lists, "acl").groupBy("qid").agg(F.sum("n").alias("readable"))


def readable_bitmaps(principals: DataFrame, docs: DataFrame, index: Index) -> DataFrame:
    """qid, shard, allowed: a bit for each position of an index's shard whose chunk the principal may read.

    principals: qid, user_id, email, member_of. docs: chunk_id, allowed_users,
    allowed_groups of the chunks that may be found at all. A list's chunks become one
    bitmap a shard; a principal's are the OR of those of the lists that it opens,
    worked out once for all principals that open the same ones.
    """
    placed = index.docs.join(_access_lists(docs).select("chunk_id", "acl"), "chunk_id")
    bits = placed.groupBy("acl", "shard").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("bits"))
    bits = stored(bits, "readable-bits")
    opened = _opened(principals, bits.select("acl").distinct()).groupBy("qid").agg(F.array_sort(F.collect_set("acl")).alias("opens"))
    opened = stored(opened, "opened-lists")
    merged = opened.select("opens").distinct().select("opens", F.explode("opens").alias("acl")).join(bits, "acl")
    merged = merged.groupBy("opens", "shard").agg(F.bitmap_or_agg("bits").alias("allowed"))
    return opened.join(merged, "opens").select("qid", "shard", "allowed")


# --- top-k ----------------------------------------------------------------------


def ranked(hits: DataFrame, k: int, *order: Column, by: str = "qid") -> DataFrame:
    """The best k rows per query, numbered from 1."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, rows: DataFrame, asked: int = QUERY_BLOCK, held: int = ROW_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with _qblock and _rblock: a query once for every block of rows, a row once for every block of queries."""
    asked, held = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, asked), (rows, held)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbered = queries.withColumn("_qblock", own("qid", asked)).withColumn("_rblock", every(held))
    return numbered, rows.withColumn("_rblock", own("chunk_id", held)).withColumn("_qblock", every(asked))


def paired(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every query with every row, in blocks of bounded size on both sides.

    A key is a block of queries with a block of rows, so that pairs are spread
    over as many keys as there are such blocks, at every size.
    """
    numbered, spread = _blocks(queries, rows)
    return spread.join(numbered, ["_qblock", "_rblock"]).drop("_qblock", "_rblock")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector in double precision with length 1; a zero vector stays."""
    size = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    """Scores to so many digits, halves away from zero."""
    if digits is None:
        return score
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(score) * scale + 0.5), score) / scale + 0.0


def best_of(score: np.ndarray, k: int, order: np.ndarray, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of the k best, ties by order; -inf stands for no score."""
    at = np.nonzero(score > -np.inf)[0]
    if len(at) > k:
        # What is under the k-th by more than rounding can lift is left out before it is sorted.
        least = np.partition(score[at], len(at) - k)[len(at) - k] - (0.0 if digits is None else 10.0**-digits)
        at = at[score[at] >= least]
    shown = rounded(score[at], digits)
    best = np.lexsort((order[at], -shown))[:k]
    return at[best], shown[best]


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one size as rows of unit length; zero rows stay."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def column(rows: pa.Table, name: str) -> pa.Array:
    found = rows[name].combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def id_order(rows: pa.Table, name: str) -> np.ndarray:
    """The place of each row in order of an id, nulls first."""
    order = np.empty(rows.num_rows, dtype=np.int64)
    order[pc.sort_indices(rows, sort_keys=[(name, "ascending")], null_placement="at_start").to_numpy()] = np.arange(rows.num_rows)
    return order


def _meet(queries: DataFrame, rows: DataFrame, run: Callable, out: T.StructType, asked: int = QUERY_BLOCK) -> DataFrame:
    """run(rows, queries) as Arrow tables for every block of rows with every block of queries."""
    left, right = _blocks(queries, rows, asked)
    keys = ["_qblock", "_rblock"]
    return right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(run, out)


def _dense_block(k: int, digits: int | None) -> Callable:
    """The k best rows of a block for each of its queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        order, of_rows, of_queries = id_order(rows, "chunk_id"), column(rows, "_v"), column(queries, "_q")
        row_dim, query_dim = (pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) for v in (of_rows, of_queries))
        by_order = np.argsort(order)
        asked, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for dim in np.unique(query_dim):
            own = np.nonzero(query_dim == dim)[0]
            fit = np.nonzero(row_dim == dim)[0] if dim >= 0 else np.zeros(0, np.int64)
            # Pairs without a score come last, as many as are needed.
            rest = by_order[~np.isin(by_order, fit)] if len(fit) < k else fit[:0]
            x = matrix(of_rows.take(pa.array(fit)), dim) if len(fit) else None
            for begin in range(0, len(own), SLICE):
                part = own[begin : begin + SLICE]
                if x is not None:
                    score = matrix(of_queries.take(pa.array(part)), dim) @ x.T
                    # NaN is greater than any number.
                    score[np.isnan(score)] = np.inf
                for i, q in enumerate(part):
                    at, shown = best_of(score[i], k, order[fit], digits) if x is not None else (fit, np.zeros(0))
                    more = rest[: k - len(at)]
                    asked.append(np.full(len(at) + len(more), q))
                    found += [fit[at], more]
                    scores += [shown, np.full(len(more), -np.inf)]
        score = np.concatenate(scores)
        shown = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
        keys = ["_qblock", "_rblock"]
        return pa.table({**_taken(queries.drop_columns(["_q", *keys]), asked), **_taken(rows.drop_columns(["_v", *keys]), found), "score": shown})

    return run


def _taken(rows: pa.Table, at: list[np.ndarray]) -> dict[str, pa.ChunkedArray]:
    some = rows.take(pa.array(np.concatenate(at)))
    return {n: some[n] for n in some.column_names}


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, digits: int | None = None, allowed: Column | None = None) -> DataFrame:
    """queries (qid, query_vector, ...), chunks (chunk_id, vector, ...): hits by cosine, ties to the smaller chunk_id.

    A block of queries and a block of rows are multiplied in one task, which sends
    on the k best rows of its block for each query, so that pairs are never rows.
    allowed: a condition on the columns of query and chunk, tried before top-k for
    every pair.
    """
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v)
    if allowed is None:
        q = queries.withColumn("_q", whole(F.col("query_vector"))).drop("query_vector")
        c = chunks.withColumn("_v", whole(F.col("vector"))).drop("vector")
        kept = [f for df, own in ((q, "_q"), (c, "_v")) for f in df.schema.fields if f.name != own]
        out = T.StructType([*kept, T.StructField("score", T.DoubleType())])
        hits = _meet(q, c, _dense_block(k, digits), out)
        return ranked(hits, k, F.desc("score"), F.col("chunk_id"))
    # Both sides are scaled to unit length once, so that a pair costs one product.
    q = queries.withColumn("_q", unit(F.col("query_vector"))).drop("query_vector")
    c = chunks.withColumn("_v", unit(F.col("vector"))).drop("vector")
    score = dot(F.col("_q"), F.col("_v"))
    hits = paired(q, c).where(allowed).withColumn("score", F.round(score, digits) if digits is not None else score).drop("_q", "_v")
    return ranked(hits, k, F.desc("score"), F.col("chunk_id"))


def nearest_numbers(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: for each whole number qid the k nearest chunk_id by distance (score), ties to the smaller.

    In a block of sorted numbers these are among the k on either side.
    """

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        held, asked = np.sort(column(rows, "chunk_id").to_numpy()), column(queries, "qid").to_numpy()
        found = []
        for begin in range(0, len(asked) if len(held) else 0, SLICE):
            q = asked[begin : begin + SLICE, None]
            at = np.searchsorted(held, q) + np.arange(-k, k)
            near = held[np.clip(at, 0, len(held) - 1)]
            far = np.where((at >= 0) & (at < len(held)), np.abs(near - q).astype(np.float64), np.inf)
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            got = np.stack([np.repeat(q, best.shape[1], axis=1), np.take_along_axis(near, best, 1)], axis=2), np.take_along_axis(far, best, 1)
            ok = got[1] < np.inf
            found.append((got[0][ok], got[1][ok]))
        pairs = np.concatenate([p for p, _ in found] or [np.zeros((0, 2), np.int64)])
        score = np.concatenate([d for _, d in found] or [np.zeros(0)])
        return pa.table({"qid": pairs[:, 0], "chunk_id": pairs[:, 1], "score": score})

    named = lambda df, name: df.select(F.col(name).cast("long").alias(name)).where(F.col(name).isNotNull())
    out = T.StructType([T.StructField("qid", T.LongType()), T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])
    hits = _meet(named(queries, "qid"), named(chunks, "chunk_id"), run, out, asked=10 * QUERY_BLOCK)
    return ranked(hits, k, F.col("score"), F.col("chunk_id"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, n_terms over distinct terms."""
    terms = queries.select("qid", F.array_distinct(query_tokens(F.col("query"))).alias("t"))
    return terms.select("qid", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def sparse_matches(queries: DataFrame, index: Index, allowed: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, tf: chunks that hold every term of the query."""
    return inverted.matches(queries, index, allowed)


def cover_density(spots: Column, n_terms: Column) -> Column:
    """Sum over the shortest stretches that hold all terms of 1 over their length.

    The last place of each term is kept while walking the places in order; a
    stretch counts when its beginning moves.
    """
    zero = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("sum"))

    def step(acc: Column, s: Column) -> Column:
        last = F.map_concat(acc["last"], F.map_from_arrays(F.array(s["term"]), F.array(s["at"])))
        start = F.array_min(F.map_values(last))
        whole = (F.size(F.map_keys(last)) == n_terms) & (start > acc["start"])
        return F.struct(
            last.alias("last"),
            F.when(whole, start).otherwise(acc["start"]).alias("start"),
            (acc["sum"] + F.when(whole, F.lit(1.0) / (s["at"] - start + 1)).otherwise(F.lit(0.0))).alias("sum"),
        )

    return F.aggregate(spots, zero, step, lambda acc: acc["sum"])


def sparse_top_k(queries: DataFrame, index: Index, chunks: DataFrame, k: int, digits: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Hits that hold all terms by cover density, then ordinal, then chunk_id. Needs LAST_WIN maps (session.SETTINGS).

    chunks: chunk_id, ordinal, text. Places of terms are looked up in the matching chunks alone.
    """
    found = inverted.matches(queries, index, allowed).drop("tf").join(chunks.select("chunk_id", "ordinal", "text"), "chunk_id")
    asked = queries.select("qid", F.array_distinct(query_tokens(F.col("query"))).alias("_terms"))
    placed = F.transform(query_tokens(F.col("text")), lambda t, i: F.struct(i.alias("at"), t.alias("term")))
    rows = found.join(asked, "qid").withColumn("spots", F.filter(placed, lambda s: F.array_contains(F.col("_terms"), s["term"])))
    score = cover_density(F.col("spots"), F.size("_terms"))
    hits = rows.select("qid", "chunk_id", "ordinal", (F.round(score, digits) if digits is not None else score).alias("score"))
    return ranked(hits, k, F.desc("score"), F.col("ordinal"), F.col("chunk_id"))


def bm25_top_k(queries: DataFrame, index: Index, k: int, digits: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 over any matching term: qid, chunk_id, score, rank, ties to the smaller chunk_id."""
    hits = inverted.bm25(queries, index, k, digits, allowed).drop("read")
    hits = hits.withColumn("score", F.round("score", digits)) if digits is not None else hits
    return ranked(hits, k, F.desc("score"), F.col("chunk_id")).select("qid", "chunk_id", "score", "rank")


# --- fusion and rewriting ---------------------------------------------------------


def fuse(lists: DataFrame, k: int = RRF_K, top_k: int = 10) -> DataFrame:
    """lists (qid, list_no, rank, chunk_id, scores map): reciprocal ranks added up over the lists.

    Ties keep the order of first appearance; of equal component names the last list's counts.
    """
    grouped = lists.groupBy("qid", "chunk_id").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("_first"),
        F.array_sort(F.collect_list(F.struct("list_no", F.map_entries("scores").alias("e")))).alias("_lists"),
    )
    merged = F.aggregate("_lists", F.create_map().cast("map<string,double>"), lambda acc, x: F.map_concat(acc, F.map_from_entries(x["e"])))
    hits = ranked(grouped, top_k, F.desc("score"), F.col("_first"))
    scores = F.map_concat(merged, F.create_map(F.lit("rrf"), F.col("score")))
    return hits.select("qid", "chunk_id", "score", "rank", scores.alias("scores"))


def expand_query(query: Column, most: int = 3) -> Column:
    """array: the query, its first and last four words if it has more than three, and one variant of its domain."""
    # Python's \w and \s are Unicode classes, hence the flag.
    words = ws_tokens(F.regexp_replace(query, r"(?U)[^\w\s]", ""))
    low = F.lower(query)
    none = F.array().cast("array<string>")
    ends = F.when(F.size(words) > 3, F.array(F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, -4, 4), " "))).otherwise(none)
    how = F.concat(F.regexp_replace(query, r"(?i)how (to|do i)\s*", ""), F.lit(" workflow procedure guide"))
    fix = F.concat(query, F.lit(" fix issue solution troubleshoot"))
    domain = (
        F.when(F.contains(low, F.lit("how to")) | F.contains(low, F.lit("how do i")), F.array(how))
        .when(F.contains(low, F.lit("error")) | F.contains(low, F.lit("fail")), F.array(fix))
        .otherwise(none)
    )
    everything = F.concat(F.array(trim(query)), ends, domain)
    lows = F.transform(everything, F.lower)
    firsts = F.filter(everything, lambda v, i: F.array_position(lows, F.lower(v)) == i + 1)
    return F.slice(firsts, 1, most)


# The wording of rewritten queries below and above.
def hypothetical_document(query: Column) -> Column:
    """A passage such as might answer the query, for its embedding."""
    return F.format_string(
        "Overview and policy regarding %s. This document describes the key principles, guidelines, requirements, and specifications for %s. "
        "Section 1: General definitions and scope. Section 2: Implementation details and procedures.",
        query, query,
    )


# --- reranking and context --------------------------------------------------------


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds; 0 without terms."""
    q = F.array_distinct(query_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, query_tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, new_score: Column, top_k: int) -> DataFrame:
    """Order by the new score, then the old one, then the old rank; the new score replaces the old."""
    rows = hits.withColumns({"_old": F.col("score"), "_was": F.col("rank"), "score": F.coalesce(new_score, F.lit(0.0))})
    if "scores" in hits.columns:
        rows = rows.withColumn("scores", F.map_concat("scores", F.create_map(F.lit("reranker"), F.col("score"))))
    return ranked(rows, top_k, F.desc("score"), F.desc("_old"), F.col("_was")).drop("_old", "_was")


def inverse_rank(rank: Column) -> Column:
    return F.lit(1.0) / rank


def select_context(hits: DataFrame, budget: int | None = CONTEXT_BUDGET) -> DataFrame:
    """qid, position, chunk_id, token_count: hits in rank order while they fit.

    hits: qid, rank, chunk_id, parent_chunk_id, token_count, text. One chunk per
    parent; the first always fits, one that is too long is passed over, and the
    walk ends when the budget is met. No budget, or 0, means the default one.
    """
    most = budget or CONTEXT_BUDGET
    count = F.when(F.coalesce("token_count", F.lit(0)) > 0, F.col("token_count")).otherwise(F.greatest(token_count(F.col("text")), F.lit(1)))
    item = F.struct("rank", F.coalesce("parent_chunk_id", "chunk_id").cast("string").alias("key"), F.col("chunk_id").alias("chunk_id"), count.cast("int").alias("tokens"))
    grouped = hits.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("_hits"))
    kind = dict(grouped.dtypes)["_hits"]
    zero = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, h: Column) -> Column:
        seen = F.exists(acc["out"], lambda o: o["key"] == h["key"])
        fits = (acc["used"] + h["tokens"] <= most) | (F.size(acc["out"]) == 0)
        take = ~seen & fits & (acc["used"] < most)
        return F.struct(
            F.when(take, F.array_append(acc["out"], h)).otherwise(acc["out"]).alias("out"),
            (acc["used"] + F.when(take, h["tokens"]).otherwise(F.lit(0))).alias("used"),
        )

    chosen = F.aggregate("_hits", zero, step, lambda acc: acc["out"])
    rows = grouped.select("qid", F.posexplode(chosen).alias("position", "h"))
    return rows.select("qid", (F.col("position") + 1).alias("position"), "h.chunk_id", F.col("h.tokens").alias("token_count"))


def without_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries that found nothing."""
    return queries.join(hits.select("qid").distinct(), "qid", "left_anti")
