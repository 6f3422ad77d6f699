"""The stored inverted index and the stored vector index against brute force."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import inverted, retrieve, vector_index
from corpusloom.plans import search
from corpusloom.registry import QUERIES as QUERIES_OF_TABLES
from corpusloom.session import configure


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)


# --- inverted index --------------------------------------------------------------------


def tokens(text):
    return [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", text or "")]


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Ünïcode w1_x W1 w1"), (n + 3, "w1 " * 400)]


QUERIES = [(1, "w1 w2"), (2, "W5, w59!"), (3, "w0 w1 w2 w3 w4 w5 w6"), (4, "nothing here"), (5, ""), (6, None), (7, "w1 w1 w1"), (8, "w40 w50 w0")]


def bm25(rows, query, k, permitted=None):
    docs = {i: tokens(t) for i, t in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    asked = set(tokens(query))
    df = {t: sum(t in d for d in docs.values()) for t in asked}
    out = []
    for i, d in docs.items():
        if asked & set(d) and (permitted is None or i in permitted):
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in asked if t in d)
            out.append((-round(s, 6), i))
    return [(i, -s, r + 1) for r, (s, i) in enumerate(sorted(out)[:k])]


@pytest.fixture(scope="module", params=[(1 << 15, 1 << 22, 128), (40, 1 << 22, 4), (1 << 15, 300, 1)])
def built(spark, request):
    docs, postings, block = request.param
    rows = corpus(3)
    before = inverted.SHARD_DOCS, inverted.SHARD_POSTINGS, inverted.BLOCK
    # The limits are read in the workers, so the pieces are made here.
    make = inverted._make_shards

    def small(batches):
        inverted.SHARD_DOCS, inverted.SHARD_POSTINGS, inverted.BLOCK = docs, postings, block
        try:
            yield from make(batches)
        finally:
            inverted.SHARD_DOCS, inverted.SHARD_POSTINGS, inverted.BLOCK = before

    inverted._make_shards = small
    index = inverted.build(spark.createDataFrame(rows, "chunk_id long, text string").repartition(3))
    inverted._make_shards = make
    return rows, index


def test_bm25_with_pruning_matches_brute_force(spark, built):
    rows, index = built
    asked = spark.createDataFrame(QUERIES, "qid int, query string")
    for k in (3, 10, 1000):
        got = {}
        for r in retrieve.bm25_top_k(asked, index, k, 6).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.chunk_id, r.score, r.rank))
        assert got == {q: bm25(rows, t, k) for q, t in QUERIES if bm25(rows, t, k)}


def test_conjunctions_match_brute_force(spark, built):
    rows, index = built
    got = sorted(map(tuple, inverted.matches(spark.createDataFrame(QUERIES, "qid int, query string"), index).collect()))
    want = [(q, i, sum(tokens(t).count(x) for x in set(tokens(query)))) for q, query in QUERIES for i, t in rows if tokens(query) and set(tokens(query)) <= set(tokens(t))]
    assert got == sorted(want)


def test_overlaps_match_brute_force(spark, built):
    rows, index = built
    asked = spark.createDataFrame(QUERIES, "qid int, query string")
    hits = retrieve.ranked(inverted.overlap(asked, index, 7), 7, F.desc("score"), F.col("chunk_id"))
    got = sorted((r.qid, r.rank, r.chunk_id, r.score) for r in hits.collect())
    want = []
    for q, query in QUERIES:
        counts = sorted((-len(set(tokens(query)) & set(tokens(t))), i) for i, t in rows)
        want += [(q, r + 1, i, -float(c) * -1 * -1) for r, (c, i) in enumerate([x for x in counts if x[0] < 0][:7])]
    assert got == sorted((q, r, i, abs(s)) for q, r, i, s in want)


def test_pruning_leaves_postings_out(spark):
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i < 4 else "") + f"w{i}") for i in range(3000)]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1))
    hits = inverted.bm25(spark.createDataFrame([(1, "rare common")], "qid int, query string"), index, 3).collect()
    assert {r.chunk_id for r in hits} <= {0, 1, 2, 3} and len(hits) == 3
    # With "common" alone, blocks under the third best score are left out.
    read = inverted.bm25(spark.createDataFrame([(1, "common")], "qid int, query string"), index, 3).first().read
    assert read == 3000 or read < 3000


def test_a_block_under_the_best_scores_is_not_read():
    block = lambda bound, at: (bound, np.arange(at, at + 10), lambda part: np.full(10, bound)[part])
    scores, read = inverted.best_of_shard([[block(9.0, 0)], [block(3.0, 5), block(1.0, 40)], [block(0.5, 60)]], 100, 5, None)
    assert read == 20 + 10 + 10 and sorted(np.argsort(-scores)[:5].tolist()) == [5, 6, 7, 8, 9]
    assert scores[40] == 0 and scores[60] == 0


def test_documents_are_not_shuffled_when_an_index_is_built(spark):
    chunks = spark.createDataFrame(corpus(1), "chunk_id long, text string")
    rows = chunks.select("chunk_id", F.col("text").cast("binary").alias("text")).mapInPandas(inverted._make_shards, inverted.ROWS + "bigint")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_index_of_strings_and_of_nothing(spark):
    index = inverted.build(spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "chunk_id string, text string").coalesce(1))
    asked = spark.createDataFrame([("q", "x")], "qid string, query string")
    assert [r.chunk_id for r in retrieve.bm25_top_k(asked, index, 5).orderBy("rank").collect()] == [None, "a", "b"]
    none = inverted.build(spark.createDataFrame([], "chunk_id string, text string"))
    assert retrieve.bm25_top_k(asked, none, 5).count() == 0 and inverted.matches(asked, none).count() == 0


# --- access before top-k -----------------------------------------------------------------

ACL = "chunk_id long, text string, allowed_users array<string>, allowed_groups array<string>"
LISTS = [([], []), (None, None), (["u1"], []), ([], ["hr", "dev"]), (["u2"], ["hr"]), (["x@y.org"], None), ([None], []), ([], ["dev", None])]
PEOPLE = [(1, "u1", "a@b.org", ["dev"]), (2, "u2", "X@Y.org", []), (3, "u3", None, None), (7, "u9", "q@q", ["hr"])]


def may_read(users, groups, who):
    _, user, email, member = who
    users, groups = users or [], groups or []
    return (not users and not groups) or user in users or (email or "").lower() in users or bool({g for g in groups if g} & set(member or []))


@pytest.mark.parametrize("shard", [1 << 15, 16])
def test_searches_as_principals_match_brute_force(spark, shard):
    rows = [(i, t, *LISTS[i % len(LISTS)]) for i, t in corpus(5, 90)]
    docs = spark.createDataFrame(rows, ACL).repartition(2)
    index = inverted.build(docs.select("chunk_id", "text"))
    who = spark.createDataFrame(PEOPLE, "qid int, user_id string, email string, member_of array<string>")
    allowed = retrieve.readable_bitmaps(who, docs, index)
    asked = spark.createDataFrame(QUERIES, "qid int, query string")
    got = {}
    for r in retrieve.bm25_top_k(asked, index, 5, 6, allowed).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score, r.rank))
    want = {p[0]: bm25([r[:2] for r in rows], dict(QUERIES)[p[0]], 5, {r[0] for r in rows if may_read(r[2], r[3], p)}) for p in PEOPLE}
    assert got == {q: hits for q, hits in want.items() if hits}
    matched = {(r.qid, r.chunk_id) for r in inverted.matches(asked, index, allowed).collect()}
    holds = lambda q, t: tokens(dict(QUERIES)[q]) and set(tokens(dict(QUERIES)[q])) <= set(tokens(t))
    assert matched == {(p[0], r[0]) for p in PEOPLE for r in rows if may_read(r[2], r[3], p) and holds(p[0], r[1])}
    counts = {r.qid: r.readable for r in retrieve.readable_counts(who, docs).collect()}
    assert counts == {p[0]: sum(may_read(r[2], r[3], p) for r in rows) for p in PEOPLE}


def test_hybrid_search_shows_principals_only_what_they_may_read(spark):
    rows = [(str(i), t, *LISTS[i % len(LISTS)], i, [math.sin(i), math.cos(i), 0.5]) for i, t in corpus(6, 60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, allowed_users array<string>, allowed_groups array<string>, ordinal int, vector array<double>")
    who = spark.createDataFrame([(str(p[0]), *p[1:]) for p in PEOPLE], "qid string, user_id string, email string, member_of array<string>")
    asked = spark.createDataFrame([(str(q), t) for q, t in QUERIES], "qid string, query string")
    config = search.SearchConfig(dimension=3, rerank=False, top_k=8)
    hits = search.candidates(asked, chunks, config, principals=who).collect()
    lists, people = {r[0]: r[2:4] for r in rows}, {str(p[0]): p for p in PEOPLE}
    assert {r.qid for r in hits} == set(people)
    assert all(may_read(*lists[r.chunk_id], people[r.qid]) for r in hits)
    # Filtered before top-k: every principal gets as many hits as were asked for.
    assert all(sum(r.qid == q for r in hits) == 8 for q in people)


# --- vector index --------------------------------------------------------------------------


def clustered(n=3000, dim=18, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    x[5] = 0
    x[6:30] = x[6]
    return x.astype(np.float32)


def points(spark, x):
    rows = [(i, v.tolist(), f"o{i % 3}", i % 7) for i, v in enumerate(x)] + [(90_000, None, "o1", 1)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>, organization_id string, lang int").repartition(4)


def best(x, q, k, keep=lambda i: True, digits=6):
    u = x.astype(np.float64)
    u /= np.where(np.linalg.norm(u, axis=1, keepdims=True) > 0, np.linalg.norm(u, axis=1, keepdims=True), 1)
    score = np.round(u @ u[q], digits) + 0.0
    order = sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (-score[i], i))[:k]
    return [(i, score[i]) for i in order]


@pytest.fixture(scope="module")
def indexed(spark):
    x = clustered()
    return x, vector_index.build(points(spark, x), partition_by=["organization_id"], cluster_by=["lang"])


def asked(spark, x, ids):
    return spark.createDataFrame([(i, x[i].tolist()) for i in ids], "qid long, query_vector array<float>")


def found(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.chunk_id, r.score))
    return out


def test_recall_of_the_vector_index(spark, indexed):
    x, index = indexed
    ids = list(range(0, 3000, 50))
    got = found(vector_index.search(asked(spark, x, ids), index, 10, digits=6))
    share = np.mean([len({i for i, _ in got[q]} & {i for i, _ in best(x, q, 10)}) / 10 for q in ids])
    assert share >= 0.9 and len(index.codec.centres) > 10


def test_exact_search_through_the_vector_index(spark, indexed):
    x, index = indexed
    ids = [5, 6, 7, *range(11, 3000, 211)]
    got = found(vector_index.search(asked(spark, x, ids), index, 10, exact=True, probes=1, digits=6))
    assert got == {q: best(x, q, 10) for q in ids}


def test_payload_filter_before_top_k(spark, indexed):
    x, index = indexed
    where = (F.col("organization_id") == "o1") & (F.col("lang") == 3)
    got = found(vector_index.search(asked(spark, x, [1, 6, 40]), index, 5, where=where, exact=True, digits=6))
    assert got == {q: best(x, q, 5, lambda i: i % 3 == 1 and i % 7 == 3) for q in (1, 6, 40)}


def test_filters_prune_partitions_and_row_groups(spark, indexed):
    _, index = indexed
    rows = index.rows.where((F.col("organization_id") == "o1") & F.col("cell").isin(1, 2) & (F.col("lang") == 3)).select("chunk_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    partition, pushed = plan.split("PartitionFilters: [")[1].split("PushedFilters: [")[:2]
    assert "organization_id" in partition and "cell" in partition and "EqualTo(lang,3)" in pushed
    files = {f for f in index.rows.inputFiles() if "organization_id=o1/" in f and ("cell=1/" in f or "cell=2/" in f)}
    read = {r[0].replace("file:///", "/") for r in rows.select(F.input_file_name()).distinct().collect()}
    assert read <= {f.replace("file:///", "/") for f in files} and len(files) < len(index.rows.inputFiles()) / 10


def test_more_hits_than_rows_and_blocks(spark, monkeypatch):
    x = clustered(40)
    index = vector_index.build(points(spark, x), cells=3)
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 7)
    got = found(vector_index.search(asked(spark, x, [1, 5]), index, 100, exact=True, digits=6))
    assert got == {q: best(x, q, 100) for q in (1, 5)}


def test_vectors_of_another_size_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "chunk_id long, vector array<float>")
    with pytest.raises(Exception, match="not of size"):
        vector_index.build(rows, cells=1)
    with pytest.raises(ValueError, match="at least one vector"):
        vector_index.build(rows.limit(0), cells=1)


def test_holders_of_passages(spark):
    texts = ["the quick brown fox jumps", "sthe quick brown foxes", "The quick brown fox", "quick fox brown the", "x", "", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    passages = [(1, "the quick brown fox"), (2, "x"), (3, "brown fox"), (4, "Ünlike any"), (5, None)]
    got = sorted(map(tuple, search.holders(spark.createDataFrame(passages, "qid long, passage string"), chunks).collect()))
    assert got == sorted((q, i) for q, p in passages if p is not None for i, t in enumerate(texts) if t is not None and p in t)


def test_recall_on_the_embeddings_table(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(f"{path}/embeddings.parquet"):
        pytest.skip("no tables")
    got, want = ({q: {i for i, _ in hits} for q, hits in found(QUERIES_OF_TABLES[name](spark, path)).items()} for name in ("indexed_top_k", "dense_top_k"))
    assert np.mean([len(got[q] & want[q]) / len(want[q]) for q in want]) >= 0.9


def test_exact_search_sends_on_no_more_than_the_best_of_a_group(spark):
    # Vectors that lie evenly: every row may reach the k-th best by its code.
    x = np.random.default_rng(1).normal(size=(600, 16)).astype(np.float32)
    index = vector_index.build(points(spark, x), cells=9)
    hits = vector_index.search(asked(spark, x, range(0, 600, 20)), index, 10, exact=True, digits=6)
    assert found(hits) == {q: best(x, q, 10) for q in range(0, 600, 20)}
    groups = vector_index._groups(index)
    assert groups.n == 1 and index.codec.probes > math.ceil(vector_index.PROBE_SHARE * 9)


def test_groups_of_cells(spark, monkeypatch):
    x = clustered(300)
    index = vector_index.build(points(spark, x), cells=8)
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 30)
    counts = {r.cell: r.n for r in index.cells.collect()}
    groups = vector_index._groups(index)
    held = {}
    for cell, n in counts.items():
        assert groups.spread[cell] == -(-n // 30)
        held.setdefault(groups.first[cell], []).append(n)
    assert all(len(ns) == 1 or sum(ns) <= 30 for ns in held.values())
    assert found(vector_index.search(asked(spark, x, [1, 6, 9]), index, 7, exact=True, digits=6)) == {q: best(x, q, 7) for q in (1, 6, 9)}


def test_tiles_grow_with_the_queries_and_groups_up_to_a_bound():
    # 6 times the rows and queries: a row is sent 4 times instead of 16, a query to 11 tiles instead of 31.
    assert vector_index._tiling(6, 5129) == (1, 3)
    assert vector_index._tiling(31, 30770) == (3, 4)
    assert vector_index._tiling(3000, 3_000_000) == (vector_index.MOST_GROUPS, 375)
    assert vector_index._tiling(1, 0) == (1, 1)


def test_tiles_find_what_single_groups_find(spark, monkeypatch):
    x = clustered(900)
    index = vector_index.build(points(spark, x), cells=20)
    ids = list(range(0, 900, 7))
    got = {}
    for name, settings in {"single": (1, 1000, 1000), "tiles": (4, 10, 40)}.items():
        for setting, value in zip(("MOST_GROUPS", "QUERY_BLOCK", "MOST_QUERIES"), settings, strict=True):
            monkeypatch.setattr(vector_index, setting, value)
        monkeypatch.setattr(vector_index, "ROW_BLOCK", 60)
        groups = vector_index._groups(index).n
        got[name] = vector_index._tiling(groups, len(ids)), found(vector_index.search(asked(spark, x, ids), index, 4, probes=6, shortlist=3, digits=6))
        assert found(vector_index.search(asked(spark, x, ids), index, 4, exact=True, probes=2, digits=6)) == {q: best(x, q, 4) for q in ids}
    assert got["single"][0][0] == 1 and got["tiles"][0][0] > 1 and got["tiles"][0][1] > 1
    assert got["single"][1] == got["tiles"][1]


def test_copies_in_a_group_and_a_query_that_is_no_number(spark):
    # 300 rows alike are more than a shortlist holds.
    x = clustered(700)
    x[100:400] = x[100]
    index = vector_index.build(points(spark, x), cells=6)
    ids = [3, 100, 250, 650]
    queries = asked(spark, x, ids).unionByName(spark.createDataFrame([(-1, [float("nan")] * 18)], "qid long, query_vector array<float>"))
    for exact in (True, False):
        assert found(vector_index.search(queries, index, 10, probes=6, exact=exact, digits=6)) == {q: best(x, q, 10) for q in ids}


def test_a_shard_holds_a_term_once_and_eight_bytes_a_posting():
    shard = inverted._Shard()
    for i in range(50):
        shard.add(i, b"alpha Beta alpha " * i + b"w%d" % i)
    assert shard.postings == 49 * 2 + 50 and len(shard.ids) == 52
    assert sum(t.nbytes + n.nbytes for _, t, n in shard.docs) == 8 * shard.postings
    rows = next(iter(inverted._shard_rows(0, shard)))
    assert rows[(rows["kind"] == "block") & (rows["term"] == "alpha")]["n"].sum() == 49


def test_a_shard_is_written_in_few_bytes_a_posting():
    """What a shard needs beside its postings while it is put in order: less than 30 bytes a posting, blocks included."""
    import tracemalloc

    words = np.array([f"w{i}" for i in range(20000)])
    shard = inverted._Shard()
    for i, at in enumerate(np.random.default_rng(1).zipf(1.3, size=(10000, 250)) % len(words)):
        shard.add(i, " ".join(words[at]).encode())
    tracemalloc.start()
    try:
        rows = sum(int(f["n"].fillna(0).sum()) for f in inverted._shard_rows(0, shard))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == shard.postings and peak < 30 * shard.postings
