"""Predicates, top-k, fusion, rewriting, context, answers and metrics on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer, embed, evaluate, inverted, retrieve
from corpusloom.plans import search
from corpusloom.session import configure


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)


def test_access(spark):
    rows = [
        ([], [], "u", None, [], True), (None, None, None, None, None, True), (["u"], [], "u", None, [], True), (["a@x.org"], [], "z", "A@X.org", [], True), ([], ["hr"], "z", None, ["hr"], True),
        (["u"], ["hr"], "z", "q@x", ["dev"], False), (["A@X.org"], [], "z", "A@X.org", [], False), (["u"], None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "au array<string>, ag array<string>, u string, e string, g array<string>, want boolean")
    assert df.where(retrieve.can_read(*map(F.col, ("au", "ag", "u", "e", "g"))) != F.col("want")).count() == 0
    got = spark.range(1).select(retrieve.principal_groups(F.array(F.lit("hr")), F.lit("admin"), F.lit("o1"), F.lit("A@x"))).first()[0]
    assert got == ["hr", "role:admin", "org:o1", "email:a@x"]


def test_metadata_predicate_is_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 organization_id", "true is_current", "cast(null as string) deleted_at", "'INDEXED' state", "id document_id").write.parquet(f"file://{tmp_path}/d")
    rows = spark.read.parquet(f"file://{tmp_path}/d").where(retrieve.metadata_predicate(1, document_ids=(1, 3)))
    assert sorted(r.document_id for r in rows.collect()) == [1, 3]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "organization_id" in pushed


def test_dense_ties_and_zero_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid int, query_vector array<double>")
    c = spark.createDataFrame([(3, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, vector array<double>")
    got = [(r.qid, r.chunk_id, round(r.score, 6)) for r in retrieve.dense_top_k(q, c, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 3, 1.0), (2, 1, 0.0), (2, 2, 0.0)]


def test_queries_beyond_a_block_give_the_same_pairs(spark, monkeypatch):
    q, c = spark.range(7).withColumnRenamed("id", "qid"), spark.range(5).withColumnRenamed("id", "chunk_id")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieve.paired(q, c).select("qid", "chunk_id").collect())) == [(i, j) for i in range(7) for j in range(5)]


def test_sparse_needs_every_term(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta gamma"), (2, 1, "alpha x x x beta alpha beta"), (3, 2, "alpha alpha")], "chunk_id int, ordinal int, text string")
    q = spark.createDataFrame([(1, "Alpha, beta!"), (2, "  ??"), (3, "delta alpha")], "qid int, query string")
    got = retrieve.sparse_top_k(q, inverted.build(chunks), chunks, 5).orderBy("rank").collect()
    # Shortest stretches of chunk 2: 0-4, 4-5, 5-6.
    assert [(r.qid, r.chunk_id, round(r.score, 6)) for r in got] == [(1, 2, round(1 / 5 + 1 / 2 + 1 / 2, 6)), (1, 1, 0.5)]
    assert sorted(r.qid for r in retrieve.without_hits(q, got and retrieve.sparse_matches(q, inverted.build(chunks))).collect()) == [2, 3]


def test_fusion(spark):
    rows = [(1, 0, 1, "a", {"dense": 0.9}), (1, 0, 2, "b", {"dense": 0.8}), (1, 1, 1, "b", {"sparse": 3.0, "dense": 0.1}), (1, 1, 2, "a", {"sparse": 2.0}), (1, 1, 3, "c", {"sparse": 1.0})]
    got = retrieve.fuse(spark.createDataFrame(rows, "qid int, list_no int, rank int, chunk_id string, scores map<string,double>"), top_k=3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and got[1].scores == {"dense": 0.1, "sparse": 3.0, "rrf": got[1].score}


def test_rewriting(spark):
    asked = ["how to reset my password", "ERROR code 5", "a b", "error Error", "one two three four", "How do I fix, a failing build?"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    got = [r.v for r in df.select("i", retrieve.expand_query(F.col("q")).alias("v")).orderBy("i").collect()]
    assert got[0] == ["how to reset my password", "how to reset my", "to reset my password"]
    assert got[1] == ["ERROR code 5", "ERROR code 5 fix issue solution troubleshoot"]
    assert got[2] == ["a b"] and got[4] == ["one two three four"]
    assert got[5][0] == asked[5] and got[5][1] == "How do I fix" and len(got[5]) == 3
    assert "Section 1:" in df.select(retrieve.hypothetical_document(F.col("q"))).first()[0]


HITS = "qid int, rank int, chunk_id string, parent_chunk_id string, token_count int, text string"


def test_context(spark):
    rows = [(1, 1, "a", "p", 2, ""), (1, 2, "b", "p", 2, ""), (1, 3, "c", None, 3, ""), (2, 1, "d", None, 9, ""), (2, 2, "e", None, 1, ""), (3, 1, "f", None, 4, ""), (3, 2, "g", None, 4, ""), (3, 3, "h", None, None, "x")]
    got = [(r.qid, r.chunk_id, r.token_count) for r in retrieve.select_context(spark.createDataFrame(rows, HITS), 5).orderBy("qid", "position").collect()]
    assert got == [(1, "a", 2), (1, "c", 3), (2, "d", 9), (3, "f", 4), (3, "h", 1)]
    assert retrieve.select_context(spark.createDataFrame(rows, HITS), 0).count() == 7


def test_rerank(spark):
    rows = [(1, "weak", 0.9, 1, "nothing here", {"dense": 0.9}), (1, "strong", 0.1, 2, "annual leave days", {"dense": 0.1}), (1, "tie", 0.95, 3, "other", {"dense": 0.95})]
    hits = spark.createDataFrame(rows, "qid int, chunk_id string, score double, rank int, text string, scores map<string,double>")
    got = retrieve.rerank(hits, retrieve.lexical_overlap(F.lit("annual leave days"), F.col("text")), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("strong", 1.0), ("tie", 0.0)] and got[0].scores == {"dense": 0.1, "reranker": 1.0}
    assert spark.range(1).select(retrieve.lexical_overlap(F.lit("?!"), F.lit("x")), retrieve.inverse_rank(F.lit(4))).first()[:] == (0.0, 0.25)


def test_answers_and_citations(spark):
    questions = spark.createDataFrame([(1, "How many annual leave days?"), (2, "?"), (3, "none")], "qid int, question string")
    context = spark.createDataFrame([(1, 1, "c1", "Policy. Employees receive 22 annual leave days. Other.", 0.5), (2, 1, "c2", "First. Second.", 0.5), (3, 1, "c3", "text", 0.001)], "qid int, position int, chunk_id string, text string, score double")
    got = {r.qid: r for r in answer.extractive_answers(questions, context).collect()}
    assert got[1].answer == "Employees receive 22 annual leave days. [1]" and got[1].used == ["c1"]
    assert got[2].answer == "First. [1]" and got[3].evidence_status == "insufficient" and got[3].answer == answer.INSUFFICIENT
    rows = spark.createDataFrame([(1, 1, "d", "v", "x"), (1, 2, "d", "v", "x"), (1, 3, "d", "v", "y")], "qid int, position int, document_id string, version_id string, chunk_id string")
    assert [(r["index"], r.chunk_id) for r in answer.citations(rows).orderBy("index").collect()] == [(1, "x"), (2, "y")]
    assert spark.range(1).select(answer.token_usage(F.lit("a b"), F.lit("c"))).first()[0] == 3


def test_conversation_query(spark):
    said = [(1, i, r, c) for i, (r, c) in enumerate([("user", "old"), ("user", " a "), ("system", "s"), ("assistant", "b"), ("user", " ")])]
    asked = spark.createDataFrame([(1, "q?"), (2, "alone")], "conv_id int, question string")
    got = answer.conversation_query(spark.createDataFrame(said, "conv_id int, turn int, role string, content string"), asked)
    assert {r.conv_id: r.query for r in got.collect()} == {1: "a b q?", 2: "alone"}


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "d"]), ([], ["x"]), (["a"], []), (["b", "b"], ["b"])], "got array<string>, rel array<string>")
    g, r = F.col("got"), F.col("rel")
    rows = df.select(evaluate.recall_at(g, r, 2), evaluate.precision_at(g, r, 2), evaluate.reciprocal_rank(g, r), evaluate.ndcg_at(g, r, 3), evaluate.precision_at(g, r, 0), evaluate.ndcg_at(g, r, 0)).collect()
    assert rows[0][:3] == (0.5, 0.5, 0.5) and rows[0][3] == pytest.approx(0.38685, abs=1e-5) and rows[0][4:] == (0.0, 0.0)
    assert rows[1][:] == (0.0,) * 6 and rows[2][:] == (0.0,) * 6
    assert rows[3][3] == pytest.approx(1 + 1 / math.log2(3))


def test_answer_metrics(spark):
    def one(make, *values):
        return spark.range(1).select(make(*[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values])).first()[0]

    assert one(evaluate.citation_correctness, ["a", "b", "a"], ["a", "c"]) == 0.5 and one(evaluate.citation_completeness, ["a", "b"], ["a", "c"]) == 0.5
    assert one(evaluate.groundedness, "Employees receive days", ["employees receive days off"]) == 1.0
    assert one(evaluate.groundedness, "a of", ["x"]) == 0.0 and one(evaluate.groundedness, "word", []) == 0.0
    assert one(evaluate.faithfulness, "Cats sleep. Dogs fly high\nIt is.", ["cats sleep all day"]) == pytest.approx(2 / 3)
    assert one(evaluate.answer_relevance, "Leave is 22 days.", "What is annual leave?", "") == 0.5
    assert one(evaluate.answer_relevance, "Leave is 22 days.", "What is annual leave?", "22 days") == pytest.approx(0.4 * 0.5 + 0.6)
    assert one(evaluate.answer_relevance, " ", "q", "") == 0.0


def test_runs_and_series(spark):
    runs = spark.createDataFrame([("r1", "n", "mrr", 0.5), ("r1", "n", "ndcg", 0.7), ("r2", "m", "mrr", 0.1)], "run_id string, name string, metric string, value double")
    assert [tuple(r) for r in evaluate.compare_runs(runs, ["r1", "r9"]).collect()] == [("r1", "n", 0.5, 0.7)]
    seen = spark.createDataFrame([("counter", "c", "", 1.0, 1), ("counter", "c", "", 2.0, 2), ("gauge", "g", "", 9.0, 1), ("gauge", "g", "", 4.0, 2)], "kind string, name string, labels string, value double, at int")
    assert sorted((r.kind, r.n, r.value) for r in evaluate.series(seen).collect()) == [("counter", 2, 3.0), ("gauge", 2, 4.0)]
    assert evaluate.averages(runs.limit(0), ["value"]).first()[0] == 0.0


def test_embeddings_and_ledger(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "t string")
    vectors = [r.v for r in df.select(embed.embed(F.col("t"), embed.deterministic(40), 40).alias("v")).collect()]
    assert vectors[0] == vectors[1] != vectors[2] and all(len(v) == 40 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors)
    with pytest.raises(Exception, match="other vectors"):
        df.select(embed.embed(F.col("t"), lambda texts: [[0.0]] * len(texts), 40)).collect()
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d1")], "chunk_id string, document_id string")
    one, two = embed.ledger_rows(chunks, "p", "m", 1, 40), embed.ledger_rows(chunks, "p", "m", 2, 40)
    assert embed.upsert_ledger(one, two).count() == 4 and embed.upsert_ledger(one, one).count() == 2
    assert one.join(two, "point_id").count() == 0
    assert embed.delete_points(one, chunks.where("chunk_id = 'c1'"), "chunk_id").count() == 1
    with pytest.raises(Exception, match="not of size"):
        embed.check_dimension(df.select(F.array(F.lit(1.0)).alias("vector")), 2).collect()


def corpus(spark):
    texts = {"c1": "Employees receive 22 annual leave days. Ask your manager.", "c2": "The build fails with an error code.", "c3": "Remote work needs approval."}
    df = spark.createDataFrame([(k, None, k[1:], "1", i, None, t) for i, (k, t) in enumerate(texts.items())], "chunk_id string, parent_chunk_id string, document_id string, version_id string, ordinal int, token_count int, text string")
    return df.withColumn("vector", embed.embed(F.col("text"), embed.deterministic(16), 16))


def test_search_modes_and_answers(spark):
    chunks = corpus(spark)
    queries = spark.createDataFrame([("q1", "annual leave days")], "qid string, query string")
    for mode in ("dense", "sparse", "hybrid"):
        for more in ({}, {"expand": True}, {"hyde": True}):
            hits = search.search(queries, chunks, search.SearchConfig(mode=mode, dimension=16, top_k=2, **more)).orderBy("rank").collect()
            assert hits[0].chunk_id == "c1" and hits[0].score == 1.0, (mode, more)
    with pytest.raises(ValueError, match="mode"):
        search.SearchConfig(mode="other")
    asked = spark.createDataFrame([(1, "annual leave days")], "conv_id int, question string")
    none = spark.createDataFrame([], "conv_id int, turn int, role string, content string")
    answers, cited = search.answer_questions(asked, none, chunks, search.SearchConfig(mode="sparse", dimension=16))
    assert answers.first().answer == "Employees receive 22 annual leave days. [1]" and [r.chunk_id for r in cited.collect()] == ["c1"]
    records = spark.createDataFrame([("1", "annual leave days", "22 days", ["1"])], "qid string, question string, expected_answer string, relevant array<string>")
    run = search.evaluate_run(records, chunks, search.SearchConfig(mode="sparse", dimension=16), "s").first()
    assert run.recall_at_k == 1.0 and run.mrr == 1.0 and run.groundedness > 0.4 and run.citation_correctness == 1.0


def test_readable_counts(spark):
    docs = spark.createDataFrame(
        [([], []), (None, None), (["u1"], []), (["a@x.org"], ["g1"]), ([], ["g1", "g2"]), (["u2", "u1"], ["g2"]), ([None], [])], "allowed_users array<string>, allowed_groups array<string>"
    )
    docs = docs.unionByName(docs)
    who = spark.createDataFrame([(1, "u1", "A@X.org", ["g1", "g2"]), (2, "u2", None, None), (3, None, "b@x.org", ["g2"])], "qid int, user_id string, email string, member_of array<string>")
    pairs = who.crossJoin(docs).where(retrieve.can_read(F.col("allowed_users"), F.col("allowed_groups"), F.col("user_id"), F.col("email"), F.col("member_of")))
    want = {r.qid: r.n for r in pairs.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert {r.qid: r.readable for r in retrieve.readable_counts(who, docs).collect()} == want


def test_retrieval_metrics_query_gathers_no_label(spark):
    from corpusloom import registry

    plan = registry.QUERIES["retrieval_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(chunk_id" not in plan


def test_dense_top_k_multiplies_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 5)
    nan = float("nan")
    rows = [(i, [float(i % 3), float(i % 5 - 2), 0.5], f"p{i}") for i in range(30)] + [(30, None, "n"), (31, [nan, 1.0, 0.0], "nan"), (32, [1.0], "short"), (33, [0.0, 0.0, 0.0], "zero"), (34, [1.0, None, 0.0], "hole")]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>, payload string")
    q = spark.createDataFrame([(i, v) for i, v, _ in rows[:9]] + [(90, [2.0]), (91, None)], "qid long, query_vector array<double>")
    # With a condition that always holds every pair is a row, as it was before.
    always = F.col("chunk_id") >= 0
    for k in (3, 40):
        fast, slow = retrieve.dense_top_k(q, c, k, 6), retrieve.dense_top_k(q, c, k, 6, allowed=always)
        got, want = (sorted(map(repr, df.select("qid", "chunk_id", "payload", "score", "rank").collect())) for df in (fast, slow))
        assert got == want and len(got) == 11 * min(k, 35)
    assert "PythonUDF" not in fast._jdf.queryExecution().optimizedPlan().toString() and "FlatMapCoGroupsInArrow" in fast._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_numbers(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 6)
    held = [*range(0, 90, 7), 14, -5, 2**40]
    got = retrieve.nearest_numbers(spark.createDataFrame([(i,) for i in (0, 10, 50, 2**40)], "qid long"), spark.createDataFrame([(i,) for i in held], "chunk_id long"), 4)
    want = {q: sorted((abs(q - i), i) for i in held)[:4] for q in (0, 10, 50, 2**40)}
    assert {(r.qid, r.rank): (r.score, r.chunk_id) for r in got.collect()} == {(q, n + 1): x for q, xs in want.items() for n, x in enumerate(xs)}


def test_an_experiment_indexes_its_chunks_once(spark, monkeypatch):
    made, build = [], inverted.build
    monkeypatch.setattr(search.inverted, "build", lambda *a, **k: made.append(1) or build(*a, **k))
    texts = ["alpha beta gamma", "beta gamma delta", "delta alpha beta"]
    rows = [(str(i), str(i), str(i), "1", i, 3, t, [float(i), 1.0]) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, parent_chunk_id string, document_id string, version_id string, ordinal int, token_count int, text string, vector array<double>")
    records = spark.createDataFrame([("q", "alpha beta", "alpha beta", ["0"])], "qid string, question string, expected_answer string, relevant array<string>")
    assert search.experiment(records, chunks, search.SearchConfig(dimension=2)).count() == 3
    assert len(made) == 1
