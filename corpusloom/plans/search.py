"""Search from query text to context and answers, for batches of queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import query_tokens
from corpusloom.operators import answer, embed, evaluate, inverted, retrieve
from corpusloom.operators.inverted import Index
from corpusloom.session import stored


@dataclass(frozen=True)
class SearchConfig:
    """mode: dense, sparse or hybrid. candidate_k counts only with a reranker, as does its cut to top_k."""

    mode: str = "hybrid"
    top_k: int = 10
    candidate_k: int = 50
    rerank: bool = True
    expand: bool = False
    hyde: bool = False
    hyde_sparse: bool = False
    budget: int = retrieve.CONTEXT_BUDGET
    dimension: int = 128

    def __post_init__(self):
        if self.mode not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown mode {self.mode!r}")


def variants(queries: DataFrame, config: SearchConfig) -> DataFrame:
    """qid, list_no, query, sparse_query: the texts that are run for each query."""
    asked = retrieve.hypothetical_document(F.col("query")) if config.hyde else F.col("query")
    texts = retrieve.expand_query(asked) if config.expand else F.array(asked)
    rows = queries.select("qid", F.col("query").alias("_own"), F.posexplode(texts).alias("list_no", "query"))
    return rows.withColumn("sparse_query", F.col("query") if config.hyde_sparse or not config.hyde else F.col("_own")).drop("_own")


def candidates(queries: DataFrame, chunks: DataFrame, config: SearchConfig, index: Index | None = None, principals: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, rank, score, scores: fused over legs, then over variants.

    chunks: chunk_id, ordinal, text, vector; already narrowed by what holds for all
    askers. principals (qid, user_id, email, member_of) narrow each query to what its
    asker may read, by allowed_users and allowed_groups of the chunks and before
    top-k; queries without a principal find nothing then.
    """
    k = config.candidate_k if config.rerank else config.top_k
    runs = variants(queries, config).withColumn("run", F.concat_ws("#", "qid", "list_no"))
    legs = []
    if principals is not None:
        askers = runs.select("run", "qid").join(principals.select("qid", "user_id", "email", "member_of"), "qid").drop("qid").withColumnRenamed("run", "qid")
    if config.mode != "sparse":
        vector = embed.embed(F.col("query"), embed.deterministic(config.dimension), config.dimension)
        asked, may, lists = runs.select(F.col("run").alias("qid"), vector.alias("query_vector")), None, []
        if principals is not None:
            lists = ["allowed_users", "allowed_groups"]
            asked = asked.join(askers, "qid")
            may = retrieve.can_read(*map(F.col, ("allowed_users", "allowed_groups", "user_id", "email", "member_of")))
        legs.append(retrieve.dense_top_k(asked, chunks.select("chunk_id", "vector", *lists), k, allowed=may).select("qid", "chunk_id", "rank", "score", F.lit("dense").alias("leg"), F.lit(0).alias("list_no")))
    if config.mode != "dense":
        asked = runs.select(F.col("run").alias("qid"), F.col("sparse_query").alias("query"))
        index = index if index is not None else inverted.build(chunks.select("chunk_id", "text"))
        allowed = None if principals is None else retrieve.readable_bitmaps(askers, chunks.select("chunk_id", "allowed_users", "allowed_groups"), index)
        hits = retrieve.sparse_top_k(asked, index, chunks.select("chunk_id", "ordinal", "text"), k, allowed=allowed)
        legs.append(hits.select("qid", "chunk_id", "rank", "score", F.lit("sparse").alias("leg"), F.lit(1).alias("list_no")))
    scores = F.create_map(F.col("leg"), F.col("score"))
    if len(legs) == 1:
        hits = legs[0].select("qid", "chunk_id", "rank", "score", scores.alias("scores"))
    else:
        hits = retrieve.fuse(legs[0].unionByName(legs[1]).select("qid", "list_no", "rank", "chunk_id", scores.alias("scores")), top_k=k)
    own = hits.select(F.split("qid", "#")[0].alias("qid"), F.split("qid", "#")[1].cast("int").alias("list_no"), "chunk_id", "rank", "score", "scores")
    return retrieve.fuse(own, top_k=k) if config.expand else own.drop("list_no")


def search(queries: DataFrame, chunks: DataFrame, config: SearchConfig, index: Index | None = None, principals: DataFrame | None = None) -> DataFrame:
    """Hits with text, parent and size of their chunks, reranked if asked for. queries: qid string, query."""
    hits = candidates(queries, chunks, config, index, principals).join(chunks.drop("vector"), "chunk_id").join(queries, "qid")
    if config.rerank:
        return retrieve.rerank(hits, retrieve.lexical_overlap(F.col("query"), F.col("text")), config.top_k)
    return hits.where(F.col("rank") <= config.top_k)


def search_with_context(queries: DataFrame, chunks: DataFrame, config: SearchConfig, index: Index | None = None, principals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    hits = search(queries, chunks, config, index, principals)
    return hits, retrieve.select_context(hits, config.budget)


def search_debug(queries: DataFrame, chunks: DataFrame, config: SearchConfig) -> dict[str, DataFrame]:
    """The hits of every stage, each worked out and stored, and `latency`: stage, seconds of it."""
    import time
    from dataclasses import replace

    hits = lambda: search(queries, chunks, config)
    stages = {mode: lambda m=mode: candidates(queries, chunks, replace(config, mode=m)) for mode in ("dense", "sparse", "hybrid")}
    found, spent = {}, []
    for name, run in (*stages.items(), ("hits", hits), ("context", lambda: retrieve.select_context(found["hits"], config.budget))):
        began = time.perf_counter()
        found["fused" if name == "hybrid" else name] = stored(run(), f"debug-{name}")
        spent.append(("fused" if name == "hybrid" else name, time.perf_counter() - began))
    return {**found, "latency": queries.sparkSession.createDataFrame(spent, "stage string, seconds double")}


def answer_questions(questions: DataFrame, messages: DataFrame, chunks: DataFrame, config: SearchConfig) -> tuple[DataFrame, DataFrame]:
    """Answers and citations. questions: conv_id, question; messages: conv_id, turn, role, content."""
    asked = answer.conversation_query(messages, questions).select(F.col("conv_id").cast("string").alias("qid"), "query")
    hits = stored(search(asked, chunks, config), "hits")
    context = retrieve.select_context(hits, config.budget)
    full = context.join(hits.select("qid", "chunk_id", "text", "score", "document_id", "version_id"), ["qid", "chunk_id"])
    answers = answer.extractive_answers(questions.select(F.col("conv_id").cast("string").alias("qid"), "question"), full)
    used = answers.select("qid", F.posexplode("used").alias("position", "chunk_id"))
    return answers, answer.citations(used.join(full.drop("position"), ["qid", "chunk_id"]))


def holders(passages: DataFrame, chunks: DataFrame, index: Index | None = None) -> DataFrame:
    """qid, chunk_id of the chunks whose text contains the passage. passages: qid, passage; chunks: chunk_id, text.

    A text that holds a passage holds all its words but the first and the last
    whole, so chunks with all of those are looked at; passages of fewer than three
    words meet every chunk.
    """
    words = query_tokens(F.coalesce("passage", F.lit("")))
    inner = passages.withColumn("query", F.array_join(F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)), " "))
    index = index if index is not None else inverted.build(chunks.select("chunk_id", "text"))
    near = inverted.matches(inner.where(F.col("query").isNotNull()).select("qid", "query"), index).select("qid", "chunk_id")
    near = near.join(passages, "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
    short = retrieve.paired(inner.where(F.col("query").isNull()).drop("query"), chunks.select("chunk_id", "text"))
    return near.select("qid", "chunk_id", "passage", "text").unionByName(short.select("qid", "chunk_id", "passage", "text")).where(F.contains("text", "passage")).select("qid", "chunk_id")


def evaluate_run(records: DataFrame, chunks: DataFrame, config: SearchConfig, name: str, index: Index | None = None) -> DataFrame:
    """One row of mean metrics over records (qid, question, expected_answer, relevant)."""
    asked = records.select("qid", F.col("question").alias("query"))
    # Metrics read the hits and the context several times; both are at most top_k rows a question.
    hits = stored(search(asked, chunks, config, index), "hits")
    context = stored(retrieve.select_context(hits, config.budget), "context")
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("_h"))
    full = context.join(hits.select("qid", "chunk_id", "text", "score", "document_id", "version_id"), ["qid", "chunk_id"])
    texts = full.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda c: c["text"]).alias("contexts"))
    answers = answer.extractive_answers(records.select("qid", "question"), full)
    used = answers.select("qid", F.explode("used").alias("chunk_id")).join(full.select("qid", "chunk_id", "document_id"), ["qid", "chunk_id"])
    cited = used.groupBy("qid").agg(F.collect_set("document_id").alias("cited"))
    rows = records.join(found, "qid", "left").join(texts, "qid", "left").join(answers, "qid", "left").join(cited, "qid", "left")
    empty = F.array().cast("array<string>")
    got = F.coalesce(F.transform("_h", lambda h: h["document_id"]), empty)
    rel, ctx, cit = F.coalesce("relevant", empty), F.coalesce("contexts", empty), F.coalesce("cited", empty)
    metrics = {
        "recall_at_k": evaluate.recall_at(got, rel, config.top_k), "precision_at_k": evaluate.precision_at(got, rel, config.top_k),
        "mrr": evaluate.reciprocal_rank(got, rel), "ndcg_at_k": evaluate.ndcg_at(got, rel, config.top_k),
        "groundedness": evaluate.groundedness(F.col("answer"), ctx), "faithfulness": evaluate.faithfulness(F.col("answer"), ctx),
        "answer_relevance": evaluate.answer_relevance(F.col("answer"), F.col("question"), F.col("expected_answer")),
        "citation_correctness": evaluate.citation_correctness(cit, rel), "citation_completeness": evaluate.citation_completeness(cit, rel),
    }
    scored = rows.select("qid", *[v.alias(k) for k, v in metrics.items()])
    return evaluate.averages(scored, list(metrics)).select(F.lit(name).alias("name"), *metrics)


def experiment(records: DataFrame, chunks: DataFrame, base: SearchConfig) -> DataFrame:
    """dense, hybrid, and hybrid with reranking, a row each."""
    from dataclasses import replace

    grid = {"dense": replace(base, mode="dense", rerank=False), "hybrid": replace(base, mode="hybrid", rerank=False), "hybrid_rerank": replace(base, mode="hybrid", rerank=True)}
    # Chunks are indexed once for all runs.
    index = inverted.build(chunks.select("chunk_id", "text"))
    rows = [evaluate_run(records, chunks, c, n, index) for n, c in grid.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
