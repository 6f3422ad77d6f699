"""Retrieval and answer metrics as columns, and runs over data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import once, trim, ws_tokens

# Words that answer metrics leave out.
CLAIM_STOPWORDS = ("the", "a", "an", "in", "on", "of", "to", "is", "are", "and", "or", "for", "with", "that", "this", "it", "by", "as", "at", "be")
QUESTION_STOPWORDS = ("what", "how", "why", "who", "where", "when", "is", "are", "the", "a", "an", "in", "of", "to", "for", "do", "does")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def marks(retrieved: Column, relevant: Column) -> Column:
    """For each retrieved id whether it is relevant."""
    return F.transform(retrieved, lambda d: F.coalesce(F.array_contains(relevant, d), F.lit(False)))


def _first_marks(retrieved: Column, relevant: Column) -> Column:
    """Marks, of a repeated id the first only."""
    return F.transform(retrieved, lambda d, i: F.coalesce(F.array_contains(relevant, d) & (F.array_position(retrieved, d) == i + 1), F.lit(False)))


def _hits(marks: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(marks, 1, max(k, 0)), lambda m: m))


def recall_of(marks: Column, n_relevant: Column, k: int) -> Column:
    """Share of the n_relevant ids among the first k. marks: array<boolean> in rank order, as for the metrics below."""
    return _share(_hits(marks, k), n_relevant)


def precision_of(marks: Column, k: int) -> Column:
    return _hits(marks, k) / F.lit(k) if k > 0 else F.lit(0.0)


def reciprocal_rank_of(marks: Column) -> Column:
    return F.coalesce(F.lit(1.0) / F.nullif(F.array_position(marks, True), F.lit(0)), F.lit(0.0))


def ndcg_of(marks: Column, n_relevant: Column, k: int) -> Column:
    """Binary gains over those of as many relevant ids at the top."""
    k = max(k, 0)
    gain = lambda i: F.lit(1.0) / F.log2(i + F.lit(2.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    got = total(F.transform(F.slice(marks, 1, k), lambda m, i: F.when(m, gain(i)).otherwise(F.lit(0.0))))
    best = F.least(n_relevant, F.lit(k)).cast("int")
    return _share(got, total(F.transform(F.when(best > 0, F.sequence(F.lit(0), best - 1)).otherwise(F.array().cast("array<int>")), gain)))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return recall_of(_first_marks(retrieved, relevant), F.size(F.array_distinct(relevant)), k)


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return precision_of(_first_marks(retrieved, relevant), k)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    return reciprocal_rank_of(marks(retrieved, relevant))


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary gains; repeated ids each count."""
    return ndcg_of(marks(retrieved, relevant), F.size(F.array_distinct(relevant)), k)


def citation_correctness(cited: Column, relevant: Column) -> Column:
    return _share(F.size(F.array_intersect(cited, relevant)), F.size(F.array_distinct(cited)))


def citation_completeness(cited: Column, relevant: Column) -> Column:
    return _share(F.size(F.array_intersect(cited, relevant)), F.size(F.array_distinct(relevant)))


def _true(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _usable(*texts: Column) -> Column:
    good = F.lit(True)
    for t in texts:
        good = good & (trim(F.coalesce(t, F.lit(""))) != "")
    return good


def groundedness(answer: Column, contexts: Column) -> Column:
    """Half the share of the answer's words, of three letters or more, among the contexts' words; half that of its word pairs."""

    def rate(c: Column) -> Column:
        blob, known, terms = c["blob"], c["known"], c["terms"]
        n = F.size(terms)
        single = _true(terms, lambda t: F.array_contains(known, t)) / n
        pairs = F.zip_with(F.slice(terms, F.lit(1), n - 1), F.slice(terms, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        score = F.when(n > 1, 0.5 * single + 0.5 * _true(pairs, lambda p: F.contains(blob, p)) / (n - 1)).otherwise(single)
        return F.when(n > 0, score).otherwise(F.lit(0.0))

    # Words are cut once for a row, not for every word that is looked up.
    words = lambda blob: F.struct(blob.alias("blob"), F.array_distinct(ws_tokens(blob)).alias("known"), F.filter(ws_tokens(F.lower(answer)), lambda t: F.length(t) > 2).alias("terms"))
    found = once(once(F.lower(F.array_join(contexts, " ")), words), rate)
    return F.when(_usable(answer) & (F.size(contexts) > 0), F.coalesce(found, F.lit(0.0))).otherwise(F.lit(0.0))


def _strip(word: Column, marks: str) -> Column:
    return F.btrim(word, F.lit(marks))


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's sentences of which half the content words occur in the contexts."""
    sentences = F.filter(F.transform(F.split(F.replace(answer, F.lit("\n"), F.lit(". ")), r"\."), trim), lambda s: s != "")
    content = lambda s: F.filter(
        F.transform(ws_tokens(s), lambda w: _strip(F.lower(w), ".,!?;:")), lambda w: ~w.isin(*CLAIM_STOPWORDS) & (F.length(w) > 2)
    )
    holds = lambda ws, blob: (F.size(ws) == 0) | (_true(ws, lambda w: F.contains(blob, w)) * 2 >= F.size(ws))
    parts = F.struct(F.lower(F.array_join(contexts, " ")).alias("blob"), F.transform(sentences, content).alias("claims"))
    share = once(parts, lambda c: F.when(F.size(c["claims"]) > 0, _true(c["claims"], lambda ws: holds(ws, c["blob"])) / F.size(c["claims"])))
    return F.when(_usable(answer) & (F.size(contexts) > 0), F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0))


def answer_relevance(answer: Column, question: Column, expected: Column) -> Column:
    """Coverage of the question's keywords, blended with the overlap with an expected answer if there is one."""
    words = lambda text, marks: F.array_distinct(
        F.transform(F.filter(ws_tokens(text), lambda w: ~F.lower(w).isin(*QUESTION_STOPWORDS)), lambda w: _strip(F.lower(w), marks))
    )

    def rate(c: Column) -> Column:
        covered = F.when(F.size(c["asked"]) > 0, _true(c["asked"], lambda w: F.contains(c["text"], w)) / F.size(c["asked"])).otherwise(F.lit(1.0))
        blended = 0.4 * covered + 0.6 * F.size(F.array_intersect(c["said"], c["wanted"])) / F.size(c["wanted"])
        return F.when(_usable(expected) & (F.size(c["wanted"]) > 0), blended).otherwise(covered)

    parts = F.struct(
        F.lower(answer).alias("text"), words(question, "?,!.").alias("asked"), words(answer, ".,!?:").alias("said"),
        words(F.coalesce(expected, F.lit("")), ".,!?:").alias("wanted"),
    )
    return F.when(_usable(answer, question), once(parts, rate)).otherwise(F.lit(0.0))


def averages(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unweighted means; 0 where there is no value."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def compare_runs(runs: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """runs (run_id, name, metric, value): one row per run, of the wanted ones if named, and a column per metric."""
    runs = runs if wanted is None else runs.where(F.col("run_id").isin(*wanted))
    return runs.groupBy("run_id", "name").pivot("metric").agg(F.first("value"))


def series(observations: DataFrame) -> DataFrame:
    """observations (kind, name, labels, value, at): counters add up, gauges keep the last, summaries keep count and sum."""
    last = F.max_by("value", "at")
    total = F.sum("value")
    value = F.when(F.col("kind") == "gauge", F.col("_last")).otherwise(F.col("_sum"))
    grouped = observations.groupBy("kind", "name", "labels").agg(F.count("*").alias("n"), total.alias("_sum"), last.alias("_last"))
    return grouped.select("kind", "name", "labels", "n", value.alias("value"))
