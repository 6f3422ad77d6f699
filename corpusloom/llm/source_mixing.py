"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash in [0, 2^52). A source's budget is met by the documents
below a threshold of that hash: words are summed by source and leading hash
bits, the bucket in which the running sum passes the budget is refined by its
next bits, and the final filter compares hashes with thresholds. Documents are
never sorted; larger budgets give larger, nested choices.

Nulls and odd rows: a null text has size 0; a null source is a source, ordered
last; the hash is of id and text, so that rows that share an id or have none are
chosen one by one; only rows equal in both share a hash and are taken or left
together; extra columns pass through `keep`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
HASH_BITS = 52
LEVEL_BITS = 13


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id_col: Column, text: Column) -> Column:
    """The first 52 bits of the MD5 of id and text, as long."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """source, source_size, target, budget: one row per source.

    Sources in code-point order get the weights in turn. With cap/weight in
    rising order, the sources whose cap is under their share of what is left are
    those that stop at the cap; the rest share the remainder by weight.
    budget: the words to choose by threshold, beyond any whole copy.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: a list of sources, not of documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "_total": F.lit(total_share) * F.sum("source_size").over(everything),
            "_weights": F.sum("weight").over(everything),
            "_cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "_weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("_unit", (F.col("_total") - F.col("_cap_before")) / (F.col("_weights") - F.col("_weight_before")))
    rows = rows.withColumn("_free", F.col("cap") > F.col("_unit") * F.col("weight"))
    # The unit of the first source that stays under its cap holds for all after it.
    rows = rows.withColumn("_free_unit", F.min(F.when(F.col("_free"), F.struct(F.col("cap") / F.col("weight"), F.col("_unit").alias("unit")))).over(everything)["unit"])
    target = F.when(F.col("_free"), F.col("_free_unit") * F.col("weight")).otherwise(F.col("cap"))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    return rows.withColumn("target", target).select(
        "source", "source_size", "target", whole.cast("long").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("budget"),
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, cut: documents with hash < cut are chosen to meet the source's budget.

    Each level sums the sizes of the documents left by source and the next
    LEVEL_BITS bits, so that a source has at most 2^LEVEL_BITS sums however many
    documents it has. At the last level a bucket is one hash value; it is
    included when that brings the sum closer to the budget.
    """
    state = targets.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    rest = sizes.select("source", "size", "hash")
    closed = []
    levels = HASH_BITS // LEVEL_BITS
    for level in range(1, levels + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        sums = rest.groupBy(F.col("source").alias("_source"), F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("_source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        crossing = (
            sums.join(state, F.col("_source").eqNullSafe(F.col("source")))
            .where(F.col("upto") > F.col("budget"))
            .groupBy("source", "budget")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("at"))
            .select("source", F.col("at.bucket").alias("prefix"), F.col("at.words").alias("words"), (F.col("budget") - F.col("at.upto") + F.col("at.words")).alias("budget"))
        )
        crossing = stored(crossing, f"boundary-{level}")
        if level == 1:
            missing = targets.join(crossing.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
            closed.append(missing.select("source", F.lit(1 << HASH_BITS).cast("long").alias("cut")))
        if level < levels:
            state = crossing.select("source", "budget", "prefix")
            at = crossing.select(F.col("source").alias("_s"), "prefix")
            inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift) == F.col("prefix"))
            rest = stored(rest.join(at, inside, "left_semi"), f"boundary-rows-{level}")
        else:
            closer = F.col("words") - F.col("budget") < F.col("budget")
            closed.append(crossing.select("source", (F.col("prefix") + F.when(closer, 1).otherwise(0)).cast("long").alias("cut")))
    return closed[0].unionByName(closed[1])


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeat: int = MAX_REPEAT,
    copies: str | None = None,
) -> DataFrame:
    """One row per document with the words that the mix takes of it, repeats counted.

    copies: name of a further column with how often the document is taken, which
    the words of a document without any do not tell.

    With columns in `keep`, those are read again beside the sizes and joined by
    nothing: the sizes are worked out in the same pass that reads them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(id_col), F.col(text)).alias("hash"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    sizes = stored(rows.select("doc_id", "source", "size", "hash"), "mix-sizes")
    targets = stored(source_targets(sizes, weights, total_share, max_repeat), "mix-targets")
    cuts = stored(thresholds(sizes, targets), "mix-cuts")
    plan = stored(
        targets.join(cuts.withColumnRenamed("source", "_cs"), F.col("source").eqNullSafe(F.col("_cs")))
        .select(F.col("source").alias("_ps"), "source_size", "target", "whole", "cut"),
        "mix-plan",
    )
    picked = (rows if keep else sizes).join(plan, F.col("source").eqNullSafe(F.col("_ps")))
    times = F.least(F.col("whole") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0), F.lit(max_repeat)).cast("int")
    return picked.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"),
        *([times.alias(copies)] if copies else []), *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


#: DuckDB SQL for mix_sources over documents: the same choice by sorting.
ORACLE = """
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0 * source_size AS cap FROM t),
u AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS unit
  FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(unit, cap / weight) AS unit FROM u WHERE cap > unit * weight),
g AS (SELECT source, source_size, CASE WHEN cap > u.unit * weight THEN f.unit * weight ELSE cap END AS target FROM u LEFT JOIN f ON true),
b AS (SELECT *, floor(target / greatest(source_size, 1)) AS whole, target - floor(target / greatest(source_size, 1)) * source_size AS budget FROM g),
h AS (SELECT source, h, sum(size) AS words FROM s GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM h),
d AS (
  SELECT c.source, c.h, c.upto <= b.budget OR (c.upto - c.words <= b.budget AND c.words - (b.budget - c.upto + c.words) < b.budget - c.upto + c.words) AS chosen
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
       CAST(s.size * least(b.whole + CASE WHEN d.chosen THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source JOIN d ON s.source IS NOT DISTINCT FROM d.source AND s.h = d.h
"""
