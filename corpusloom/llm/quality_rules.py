"""Quality rules over words and lines, with cross-document line frequency.

Everything is DataFrame functions. Text is read in three narrow passes (line
counts, frequent lines, statistics); no pass shuffles text.

Nulls and odd rows: a null text counts as empty; a null host is a host of its
own; rows of one id are one document of their host, rows without an id one for
each text; repeated rows get equal results; extra columns are ignored unless
named in `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL_COMPLEMENT = r"[^#*$%&|<>]+"

#: Base rules of the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is above the limits when it stands in more than MAX_LINE_DOCS
#: documents of one host and in more than MAX_LINE_SHARE of that host's documents.
MAX_LINE_DOCS = 20
MAX_LINE_SHARE = 0.002
#: A document is depleted when fewer words than this share of it are left.
MIN_LEFT_SHARE = 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def row_key(*cols: Column) -> Column:
    """Equal for equal rows, never null."""
    return F.xxhash64(*cols)


def text_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to each row.

    Repeated 3-word windows are found inside the row: window hashes with their
    positions are sorted, equal neighbours mark repeated windows, and the words
    covered are summed over the gaps between the marked positions.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    out = docs.withColumns({"_w": words(body), "_lines": with_word})
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, SYMBOL_COMPLEMENT, "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.slice(
                F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))),
                F.lit(1),
                F.greatest(F.size("_w") - 2, F.lit(0)),
            ),
        }
    ).drop("_w", "_lines")
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_h")
    out = out.withColumn(
        "_at",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda e, k: (e["h"] == F.get("_sorted", k + 1)["h"]) | ((k > 0) & (e["h"] == F.get("_sorted", k - 1)["h"])),
                ),
                lambda e: e["i"],
            )
        ),
    ).drop("_sorted")
    covered = F.aggregate(
        F.transform("_at", lambda at, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), at - F.get("_at", k - 1)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def frequent_lines(docs: DataFrame, id_col: str, text: str, host: str, max_docs: int, max_share: float) -> DataFrame:
    """host, line: hashes of normalised lines that stand in too many documents of a host."""
    hashes = F.array_distinct(
        F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(normalised_line(x)))
    )
    document = F.coalesce(F.xxhash64(F.col(id_col).cast("string"), F.when(F.col(id_col).isNull(), F.col(text))), F.lit(0)).alias("document")
    counts = (
        docs.where(F.col(text).isNotNull())
        .select(F.col(host).alias("host"), document, F.explode(hashes).alias("line"))
        .groupBy("host", "line")
        .agg(F.count_distinct("document").alias("n_docs"))
        .where(F.col("n_docs") > max_docs)
    )
    sizes = docs.select(F.col(host).alias("_host"), document).groupBy("_host").agg(F.count_distinct("document").alias("host_docs"))
    return (
        counts.join(sizes, F.col("host").eqNullSafe(F.col("_host")))
        .where(F.col("n_docs") > F.lit(max_share) * F.col("host_docs"))
        .select("host", "line")
    )


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    keep: Sequence[str] = (),
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_line_docs: int = MAX_LINE_DOCS,
    max_line_share: float = MAX_LINE_SHARE,
    min_left_share: float = MIN_LEFT_SHARE,
) -> DataFrame:
    """One row per document: statistics, words removed with frequent lines, and the verdict.

    base_failed: under min_words words, or repeated windows cover over
    max_repeat_percent of them. kept: not base_failed, and at least
    min_left_share of the words are left once frequent lines are removed.
    Empty tables give empty results.
    """
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(host).alias("_host"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    base = base.withColumn("_key", row_key("_id", "_host", "_text"))
    frequent = stored(frequent_lines(base, "_id", "_text", "_host", max_line_docs, max_line_share), "frequent-lines")
    lines = (
        base.where(F.col("_text").isNotNull())
        .select("_id", "_key", "_host", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .where(F.col("_line").rlike(WORD))
        .select(
            "_id", "_key", "_host", "_pos",
            F.xxhash64(normalised_line(F.col("_line"))).alias("_hash"),
            F.regexp_count("_line", F.lit(WORD)).alias("_n"),
        )
    )
    hit = (F.col("_host").eqNullSafe(frequent["host"])) & (F.col("_hash") == frequent["line"])
    removed = (
        lines.join(frequent, hit, "left_semi")
        .groupBy("_id", "_key", "_pos").agg(F.max("_n").alias("_n"))
        .groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(F.sum("_n").alias("n_removed_words"))
    )
    stats = text_statistics(base, "_text").drop("_text", "_host")
    out = stats.join(removed, (stats["_key"] == removed["_rkey"]) & stats["_id"].eqNullSafe(removed["_rid"]), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return out.withColumns(
        {"n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long"), "base_failed": failed}
    ).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (left >= F.lit(min_left_share) * F.col("n_words"))).alias("kept"),
        "n_removed_words", *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


#: DuckDB SQL for quality_rules over documents.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, '')) AS document,
             coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) r(i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM v),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, unnest(range(0, 3)) t(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, document, source, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h,
        len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT rid, document, source, unnest(string_split(text, chr(10))) AS x FROM d)),
u AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM l WHERE n > 0 GROUP BY rid),
s AS (SELECT source, count(DISTINCT document) AS n FROM d GROUP BY source),
f AS (SELECT l.source, h FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source WHERE l.n > 0 GROUP BY l.source, h, s.n
      HAVING count(DISTINCT document) > {MAX_LINE_DOCS} AND count(DISTINCT document) > {MAX_LINE_SHARE} * s.n),
m AS (SELECT rid, sum(n) AS n FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.h = f.h WHERE n > 0 GROUP BY rid),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed_words
      FROM d LEFT JOIN r USING (rid) LEFT JOIN u USING (rid) LEFT JOIN m USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_words - n_removed_words >= {MIN_LEFT_SHARE} * n_words AS kept FROM a
"""
