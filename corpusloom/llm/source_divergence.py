"""Source divergence audit: how far the word shares of a language's sources lie apart, exactly.

The distance of two sources is a sum over the whole vocabulary of their language,
but a source holds few of its terms. By inclusion-exclusion over the two supports
the sum falls into parts that are cheap:

- constants: as if no term stood in either, V times the distance of the two
  shares that a count of zero has;
- one side: each source's histogram of counts (how many terms stand there so many
  times) is priced against the other's share of zero, without looking at terms;
- overlaps: only terms that stand in both need their names; a sparse join of the
  postings corrects what the two one-sided prices counted wrongly.

Counting is done in Arrow batches with sums kept per task, everything after it in
integers and decimals. Sources of a language meet on a salted key, so that a
language with most of the rows is dealt over many tasks.

Nulls and odd rows: null text, lang and source are ''; a source without kept terms
has every term at the share of zero; a language without kept terms has distance 0
throughout; repeated rows and ids count as often as they stand there; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import stored

#: Documents of its language that a term is kept for, its pseudo-count, the scale of shares, terms listed per source.
LEAST_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Keys that the rows of one language are dealt over.
SALTS = 32
#: Bytes of a text cut at one time, and different terms a task sums before it sends them on.
BLOCK = 1 << 20
TABLE_SIZE = 1 << 18

#: Bytes of terms with A-Z in lower case, blanks for all others: ASCII letters and every byte beyond ASCII stay.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
OTHER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
COUNTED = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("docs", T.LongType()),
])


def terms_of(text: bytes) -> Counter:
    """How often each term stands in a text in UTF-8, cut in blocks that end between terms."""
    n, at = Counter(), 0
    while at < len(text):
        cut = OTHER.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        n.update(text[at:end].translate(LETTERS).split())
        at = end
    return n


def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, docs) summed over a task's documents, sent on whenever TABLE_SIZE terms are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pd.DataFrame:
        made = [(lang, source, t.decode("utf-8", "replace"), n, docs[t]) for (lang, source), (total, docs) in held.items() for t, n in total.items()]
        held.clear()
        return pd.DataFrame(made, columns=COUNTED.names)

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            total, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms_of(text), len(total)
            total.update(found)
            docs.update(found.keys())
            size += len(total) - before
            if size >= TABLE_SIZE:
                yield rows()
                size = 0
    yield rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in decimals, so that no product overflows."""
    wide = "decimal(19,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast(wide)
    below = (total + PRIOR * terms).cast(wide)
    return F.call_function("div", above, below) + 1


def _apart(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by distance, and the terms that a source overuses most."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    words = named.mapInPandas(count_terms, COUNTED)
    counts = stored(words.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = stored(kept, "divergence-terms")
    langs = kept.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("v"))
    posted = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "divergence-postings")
    totals = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "all_total", "v")])
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))
    groups = stored(groups.withColumn("z", zero), "divergence-groups")
    shares = posted.join(groups.drop("z"), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("all_n"), F.col("all_total"), F.col("v")))
    shares = stored(shares.select("lang", "source", "term", "n", "p", "q"), "divergence-shares")

    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    pairs = pair_values(groups, shares).withColumn("rank", F.row_number().over(by))
    return pairs.select(over.columns).unionByName(over)


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, part, item, value for every ordered pair of sources of a language.

    groups: lang, source, v, z (the share of a count of zero). shares: lang,
    source, term, n, p of the terms that a source holds.
    """
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")
    # The other side of each meeting, once for every salt: a row per source.
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    neither = groups.select("lang", "source", "v", "z", salt("source")).join(others, ["lang", "salt"]).where("source != item")
    neither = neither.select("lang", "source", "item", F.coalesce(F.col("v") * _apart("z", "zb"), F.lit(0)).alias("value"))
    # How many terms a source holds so many times; all of them have one share.
    histogram = shares.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("terms")).join(groups.select("lang", "source", "z"), ["lang", "source"])
    alone = histogram.select("lang", "source", "p", "z", "terms", salt("source", "n")).join(others, ["lang", "salt"]).where("source != item")
    alone = alone.select("lang", "source", "item", (F.col("terms") * (_apart("p", "zb") - _apart("z", "zb"))).alias("value"))
    both_ways = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    alone = both_ways(alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    # Terms of both supports, each pair of sources once.
    held = shares.join(groups.select("lang", "source", "z"), ["lang", "source"]).select("lang", "term", "source", "p", "z")
    second = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    joint = held.join(second, ["lang", "term"]).where("source < item")
    wrong = _apart("p", "pb") - _apart("p", "zb") - _apart("z", "pb") + _apart("z", "zb")
    joint = both_ways(joint.select("lang", "source", "item", wrong.alias("value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    summed = neither.unionByName(alone).unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.withColumn("part", F.lit("pair"))


#: Every term of the language against every pair of its sources, without the split.
ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
x AS (SELECT k, lang, source, unnest(w) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, sum(n)::HUGEINT AS all_n, count(*)::HUGEINT AS v FROM t GROUP BY lang),
c AS (SELECT x.lang, x.source, x.term, count(*)::HUGEINT AS n FROM x JOIN t USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(s.total, 0) AS total, coalesce(l.v, 0) AS v, l.all_n FROM d LEFT JOIN s USING (lang, source) LEFT JOIN l ON l.lang = d.lang),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p,
             1 + 1000000000 * (t.n::HUGEINT + 5) // (g.all_n + 5 * g.v) AS q
      FROM g JOIN t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
