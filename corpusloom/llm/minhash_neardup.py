"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of shingles gives VALUES MinHash values of 16 bits, cut into
CHUNKS chunks of four. Two sets of similarity s differ in VALUES * (1 - s) values
on average. By pigeonhole, two signatures that differ in MAX_DIFFER values or
fewer have a chunk in which at most one value differs; so every chunk is a key
four times, each time with another value left out, and all such pairs share a
key. At the threshold of 0.85 a pair differs in more than MAX_DIFFER values with
probability 3.5e-6; most of those share a key all the same, and pairs are only
dropped beyond PRUNE values. What meets is confirmed on full sets.

Equal sets are one node from the start. In keys of few nodes all pairs are rows.
In large ones every node first meets the key's smallest and largest node only,
which links the members of large groups without making their pairs. What those
links leave apart from the component of the key's smallest node is then compared
with all of the key, in blocks of bounded size whose sets are multiplied as
matrices, which sends on links alone. Pairs that are connected already are never
compared. Sets are made again from the text, and only for nodes that met another.

Nulls and odd rows: texts without words have empty sets, link to nothing and are
their own component; fewer words than a shingle are one shingle; null ids take
part in a component but never name one (a component of null ids alone has none);
repeated rows get equal results; extra columns pass through `keep`; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.simhash_neardup import components
from corpusloom.session import drop_stored, stored

SHINGLE = 3
#: Similarity in percent from which sets are linked.
PERCENT = 85
CHUNKS = 8
WIDTH = 4
VALUES = CHUNKS * WIDTH
#: One error is allowed in each chunk: 2 * CHUNKS - 1 differing values are guaranteed, more than PRUNE are never compared.
MAX_DIFFER = 2 * CHUNKS - 1
PRUNE = 18
#: Nodes of a key up to which its pairs are rows; nodes and shingles of a block beyond.
SMALL_KEY = 16
BLOCK_NODES = 256
BLOCK_SHINGLES = 1 << 21
#: Columns of a matrix at a time.
COLUMNS = 4096
#: Copies of one set beyond which its rows are labelled where they lie; at most rows / HOT_ROWS sets are so.
HOT_ROWS = 50_000
#: Bytes of a text whose words are lists at one time.
BLOCK = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
SEEDS = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(VALUES)], dtype=np.uint64)
#: Odd multipliers of the mixing steps and of the words of a shingle.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
CHUNK_NAMES = [f"c{i}" for i in range(CHUNKS)]
SKETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "hi", "lo", *CHUNK_NAMES)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8, A-Z as a-z."""
    known: dict[bytes, int] = {}
    parts, at, text = [np.zeros(0, dtype=np.uint64)], 0, text or b""
    while at < len(text):
        cut = BLANK.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        words = text[at:end].lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        parts.append(np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words)))
        at = end
    words = np.concatenate(parts)
    if not len(words):
        return words
    n = min(size, len(words))
    # Of fewer words the whole sequence is one shingle; its length sets it apart.
    gram = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        gram = mixed(gram * MIX[0] + words[i : len(words) - n + 1 + i])
    return np.unique(gram)


def signature(grams: np.ndarray) -> np.ndarray:
    """CHUNKS 64-bit integers of four 16-bit MinHash values each."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), BLOCK >> 4):
        part = mixed(grams[None, at : at + (BLOCK >> 4)] ^ SEEDS[:, None])
        least = np.minimum(least, part.min(axis=1))
    return (least & np.uint64(0xFFFF)).astype("<u2").view("<i8")


@F.pandas_udf(SKETCH)
def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """n, the set's 128-bit digest as hi and lo, and its signature's chunks."""
    for texts in batches:
        rows = []
        for t in texts:
            grams = shingles(t)
            digest = np.frombuffer(xxhash.xxh3_128_digest(grams.astype("<u8").tobytes()), dtype="<i8")
            rows.append((len(grams), *digest.tolist(), *signature(grams).tolist()))
        yield pd.DataFrame(rows, columns=SKETCH.names)


@F.pandas_udf(T.BinaryType())
def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sorted hashes of a text's shingles in bytes."""
    for texts in batches:
        yield pd.Series([shingles(t).astype("<u8").tobytes() for t in texts])


@F.pandas_udf(T.LongType())
def shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Number of hashes that two sorted sets have in common."""
    for left, right in batches:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = sorted((np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")), key=len)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            out.append(int((y[at] == x).sum()))
        yield pd.Series(out, dtype="int64")


def _lane(j: int) -> int:
    return 0xFFFF << 16 * j


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys() -> Column:
    """The chunks with one value left out, 48 bits below the number of chunk and value."""
    every = []
    for i, c in enumerate(CHUNK_NAMES):
        for j in range(WIDTH):
            below = F.col(c).bitwiseAND(F.lit((1 << 16 * j) - 1))
            above = F.shiftleft(F.shiftrightunsigned(c, 16 * (j + 1)), 16 * j) if j < WIDTH - 1 else F.lit(0).cast("long")
            every.append(above.bitwiseOR(below).bitwiseOR(F.lit((i * WIDTH + j) << 48)))
    return F.array(*every)


def _xor(i: int) -> Column:
    return F.col(f"x.c{i}").bitwiseXOR(F.col(f"y.c{i}"))


def differing() -> Column:
    """Values in which the signatures of x and y differ."""
    return sum((F.when(_xor(i).bitwiseAND(F.lit(_signed(_lane(j)))) != 0, 1).otherwise(0) for i in range(CHUNKS) for j in range(WIDTH)), F.lit(0))


def similar_sizes(percent: int) -> Column:
    return 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough. sets: nid, n, grams."""
    x = sets.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    y = sets.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("both", shared("ga", "gb"))
    return both.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def link_blocks(percent: int):
    """A function from two blocks of a key's nodes to links (a, b) that connect what is similar: fewer than there are nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(g, dtype="<u8") for g in rows["grams"]]
        nodes, n, root, block = (rows[c].to_numpy() for c in ("nid", "n", "root", "block"))
        names, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        often = np.bincount(where, minlength=len(names)) > 1
        place = np.cumsum(often) - 1
        owner, where = owner[often[where]], place[where[often[where]]]
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], where[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(often.sum()), COLUMNS):
            span = slice(*np.searchsorted(where, [at, at + COLUMNS]))
            held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            held[owner[span], where[span] - at] = 1
            # Counts are whole numbers below 2^24, exact in single precision.
            both += held @ held.T
        wanted = (root[:, None] != root[None, :]) & np.triu(np.ones(both.shape, dtype=bool), 1)
        if block.min() != block.max():
            wanted &= block[:, None] != block[None, :]
        shared = both.astype(np.int64)
        a, b = np.nonzero(wanted & (100 * shared >= percent * (n[:, None] + n[None, :] - shared)))
        up, links = list(range(len(sets))), []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(i), top(j)
            if p != q:
                up[p] = q
                links.append((nodes[i], nodes[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def candidates(members: DataFrame, leaders: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of small keys, and those with the ends of large ones, that are near enough in size and signature."""
    two = leaders.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    few = members.where((F.col("size") > 2) & (F.col("size") <= SMALL_KEY)).select("key", "nid")
    x, y = few.alias("x"), few.alias("y")
    some = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.nid") < F.col("y.nid"))).select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"))
    ends = members.where(F.col("size") > SMALL_KEY).select("nid", F.explode(F.array("low", "high")).alias("end")).where("nid != end")
    stars = ends.select(F.least("nid", "end").alias("a"), F.greatest("nid", "end").alias("b"))
    pairs = two.unionByName(some).unionByName(stars).distinct()
    x, y = nodes.alias("x"), nodes.alias("y")
    met = pairs.join(x, pairs["a"] == F.col("x.nid")).join(y, pairs["b"] == F.col("y.nid"))
    return met.where(similar_sizes(percent) & (differing() <= PRUNE)).select("a", "b")


def block_links(large: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links of large keys between components. large: key, nid, low.

    The component of a key's smallest node is its main one; what is not in it
    meets all of the key. A task gets two blocks of one key.
    """
    rooted = large.join(roots, large["nid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "nid")).drop("node")
    rooted = stored(rooted.join(sets.select("nid", "n"), "nid"), "minhash-rooted")
    mains = rooted.where("nid = low").groupBy("key").agg(F.max("root").alias("main"))
    sided = rooted.join(mains, "key").withColumn("aside", (F.col("root") != F.col("main")).cast("int"))
    of = lambda side: F.greatest(F.ceil(F.count(side) / BLOCK_NODES), F.ceil(F.sum(F.when(side.isNotNull(), F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    apart = sided.groupBy("key", "main").agg(of(F.when(F.col("aside") == 1, 1)).alias("p"), of(F.when(F.col("aside") == 0, 1)).alias("m"))
    apart = stored(apart.where("p > 0"), "minhash-apart")
    own = F.pmod(F.xxhash64("nid"), F.when(F.col("root") != F.col("main"), F.col("p")).otherwise(F.col("m"))).cast("int")
    block = F.when(F.col("root") != F.col("main"), own).otherwise(own + F.col("p"))
    many = rooted.join(apart, "key").withColumn("block", block)
    # Blocks aside from the main component come first: one of each two is among them.
    other = F.sequence(F.lit(0), F.when(F.col("block") < F.col("p"), F.col("p") + F.col("m") - 1).otherwise(F.col("p") - 1))
    many = many.join(sets.select("nid", "grams"), "nid").withColumn("other", F.explode(other))
    dealt = many.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "nid", "n", "root", "block", "grams")
    return dealt.groupBy("key", "i", "j").applyInPandas(link_blocks(percent), "a long, b long")


def near_nodes(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """node, root: the smallest node reachable, for every node with a link. nodes: nid, n, chunks; sets_of gives nid, n, grams for some nid."""
    keyed = nodes.select("nid", F.explode(keys()).alias("key"))
    leaders = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("nid").alias("low"), F.max("nid").alias("high"))
    leaders = stored(leaders.where("size > 1"), "minhash-keys")
    members = stored(keyed.join(leaders.where("size > 2"), "key"), "minhash-members")
    pairs = stored(candidates(members, leaders, nodes, percent), "minhash-pairs")
    large = members.where(F.col("size") > SMALL_KEY).select("key", "nid", "low")
    wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).unionByName(large.select("nid"))
    sets = stored(sets_of(wanted.distinct()), "minhash-sets")
    links = stored(confirmed(pairs, sets, percent), "minhash-links")
    roots = stored(components(links), "minhash-roots")
    more = block_links(large, roots, sets, percent)
    joined = stored(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "minhash-more-links")
    out = stored(components(joined), "minhash-components")
    drop_stored(nodes.sparkSession, leaders, members, pairs, sets, links, roots, joined)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = (), percent: int = PERCENT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept, keep...: one row per document; component_id is the smallest id reachable."""
    named = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    named = named.withColumn("th", F.xxhash64("_text"))
    base = named.withColumn("_s", sketch("_text")).drop("_text").select(F.monotonically_increasing_id().alias("rid"), "*").select("*", "_s.*").drop("_s")
    base = stored(base, "minhash-signatures")
    # A node is named by the first row that has its set.
    same = [F.first(c).alias(c) for c in ("n", *CHUNK_NAMES)]
    nodes = base.where("n > 0").groupBy("hi", "lo").agg(F.min("rid").alias("nid"), F.min("_id").alias("least"), F.count("*").alias("copies"), *same)
    nodes = stored(nodes, "minhash-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = base.select(F.col("rid").alias("nid"), "n", F.col("th").alias("_th"), F.col("_id").alias("_named")).join(wanted, "nid")
        texts = named.select("_id", "th", "_text").join(rows, (F.col("th") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("_named")))
        # Of repeated rows one is enough.
        return texts.groupBy("nid", "n").agg(F.first("_text").alias("_text")).select("nid", "n", hashes("_text").alias("grams"))

    roots = near_nodes(nodes.select("nid", "n", *CHUNK_NAMES), sets_of, percent)
    rooted = nodes.join(roots, nodes["nid"] == roots["node"], "left").select("hi", "lo", "least", "copies", F.coalesce("root", "nid").alias("root"))
    rooted = stored(rooted, "minhash-labels")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(rooted.join(named, "root").select("hi", "lo", "copies", "component_id"), "minhash-names")
    label = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    out = [
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"), F.col("_id").eqNullSafe(label).alias("kept"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    ]
    rows = base.drop("rid", "th", *CHUNK_NAMES)
    # One row per hot set, so that no task gets all copies of one: a broadcast of at most rows / hot_rows rows.
    hot = F.broadcast(labels.where(F.col("copies") > hot_rows).drop("copies"))
    cold = labels.where(F.col("copies") <= hot_rows).drop("copies")
    bare = rows.where("n = 0").withColumn("component_id", F.lit(None).cast(dict(rows.dtypes)["_id"])).select(out)
    rows = rows.where("n > 0")
    few = rows.join(hot.select("hi", "lo"), ["hi", "lo"], "left_anti").join(cold, ["hi", "lo"]).select(out)
    return bare.unionByName(few).unionByName(rows.join(hot, ["hi", "lo"]).select(out))


#: Every pair of documents that share a shingle, and the components of what is similar enough.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
n AS (SELECT k, doc_id, CAST(len(s) AS BIGINT) AS n FROM g),
x AS (SELECT k, hash(unnest(s)) AS h FROM g),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS both FROM x a JOIN x b ON a.h = b.h AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT p.a, p.b FROM p JOIN n u ON u.k = p.a JOIN n v ON v.k = p.b WHERE 100 * p.both >= 85 * (u.n + v.n - p.both)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT k AS a, k AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT c.a AS k, min(n.doc_id) AS component_id FROM c JOIN n ON n.k = c.b GROUP BY c.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id IS NOT DISTINCT FROM m.component_id AS kept FROM n JOIN m USING (k)
"""
