"""SimHash near-duplicates found through anchors of a covering code.

Fingerprints are made in Arrow batches; equal fingerprints are one node from
there on. Two nodes that differ in at most two bits differ in at most one bit of
the upper or of the lower half. On each half the anchors are the words of the
(31, 26) Hamming code with a free 32nd bit: a perfect code, covering radius 1.
A node goes, per half, to its own nearest anchor, and as a replica to every
anchor within radius plus threshold, 1 + 1 bits: at most 17. Pairs that meet at
an anchor are compared in full. Cells hold distinct fingerprints only, so that
copies never meet each other.

Components come from rounds of smallest-neighbour hooking on the links of
distinct fingerprints, with each round written to the shared folder.

Nulls and odd rows: null and empty texts have fingerprint 0 and link like any
other; null ids take part in a component but never name one; repeated rows get
equal results; extra columns pass through `keep`; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import drop_stored, stored

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Copies of one fingerprint beyond which its rows are labelled where they lie; at most rows / HOT_ROWS fingerprints are so.
HOT_ROWS = 50_000
#: Shingles hashed at a time, so that a very long text needs bounded memory.
BLOCK = 65_536


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words."""
    # bytes.lower() changes A-Z only, bytes.split() cuts at \x20 and \x09-\x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(t) for t in texts], dtype="int64")


#: Masks of the code's five parity checks over positions 1 to 31 (bit p-1 is position p).
CHECKS = tuple(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5))


def _syndrome(half: Column) -> Column:
    """The position at which the half's 31 coded bits differ from their code word, 0 if nowhere."""
    total = F.lit(0)
    for j, mask in enumerate(CHECKS):
        total = total + F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
    return total


def _flip(half: Column, position: Column) -> Column:
    """The half with the bit of a position from 1 turned, or unchanged for 0."""
    bit = F.expr("1L") * F.when(position == 0, 0).otherwise(F.pow(F.lit(2.0), position - 1).cast("long"))
    return half.bitwiseXOR(bit)


def anchors(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(half, anchor, fp) rows at the nearest anchors, and at all anchors within radius plus threshold."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = nodes.select("fp", F.posexplode(F.array(low, high)).alias("half", "bits")).withColumn("s", _syndrome(F.col("bits")))
    home = _flip(F.col("bits"), F.col("s"))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda a: a.bitwiseXOR(F.col("s")) < a)
    near = F.transform(pairs, lambda a: _flip(_flip(F.col("bits"), a), a.bitwiseXOR(F.col("s"))))
    # A code word has no other code word within two bits.
    near = F.when(F.col("s") == 0, F.array(home)).otherwise(near)
    reached = F.concat(near, F.array(home.bitwiseXOR(F.lit(1 << 31))))
    return (
        halves.select("half", home.alias("anchor"), "fp"),
        halves.select("half", F.explode(reached).alias("anchor"), "fp"),
    )


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b: pairs of distinct fingerprints that differ in at most max_bits bits (2 at most)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the anchors cover thresholds up to 2 bits")
    at_home, reached = anchors(nodes)
    x = at_home.withColumnRenamed("fp", "a")
    y = reached.withColumnRenamed("fp", "b")
    return (
        x.join(y, ["half", "anchor"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link.

    Large-star and small-star steps alternate until the edges are stars. Each
    round is a written table of at most as many edges as there were links.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
        )
        after = stored(small.distinct(), "links")
        state = _state(after)
        drop_stored(after.sparkSession, now)
        now, done, before = after, state == before, state
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    max_bits: int = MAX_BITS,
    root: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """id, fp, component_id, keep...: one row per document; component_id is the smallest id reachable.

    root: name of a further column with the component's smallest fingerprint, which
    tells components apart where ids repeat or are null.
    """
    prints = stored(
        docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text)).alias("fp"), *[F.col(c).alias(f"_keep_{c}") for c in keep]),
        "fingerprints",
    )
    nodes = stored(prints.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    roots = stored(components(links(nodes.select("fp"), max_bits)), "fingerprint-roots")
    # Nodes without links are their own component; only the linked ones are gathered.
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "right").select("root", "least")
    heads = roots.select("root").distinct()
    linked = linked.unionByName(nodes.join(heads, nodes["fp"] == heads["root"]).select("root", "least"))
    named = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    members = roots.unionByName(heads.select(F.col("root").alias("node"), "root"))
    moved = stored(members.join(named, "root").select("node", "root", "smallest"), "fingerprint-names")
    labels = nodes.join(moved, nodes["fp"] == moved["node"], "left").select(
        F.col("fp").alias("_fp"), "n", F.coalesce("root", "fp").alias("_root"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")
    )
    labels = stored(labels, "fingerprint-labels")
    cold = labels.where(F.col("n") <= hot_rows).drop("n")
    # One row per hot fingerprint, so that no task gets all copies of one: a broadcast of at most rows / hot_rows rows.
    hot = labels.where(F.col("n") > hot_rows).drop("n")
    out = [F.col("_id").alias(id_col), "fp", "component_id", *([F.col("_root").alias(root)] if root else []), *[F.col(f"_keep_{c}").alias(c) for c in keep]]
    same = F.col("fp") == F.col("_fp")
    few = prints.join(F.broadcast(hot.select("_fp")), same, "left_anti").join(cold, same).select(out)
    return few.unionByName(prints.join(F.broadcast(hot), same).select(out))


def hex16(fp: Column) -> Column:
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
