"""A stored inverted index in shards of documents, read by every sparse search.

Building is one pass without a shuffle: each task cuts the chunks it reads into
shards of at most SHARD_DOCS chunks, as many as one bitmap of Spark's bitmap
functions has bits, and writes each term's postings in blocks, the strongest
first, with the bounds that a block's scores cannot exceed. A chunk is a position
within its shard; positions follow the order of ids.

Searching sends the blocks of asked terms to their shards and scores a block of
queries there. Top-k by weights keeps the k-th best score so far and leaves out
blocks that cannot reach it (block-max pruning); once the terms still to come
cannot lift a new chunk to it, only the chunks already met are looked up.
Conjunctions begin with the shard's rarest term. What a shard sends on are its
top k or its matches, so nothing is shuffled by chunk.

`allowed` narrows a search before top-k: a bitmap of permitted positions for each
query and shard (see retrieve.readable_bitmaps).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import query_tokens
from corpusloom.session import new_folder

#: Chunks of a shard: the bits of one bitmap of bitmap_construct_agg. Postings beyond which a shard is closed early.
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 22
BLOCK = 128
#: Postings of a shard that are ordered by strength at a time, or those of one term.
SORTED = 1 << 16
#: Queries that meet a shard in one task.
QUERY_BLOCK = 2000
#: Okapi BM25.
K1, B = 1.2, 0.75
#: Room for rounding when bounds are compared.
SLACK = 1e-5
#: Bytes of query words in lower case, blanks for all others.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x5F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Index:
    """docs: shard, pos, chunk_id, n_tokens. blocks: shard, term, n, top_tf, low_len, pos, tf; the term '' holds all lengths of a shard."""

    docs: DataFrame
    blocks: DataFrame

    def totals(self) -> tuple[int, float]:
        """Chunks and their mean number of tokens."""
        row = self.docs.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean")).first()
        return row.n, float(row.mean or 0.0)


ROWS = "kind string, shard long, term string, n int, top_tf long, low_len long, pos binary, tf binary, at int, n_tokens long, chunk_id "


class _Shard:
    """The chunks of a shard, each as the numbers of its terms and their counts: eight bytes a posting, and each term once."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.docs: list[tuple[object, np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, chunk_id: object, text: bytes | None) -> None:
        counts, ids = Counter((text or b"").translate(WORDS).split()), self.ids
        terms = np.fromiter((ids.setdefault(t, len(ids)) for t in counts), dtype=np.int32, count=len(counts))
        self.docs.append((chunk_id, terms, np.fromiter(counts.values(), dtype="<u4", count=len(counts))))
        self.postings += len(counts)


def _shard_rows(number: int, shard: _Shard) -> Iterator[pd.DataFrame]:
    """The rows of one shard: its chunks, its lengths, and its postings in blocks."""
    docs, ids = sorted(shard.docs, key=lambda d: (d[0] is None, d[0])), shard.ids
    lens = np.array([n.sum() for _, _, n in docs], dtype="<u4")
    blank = dict.fromkeys(("term", "n", "top_tf", "low_len", "pos", "tf", "at", "n_tokens", "chunk_id"))
    made = [{**blank, "kind": "doc", "shard": number, "at": i, "n_tokens": int(lens[i]), "chunk_id": d[0]} for i, d in enumerate(docs)]
    made.append({**blank, "kind": "block", "shard": number, "term": "", "n": 0, "tf": lens.tobytes()})
    names = sorted(ids)
    rank = np.empty(len(names), dtype=np.int32)
    rank[[ids[t] for t in names]] = np.arange(len(names))
    size = [len(n) for _, _, n in docs]
    term = rank[np.concatenate([t for _, t, _ in docs])] if len(names) else np.zeros(0, dtype=np.int32)
    ends = np.cumsum(np.bincount(term, minlength=len(names)))
    # Postings by term; those of a few terms at a time are ordered by strength, so that no wider arrays of all are needed.
    order = np.argsort(term, kind="stable").astype(np.uint32)
    term = None
    pos = np.repeat(np.arange(len(docs), dtype="<u2"), size)[order]
    tf = np.concatenate([n for _, _, n in docs])[order]
    order = None
    mean = lens.mean() if len(lens) else 0.0
    first = begin = 0
    while first < len(names):
        last = max(first + 1, int(np.searchsorted(ends, begin + SORTED, side="right")))
        span = slice(begin, int(ends[last - 1]))
        begins = np.append(begin, ends[first : last - 1])
        own, count = pos[span], tf[span]
        impact = count / (count + K1 * (1 - B + B * lens[own] / max(mean, 1.0)))
        order = np.lexsort((own, -impact, np.repeat(np.arange(first, last), ends[first:last] - begins)))
        pos[span], tf[span] = own[order], count[order]
        for number_of, low, high in zip(range(first, last), begins.tolist(), ends[first:last].tolist(), strict=True):
            for at in range(low, high, BLOCK):
                part = slice(at, min(at + BLOCK, high))
                made.append({
                    **blank, "kind": "block", "shard": number, "term": names[number_of].decode(), "n": part.stop - at, "top_tf": int(tf[part].max()),
                    "low_len": int(lens[pos[part]].min()), "pos": pos[part].tobytes(), "tf": tf[part].tobytes(),
                })
            if len(made) >= 10_000:
                yield pd.DataFrame(made)
                made = []
        first, begin = last, span.stop
    if made:
        yield pd.DataFrame(made)


def _make_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, number = _Shard(), TaskContext.get().partitionId() << 32
    for rows in batches:
        for chunk_id, text in zip(rows["chunk_id"], rows["text"], strict=True):
            held.add(chunk_id, text)
            if len(held.docs) >= SHARD_DOCS or held.postings >= SHARD_POSTINGS:
                yield from _shard_rows(number, held)
                number, held = number + 1, _Shard()
    if held.docs:
        yield from _shard_rows(number, held)


def build(chunks: DataFrame, path: str | None = None, text: str = "text") -> Index:
    """Write the index of chunks (chunk_id, text) to a folder, by default a new shared one, and open it."""
    spark = chunks.sparkSession
    path = path or new_folder(spark, "inverted")
    kind = dict(chunks.dtypes)["chunk_id"]
    rows = chunks.select("chunk_id", F.col(text).cast("binary").alias("text")).mapInPandas(_make_shards, ROWS + kind)
    rows.write.partitionBy("kind").parquet(path)
    return open_index(spark, path, kind)


def open_index(spark: SparkSession, path: str, chunk_id_type: str) -> Index:
    """An index that build() wrote; chunk_id_type is the type of its ids."""
    columns = ROWS.replace("kind string, ", "") + chunk_id_type + ", kind string"
    rows = spark.read.schema(columns).parquet(path)
    docs = rows.where("kind = 'doc'").select("shard", F.col("at").alias("pos"), "chunk_id", "n_tokens")
    return Index(docs, rows.where("kind = 'block'").select("shard", "term", "n", "top_tf", "low_len", "pos", "tf"))


# --- one shard -----------------------------------------------------------------------


def _postings(blocks: pd.DataFrame) -> tuple[np.ndarray, dict[str, list]]:
    """Lengths of a shard's chunks, and for each asked term its blocks as (df, n, top_tf, low_len, pos, tf)."""
    lens, held = np.zeros(0, dtype="<u4"), {}
    for r in blocks.itertuples(index=False):
        if r.term == "":
            lens = np.frombuffer(r.tf, dtype="<u4")
        else:
            held.setdefault(r.term, []).append((r.df, r.n, r.top_tf, r.low_len, np.frombuffer(r.pos, dtype="<u2"), np.frombuffer(r.tf, dtype="<u4")))
    return lens, held


def _permitted(raw: bytes | None, size: int) -> np.ndarray:
    """True for the positions whose bit is set; without a bitmap none is."""
    bits = np.unpackbits(np.frombuffer(raw or b"", dtype=np.uint8), bitorder="little").astype(bool)[:size]
    return np.concatenate([bits, np.zeros(size - len(bits), dtype=bool)])


def best_of_shard(terms: list[list[tuple]], size: int, k: int, ok: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Scores of a shard's chunks, and the postings read; scores are whole for the k best at least.

    terms: for each term its blocks (bound, pos, weights), a term's strongest first.
    """
    terms = sorted(terms, key=lambda blocks: (-max(b[0] for b in blocks), sum(len(b[1]) for b in blocks)))
    tops = [max(b[0] for b in blocks) for blocks in terms]
    rest, every = np.cumsum(tops[::-1])[::-1], sum(tops)
    score, read, least = np.zeros(size), 0, -np.inf
    for i, blocks in enumerate(terms):
        known = None if rest[i] >= least - SLACK else score + rest[i] >= least - SLACK
        for bound, pos, weight in blocks:
            if known is None and bound + every - tops[i] < least - SLACK:
                continue
            read += len(pos)
            add = weight(slice(None))
            take = ok[pos] if ok is not None else None
            if known is not None:
                take = known[pos] if take is None else take & known[pos]
            if take is not None:
                pos, add = pos[take], add[take]
            score[pos] += add
        if k < size:
            least = max(least, np.partition(score, size - k)[size - k])
            least = least if least > 0 else -np.inf
    return score, read


def _score_shard(k: int, digits: int | None, weigh: Callable):
    """A function from a shard's blocks and a block of queries to its best chunks. weigh(df, tf, length) is a weight, rising with tf and falling with length."""

    def run(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        lens, held = _postings(blocks)
        out = []

        def weights(df, pos, tf):
            return lambda part: weigh(df, tf[part], lens[pos[part]])

        ready = {t: [(float(weigh(df, top, low)), pos, weights(df, pos, tf)) for df, _, top, low, pos, tf in bs] for t, bs in held.items()}
        for q in queries.itertuples(index=False):
            terms = [ready[t] for t in q.terms if t in ready]
            if not terms:
                continue
            ok = _permitted(q.allowed, len(lens)) if "allowed" in queries else None
            score, read = best_of_shard(terms, len(lens), k, ok)
            at = np.nonzero(score > 0)[0]
            shown = np.round(score[at], digits) if digits is not None else score[at]
            at = at[np.lexsort((at, -shown))[:k]]
            out += [(q.qid, q.shard, int(i), float(score[i]), read) for i in at]
        return pd.DataFrame(out, columns=["qid", "shard", "pos", "score", "read"])

    return run


def _match_shard(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Chunks that hold every term of a query, with the summed term frequency."""
    lens, held = _postings(blocks)
    lists = {}
    for t, parts in held.items():
        pos, tf = np.concatenate([b[4] for b in parts]), np.concatenate([b[5] for b in parts]).astype(np.int64)
        order = np.argsort(pos)
        lists[t] = pos[order], tf[order]
    out = []
    for q in queries.itertuples(index=False):
        if not len(q.terms) or any(t not in lists for t in q.terms):
            continue
        rarest, *others = sorted(q.terms, key=lambda t: len(lists[t][0]))
        pos, tf = lists[rarest]
        if "allowed" in queries:
            ok = _permitted(q.allowed, len(lens))[pos]
            pos, tf = pos[ok], tf[ok]
        for t in others:
            if not len(pos):
                break
            there, more = lists[t]
            at = np.minimum(np.searchsorted(there, pos), len(there) - 1)
            both = there[at] == pos
            pos, tf = pos[both], tf[both] + more[at[both]]
        out += [(q.qid, q.shard, int(p), int(n)) for p, n in zip(pos, tf, strict=True)]
    return pd.DataFrame(out, columns=["qid", "shard", "pos", "tf"])


# --- searches over all shards ----------------------------------------------------------


def _meet(index: Index, queries: DataFrame, run: Callable, out: str, allowed: DataFrame | None) -> DataFrame:
    """run() on every shard with every block of queries (qid, query), for the chunks found: qid, chunk_id and run's other columns."""
    blocks_of_queries = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks_of_queries)).cast("int").alias("part")
    asked = queries.select("qid", F.array_distinct(query_tokens(F.coalesce("query", F.lit("")))).alias("terms"), part)
    wanted = asked.select("part", F.explode("terms").alias("term")).distinct()
    found = index.blocks.where("term <> ''").join(wanted.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    blocks = index.blocks.join(wanted.join(df, "term"), "term").select("shard", "part", "term", "df", "n", "top_tf", "low_len", "pos", "tf")
    lengths = index.blocks.where("term = ''").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks_of_queries - 1))))
    blocks = blocks.unionByName(lengths.select("shard", "part", "term", F.lit(0).cast("long").alias("df"), "n", "top_tf", "low_len", "pos", "tf"))
    # Every query meets every shard: a row of its terms for each.
    asked = asked.join(lengths.select(F.col("shard").alias("of"), F.col("part").alias("p")), F.col("part") == F.col("p"))
    asked = asked.select("qid", "terms", F.col("of").alias("shard"), F.col("p").alias("part"))
    if allowed is not None:
        asked = asked.join(allowed.select("qid", "shard", "allowed"), ["qid", "shard"])
    kind = dict(queries.dtypes)["qid"]
    hits = blocks.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(run, f"qid {kind}, shard long, pos int, {out}")
    return hits.join(index.docs.select("shard", "pos", "chunk_id"), ["shard", "pos"])


def bm25(queries: DataFrame, index: Index, k: int, digits: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, score, read of each shard's k best by Okapi BM25 over any matching term; read: postings that the shard went through for the query."""
    count, mean = index.totals()

    def weigh(df, tf, length):
        return np.log(1 + (count - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))

    return _meet(index, queries, _score_shard(k, digits, weigh), "score double, read long", allowed)


def overlap(queries: DataFrame, index: Index, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, score, read of each shard's k best by the number of the query's terms that they hold."""

    def weigh(df, tf, length):
        return np.minimum(tf, 1).astype(np.float64)

    return _meet(index, queries, _score_shard(k, None, weigh), "score double, read long", allowed)


def matches(queries: DataFrame, index: Index, allowed: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, tf: chunks that hold every term of the query."""
    return _meet(index, queries, _match_shard, "tf long", allowed).select("qid", "chunk_id", "tf")
