"""A stored vector index: an inverted file of coarse cells with product-quantised residuals.

build() fits cells and codebooks on a bounded sample, then reads the table once: a
row gets the cell whose centre is nearest, one byte per subspace for what is left
of it, and the length of what the bytes miss. Rows lie partitioned by cell, and
before that by columns such as the organization; within a partition they are sorted
by the columns that searches filter by, so that partitions and row groups are
pruned by the payload filter.

search() sends queries to the groups that hold the cells nearest to them, scores the
codes of those cells, and rescores a shortlist with the stored vectors beside them; a
tile, a few groups with a block of queries, sends on its k best. With exact=True it goes
on: every row of any cell whose score by single-precision products of the stored vectors may
still reach the k-th best score found is rescored too, which gives exactly the hits of a full search.

Scores are cosines; ties go to the smaller chunk_id. Null vectors are not indexed;
zero vectors have score 0 with everything; a vector of another size is an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import retrieve
from corpusloom.operators.retrieve import ranked
from corpusloom.session import new_folder, stored

#: Bound on the rows that cells and codebooks are fitted on, and on the number of cells.
SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
CODEWORDS = 256
#: Components of a subspace.
WIDTH = 4
STEPS = 12
#: Least share of the cells that a query probes, and rescored rows for each hit in a group of cells.
PROBE_SHARE = 0.25
SHORTLIST = 10
#: build() takes as many probes as find this share of the NEAR nearest rows of sampled rows.
TARGET_RECALL = 0.97
NEAR = 10
TRIED = 256
#: Rows of a group of cells. A shortlist is made of a group, and one group at a time is held as arrays.
ROW_BLOCK = 20_000
#: Queries and groups of a tile, which meet in one task. Both grow to these bounds once there are more than TILES tiles, as a
#: row is sent once for every block of queries, and a query once for every row of tiles.
QUERY_BLOCK, MOST_QUERIES = 2000, 8000
MOST_GROUPS = 4
TILES = 32
#: Rows compared with all centres, and queries compared with a group, at a time.
SLICE, QUERY_SLICE = 256, 128
#: The best of a row of scores are looked for among the maxima of so many scores each.
FOLD = 16
SLACK = 1e-5


def k_means(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """At most k centres of the rows of x; the same on every run."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(steps):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in slices of bounded size."""
    own = 0.5 * (centres * centres).sum(axis=1)
    parts = [np.argmax(x[i : i + SLICE] @ centres.T - own, axis=1) for i in range(0, len(x), SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def normed(vectors: Sequence, dim: int) -> np.ndarray:
    """Rows at unit length; zero rows stay."""
    if any(len(v) != dim for v in vectors):
        raise ValueError(f"a vector is not of size {dim}")
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), dim)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


@dataclass(frozen=True)
class Codec:
    """centres: a row per cell. books: for each subspace its codewords; the last may be narrower than the others. probes: see calibrated()."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int = 1

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i : i + WIDTH] for i in range(0, self.dim, WIDTH)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the lengths of what the codes miss."""
        cells = nearest(x, self.centres)
        rest = x - self.centres[cells]
        codes = np.stack([nearest(p, b) for p, b in zip(self.parts(rest), self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return cells, codes, np.linalg.norm(rest - back, axis=1)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes say of the rows."""
        return self.centres[cells] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def nearest_cells(self, v: np.ndarray) -> np.ndarray:
        """All cells, the nearest to a vector first."""
        return np.argsort(0.5 * (self.centres * self.centres).sum(axis=1) - self.centres @ v, kind="stable")

    def to_json(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books], "probes": self.probes})

    @staticmethod
    def from_json(text: str) -> Codec:
        raw = json.loads(text)
        return Codec(np.array(raw["centres"]), [np.array(b) for b in raw["books"]], raw["probes"])


def fit(points: DataFrame, cells: int, rows: int = SAMPLE_ROWS) -> Codec:
    """Cells and codebooks from at most `rows` vectors, chosen by the hash of their ids."""
    sample = points.where(F.col("vector").isNotNull()).select("chunk_id", "vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows)
    got = [r.vector for r in sample.select("vector").collect()]
    if not got:
        raise ValueError("an index needs at least one vector")
    x = normed(got, len(got[0]))
    centres = k_means(x, cells)
    rest = x - centres[nearest(x, centres)]
    books = [k_means(rest[:, i : i + WIDTH], CODEWORDS, seed=i + 1) for i in range(0, x.shape[1], WIDTH)]
    return Codec(centres, books, calibrated(x, centres))


def calibrated(x: np.ndarray, centres: np.ndarray) -> int:
    """The cells to look into so that TARGET_RECALL of the NEAR nearest rows of sampled rows are found, by brute force on the sample.

    Among all rows of the table the nearest lie nearer, in cells no farther off.
    """
    codec, at = Codec(centres, []), nearest(x, centres)
    ranks = []
    for i in np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(np.int64)):
        score = x @ x[i]
        score[i] = -np.inf
        place = np.empty(len(centres), dtype=np.int64)
        place[codec.nearest_cells(x[i])] = np.arange(len(centres))
        ranks += np.sort(place[at[np.argsort(-score, kind="stable")[: min(NEAR, len(x) - 1)]]]).tolist()
    return 1 + int(np.quantile(ranks, TARGET_RECALL, method="higher")) if ranks else 1


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, chunk_id, vector, codes, miss and the payload. cells: cell, n."""

    rows: DataFrame
    cells: DataFrame
    codec: Codec


def build(
    points: DataFrame, path: str | None = None, *, cells: int | None = None, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS
) -> VectorIndex:
    """Write the index of points (chunk_id, vector, payload...) to a folder, by default a new shared one, and open it.

    cells: by default half the square root of the number of rows, MAX_CELLS at most.
    """
    spark = points.sparkSession
    path = path or new_folder(spark, "vectors")
    codec = fit(points, cells or max(1, min(MAX_CELLS, math.isqrt(points.count()) // 2)), sample_rows)
    coded = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("miss", T.DoubleType())])

    @F.pandas_udf(coded)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            at, codes, miss = codec.encode(normed(vectors.tolist(), codec.dim))
            yield pd.DataFrame({"cell": at.astype(np.int32), "codes": [c.tobytes() for c in codes], "miss": miss})

    rows = points.where(F.col("vector").isNotNull()).withColumn("_c", encode("vector")).select("*", "_c.*").drop("_c")
    # Rows of a cell come together, a large cell in several files.
    rows = rows.hint("rebalance", *map(F.col, (*partition_by, "cell"))).sortWithinPartitions(*partition_by, "cell", *cluster_by)
    rows.write.partitionBy(*partition_by, "cell").parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{path}/cells")
    spark.createDataFrame([(codec.to_json(),)], "codec string").write.parquet(f"{path}/codec")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that build() wrote."""
    codec = Codec.from_json(spark.read.parquet(f"{path}/codec").first().codec)
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), codec)


# --- search --------------------------------------------------------------------------


@dataclass(frozen=True)
class _Groups:
    """Cells dealt into groups of about ROW_BLOCK rows: a cell's first group, and over how many its rows are spread."""

    first: np.ndarray
    spread: np.ndarray

    @property
    def n(self) -> int:
        return int((self.first + self.spread).max(initial=1))


def _groups(index: VectorIndex) -> _Groups:
    """At most MAX_CELLS counts are read."""
    cells = len(index.codec.centres)
    first, spread = np.zeros(cells, dtype=np.int64), np.ones(cells, dtype=np.int64)
    group = held = 0
    for r in sorted(index.cells.collect(), key=lambda r: r.cell):
        if held and held + r.n > ROW_BLOCK:
            group, held = group + 1, 0
        first[r.cell], spread[r.cell] = group, max(1, math.ceil(r.n / ROW_BLOCK))
        group, held = (group + int(spread[r.cell]), 0) if spread[r.cell] > 1 else (group, held + r.n)
    return _Groups(first, spread)


def _tiling(groups: int, queries: int) -> tuple[int, int]:
    """Groups of a tile, and blocks of queries."""
    blocks = max(1, math.ceil(queries / MOST_QUERIES), min(math.ceil(queries / QUERY_BLOCK), math.ceil(TILES / groups)))
    return min(MOST_GROUPS, max(1, groups * blocks // TILES)), blocks


def _probes(codec: Codec, groups: _Groups, probes: int) -> Callable[[Column], Column]:
    """The nearest cells of a query, in numbers and as bits, and the groups that hold rows of them."""
    held = np.zeros((len(groups.first), groups.n), dtype=bool)
    for c, (first, spread) in enumerate(zip(groups.first, groups.spread, strict=True)):
        held[c, first : first + spread] = True

    @F.pandas_udf("struct<cells:array<int>,bits:binary,groups:array<int>>")
    def run(vectors: pd.Series) -> pd.DataFrame:
        at = [codec.nearest_cells(v)[:probes].astype(np.int32) for v in normed(vectors.tolist(), codec.dim)]
        bits = []
        for cells in at:
            some = np.zeros(len(held), dtype=bool)
            some[cells] = True
            bits.append(np.packbits(some).tobytes())
        return pd.DataFrame({"cells": at, "bits": bits, "groups": [np.flatnonzero(held[cells].any(axis=0)).astype(np.int32) for cells in at]})

    return run


def _folds(rows: int, k: int) -> int:
    """How many scores a maximum is taken of, so that there are enough maxima."""
    return max(1, min(FOLD, rows // (4 * k)))


def _reaching(near: np.ndarray, k: int, fold: int, lowered: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that reach the bound of their row: the k-th of the maxima of `fold` scores each, -inf for fewer, lowered."""
    table = near.reshape(len(near), fold, -1)
    most = table.max(axis=1)
    width = most.shape[1]
    bound = np.partition(most, width - k, axis=1)[:, width - k] if width >= k else np.full(len(near), -np.inf)
    bound = np.maximum(lowered(bound), np.finfo(np.float32).min)
    query, at = np.nonzero(most >= bound[:, None])
    pair, part = np.nonzero(table[query, :, at] >= bound[query, None])
    return query[pair], part * width + at[pair]


def _k_best(query: np.ndarray, score: np.ndarray, order: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of the k best of each query, ties by order. query: ascending numbers from 0."""
    count = np.bincount(query)
    place = np.arange(len(query)) - (np.cumsum(count) - count)[query]
    at = np.arange(len(query))
    if count.max(initial=0) > k:
        # What is under the k-th by more than rounding can lift is left out before it is sorted.
        table = np.full((len(count), count.max()), -np.inf)
        table[query, place] = score
        least = np.partition(table, -k, axis=1)[:, -k] - (0.0 if digits is None else 10.0**-digits)
        at = at[score >= least[query]]
    shown = retrieve.rounded(score[at], digits)
    best = np.lexsort((order[at], -shown, query[at]))
    at, shown = at[best], shown[best]
    count = np.bincount(query[at])
    keep = np.arange(len(at)) - (np.cumsum(count) - count)[query[at]] < k
    return at[keep], shown[keep]


@dataclass(frozen=True)
class _Rows:
    """Rows of a group in order of cells: stored vectors at unit length, places in order of ids, and what is multiplied, the stored vectors or what the codes say of them."""

    x: np.ndarray
    order: np.ndarray
    cell: np.ndarray
    compared: np.ndarray

    def near(self, part: np.ndarray, probed: np.ndarray | None, fold: int) -> np.ndarray:
        """Scores of queries in single precision, -inf for rows of cells that a query does not look into and for columns after the last row."""
        part, n = part.astype(np.float32), len(self.cell)
        out = np.full((len(part), -(-n // fold) * fold), -np.inf, dtype=np.float32)
        if probed is None:
            out[:, :n] = part @ self.compared.T
            return out
        own, begins = np.unique(self.cell, return_index=True)
        for c, low, high in zip(own, begins, np.append(begins[1:], n), strict=True):
            some = np.flatnonzero(probed[:, c])
            out[some, low:high] = part[some] @ self.compared[low:high].T
        return out

    def best(self, part: np.ndarray, probed: np.ndarray | None, least: np.ndarray, k: int, keep: int | None, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and rounded scores of the k best for each query, by the stored vectors: of at least the `keep` best by codes in the probed cells, or of all rows."""
        fold = _folds(len(self.cell), keep or k)
        near = self.near(part, probed, fold)
        # Of all rows: off by rounding to `digits`, and by single precision on either side.
        off = SLACK + self.x.shape[1] * 2.0**-21 + (0.0 if digits is None else 10.0**-digits)
        query, row = _reaching(near, keep or k, fold, (lambda bound: bound) if keep else lambda bound: np.maximum(bound, least) - off)
        # Many rows alike: one query at a time.
        crowded = np.bincount(query, minlength=len(part)) > 4 * (keep or k) + 64
        if crowded.any():
            few = ~crowded[query]
            pairs = [(query[few], row[few])]
            for i in np.flatnonzero(crowded):
                at = row[query == i]
                best = retrieve.best_of(near[i, at].astype(np.float64), keep, self.order[at])[0] if keep else retrieve.best_of(self.x[at] @ part[i], k, self.order[at], digits)[0]
                pairs.append((np.full(len(best), i), np.sort(at[best])))
            query, row = (np.concatenate(side) for side in zip(*pairs, strict=True))
            sort = np.argsort(query, kind="stable")
            query, row = query[sort], row[sort]
        at, shown = _k_best(query, np.einsum("ij,ij->i", self.x[row], part[query]), self.order[row], k, digits)
        return query[at], row[at], shown


def _search_tile(codec: Codec, k: int, keep: int | None, digits: int | None) -> Callable:
    """The k best rows of a tile for each query: see _Rows.best()."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        asked, found, scores, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        # In order, so that the same products are made on every run.
        rows, queries = rows.sort_by([(name, "ascending") for name in ("grp", "cell", "chunk_id")]), queries.sort_by("qid")
        if rows.num_rows and queries.num_rows:
            order, group, vectors = retrieve.id_order(rows, "chunk_id"), retrieve.column(rows, "grp").to_numpy(), retrieve.column(rows, "vector")
            q = retrieve.matrix(retrieve.column(queries, "query_vector"), codec.dim)
            usable = np.flatnonzero(np.isfinite(q).all(axis=1))
            least = retrieve.column(queries, "least").to_numpy(zero_copy_only=False)
            bits = None if keep is None else np.frombuffer(b"".join(queries["bits"].to_pylist()), dtype=np.uint8).reshape(len(q), -1)
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            for low, high in zip(begins, np.append(begins[1:], len(group)), strict=True):
                held = _held(codec, rows.slice(low, high - low), retrieve.matrix(vectors.slice(low, high - low), codec.dim), order[low:high], keep is not None)
                if not len(held[1].cell):
                    continue
                for begin in range(0, len(usable), QUERY_SLICE):
                    at = usable[begin : begin + QUERY_SLICE]
                    probed = None if bits is None else np.unpackbits(bits[at], axis=1).astype(bool)
                    query, row, shown = held[1].best(q[at], probed, least[at], k, keep, digits)
                    asked.append(at[query])
                    found.append(low + held[0][row])
                    scores.append(shown)
                    places.append(held[1].order[row])
        asked, found, scores, places = (np.concatenate(x) for x in (asked, found, scores, places))
        sort = np.argsort(asked, kind="stable")
        best, shown = _k_best(asked[sort], scores[sort], places[sort], k, None)
        at = sort[best]
        return pa.table({"qid": queries["qid"].take(pa.array(asked[at])), "chunk_id": rows["chunk_id"].take(pa.array(found[at])), "score": shown})

    return run


def _held(codec: Codec, rows: pa.Table, x: np.ndarray, order: np.ndarray, by_codes: bool) -> tuple[np.ndarray, _Rows]:
    """A group's rows that have a direction, by number, and as arrays."""
    at = np.flatnonzero(np.isfinite(x).all(axis=1))
    cell = retrieve.column(rows, "cell").to_numpy()[at]
    compared = codec.decode(cell, np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint8).reshape(len(x), -1)[at]) if by_codes else x[at]
    return at, _Rows(x[at], order[at], cell, compared.astype(np.float32))


def _found(index: VectorIndex, asked: DataFrame, rows: DataFrame, groups: _Groups, k: int, keep: int | None, digits: int | None) -> DataFrame:
    """qid, chunk_id, score, rank. asked: qid, query_vector, least, bits, groups; a tile of groups and a block of queries meet in one task."""
    per, blocks = _tiling(groups.n, asked.count())
    first, spread = (F.array(*map(F.lit, x.tolist())) for x in (groups.first, groups.spread))
    at = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("chunk_id"), F.get(spread, F.col("cell")))
    left = rows.select("cell", "chunk_id", "vector", "codes", at.cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    left = left.withColumn("tile", F.floor(F.col("grp") / per).cast("int"))
    tiles = F.array_distinct(F.transform("groups", lambda g: F.floor(g / per).cast("int")))
    right = asked.select("qid", "query_vector", "least", "bits", F.explode(tiles).alias("tile"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("part"))
    out = T.StructType([asked.schema["qid"], rows.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    hits = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(_search_tile(index.codec, k, keep, digits), out)
    return ranked(hits, k, F.desc("score"), F.col("chunk_id"))


def search(
    queries: DataFrame, index: VectorIndex, k: int, *, where: Column | None = None, probes: int | None = None, shortlist: int = SHORTLIST, exact: bool = False, digits: int | None = None
) -> DataFrame:
    """qid, chunk_id, score, rank of the k best by cosine. queries: qid, query_vector. where: a condition on the payload.

    probes: cells that a query looks into, by default as many as build() found that
    the sample needs, and PROBE_SHARE of all at least.
    """
    n = len(index.codec.centres)
    probes = min(n, probes or max(index.codec.probes, math.ceil(PROBE_SHARE * n)))
    rows = index.rows if where is None else index.rows.where(where)
    groups = _groups(index)
    asked = queries.where(F.col("query_vector").isNotNull()).withColumn("_p", _probes(index.codec, groups, probes)("query_vector"))
    asked = stored(asked.select("qid", "query_vector", F.lit(None).cast("double").alias("least"), "_p.cells", "_p.bits", "_p.groups"), "probes")
    probed = rows
    if probes < n:
        # As many numbers as there are cells, so that the scan is narrowed to the partitions asked for.
        probed = rows.where(F.col("cell").isin(sorted(r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())))
    hits = _found(index, asked, probed, groups, k, k * shortlist, digits)
    if not exact:
        return hits
    # The k-th best score, if there are as many; every row that may reach it is looked at.
    last = stored(hits, "approximate-hits").where(F.col("rank") == k).select("qid", F.col("score").alias("_least"))
    every = asked.join(last, "qid", "left").select(
        "qid", "query_vector", F.coalesce("_least", F.lit(-2.0)).alias("least"), "bits", F.sequence(F.lit(0), F.lit(groups.n - 1)).alias("groups")
    )
    return _found(index, every, rows, groups, k, None, digits)
