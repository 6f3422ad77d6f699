"""Exact top-k by inner product: a Voronoi join with bounds from group summaries.

Pivots, about the square root of the rows in number and chosen far apart from a
bounded sample, cut rows and queries into cells by nearest pivot. A cell of
queries is summed up by its radius r, the largest norm m, and a score t that k
other rows are sure to reach for each of its queries. For a query q of the cell
of pivot p and any row x, q.x <= min(p.x + r |x|, m |x|), so x can add to the
answer only if that bound reaches t. t is the best of two: the k-th score of the
cell's worst query among the sample, and, over all cells of rows, the score that
the rows within the (k+1)-th distance d of a pivot o reach, p.o - r |o| - m d.

Cells of queries are packed into groups of bounded size, and a cell larger than a
group is split. A query goes to one group; a row is replicated to the groups that
hold a cell whose bound it reaches. There they meet in blocks of bounded numbers of
queries and rows, and the blocks' best are merged. Queries are sent once for each
block of their group's rows and rows once for each group that needs them: where
nothing can be pruned, the join is that of blocks, whose work is the product of
both sides.

Nulls and odd rows: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; a null id takes no
part; rows with the query's own id are not its candidates; repeated rows are
each candidates and a repeated query id is answered once; extra columns are
ignored; an empty table gives an empty result. Scores are 64-bit integers; vectors
whose products do not fit are not supported.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

K = 20
SCALE = 64
#: Most pivots; more would tighten bounds and change no result.
MOST_PIVOTS = 4096
#: Rows of the sample for each pivot.
SAMPLED = 4
#: Rows that meet in one local task, and queries multiplied at a time there.
QUERY_BLOCK = 8192
DATA_BLOCK = 8192
SOLVED_TOGETHER = 256
#: float64 products and sums are exact below this.
EXACT = 2.0**53


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))


#: Stands for an endless distance; finite, so that a zero vector times it is zero.
FAR = 1e150
#: Rows that meet all pivots, or the sample, at a time, so that a batch needs bounded memory however many pivots there are.
SLICE = 256

#: Relative slack on bounds worked out in floating point.
SLACK = 1e-9


def _spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those chosen before it; fewer if no other is left."""
    points = sample.astype(np.float64)
    norms = (points**2).sum(axis=1)
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < pivots:
        last = points[chosen[-1]]
        far = np.minimum(far, np.maximum(norms + last @ last - 2.0 * (points @ last), 0.0))
        best = int(far.argmax())
        if far[best] <= 0.0:
            break
        chosen.append(best)
    return sample[chosen]


def _tour(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest that is left, so that neighbours share groups."""
    points = pivots.astype(np.float64)
    norms, left, order = (points**2).sum(axis=1), np.ones(len(points), dtype=bool), [0]
    left[0] = False
    while left.any():
        far = np.where(left, norms - 2.0 * (points @ points[order[-1]]), np.inf)
        order.append(int(far.argmin()))
        left[order[-1]] = False
    return order


def _assign(pivots: np.ndarray) -> Callable:
    """Adds each vector's nearest pivot, its distance, and the vector's norm."""
    dim = pivots.shape[1]
    squares = (pivots.astype(np.float64) ** 2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = _matrix(rows["v"], dim)
            norm, near, gap = _norms(v), np.zeros(len(v), dtype=np.int64), np.zeros(len(v))
            for i in range(0, len(v), SLICE):
                part = slice(i, i + SLICE)
                far = (norm[part] ** 2)[:, None] + squares[None, :] - 2.0 * _products(v[part], pivots)
                near[part] = far.argmin(axis=1)
                gap[part] = np.sqrt(np.maximum(far.min(axis=1), 0.0))
            yield pd.DataFrame({"id": rows["id"], "v": rows["v"], "q": rows["q"], "cell": near.astype(np.int32), "gap": gap, "norm": norm})

    return run


def _reached(sample: np.ndarray, k: int) -> Callable:
    """cell, sure: the score that k rows of the sample beside its own are sure to reach, for each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v, n = _matrix(rows["v"], sample.shape[1]), len(sample)
            sure = np.full(len(v), -FAR)
            for i in range(0, len(v) if n > k else 0, SLICE):
                # One of the k + 1 best may be the query's own row.
                sure[i : i + SLICE] = np.partition(_products(v[i : i + SLICE], sample), n - k - 1, axis=1)[:, n - k - 1]
            yield pd.DataFrame({"cell": rows["cell"], "sure": sure})

    return run


def _groups_of(batch: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, least: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows, and the groups that need them."""
    x = _matrix(batch["v"], pivots.shape[1])
    at, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(x), SLICE):
        part = x[i : i + SLICE]
        dot, size = _products(part, pivots).astype(np.float64), _norms(part)[:, None]
        slack = SLACK * (np.abs(dot) + size * (radius + norm + 1)[None, :] + 1)
        wanted = np.minimum(dot + size * radius[None, :], size * norm[None, :]) + slack >= least[None, :]
        rows, found = np.nonzero(np.stack([wanted[:, cells].any(axis=1) for cells in groups], axis=1))
        at.append(rows + i)
        to.append(found)
    return np.concatenate(at), np.concatenate(to)


def pack(counts: list[tuple[int, int]], most: int) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """Groups of cells (cell, queries) taken in the given order, and for each cell its first group and the number of groups it is split into."""
    groups, place, held = [], {}, most
    for cell, n in counts:
        parts = -(-n // most)
        if parts > 1:
            place[cell] = (len(groups), parts)
            groups += [[cell]] * parts
            held = most
        else:
            if held + n > most:
                groups.append([])
                held = 0
            groups[-1].append(cell)
            place[cell] = (len(groups) - 1, 1)
            held += n
    return groups, place


def _solve(k: int, dim: int) -> Callable:
    """Top k of a block of rows for each query of a block."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        asked, found, scored = [], [], []
        if len(queries) and len(data):
            data = data.sort_values("id", kind="stable")
            ids, rows = data["id"].to_numpy(), _matrix(data["v"], dim)
            for first in range(0, len(queries), SOLVED_TOGETHER):
                part = queries.iloc[first : first + SOLVED_TOGETHER]
                for q, s in zip(part["id"].to_numpy(), _products(_matrix(part["v"], dim), rows), strict=True):
                    at = np.nonzero(ids != q)[0]
                    s = s[at]
                    if len(s) > k:
                        floor = np.partition(s, len(s) - k)[len(s) - k]
                        keep = np.nonzero(s >= floor)[0]
                        at, s = at[keep], s[keep]
                    # ids rise with the position, so a stable sort settles ties by id.
                    best = np.argsort(-s, kind="stable")[:k]
                    asked.append(np.full(len(best), q))
                    found.append(ids[at[best]])
                    scored.append(s[best])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"query_id": join(asked), "vec_id": join(found), "score": join(scored)})

    return run


@dataclass
class Plan:
    """Placed rows, groups of query cells, and how many rows each group needs."""

    placed: DataFrame
    dim: int
    count: int
    queries: int
    pivots: np.ndarray
    bounds: tuple[np.ndarray, np.ndarray, np.ndarray]
    groups: list[list[int]]
    place: dict[int, tuple[int, int]]
    needed: list[int]

    def pruned(self) -> float:
        """Share of all pairs of group and row that the bounds leave out."""
        return 1.0 - sum(self.needed) / max(self.count * len(self.groups), 1)


def plan(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, pivots: int | None = None, query_block: int = QUERY_BLOCK) -> Plan | None:
    """Cells, summaries, bounds and groups; None without rows or queries."""
    rows = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull())
    rows = stored(rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("q")), "vectors")
    count, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return None
    wanted = pivots or min(MOST_PIVOTS, math.isqrt(count) + 1)
    # A bounded number of rows of distinct ids, the same on every run.
    taken = rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(max(SAMPLED * wanted, 4 * k)).collect()
    sample = _matrix(pd.Series([r.v for r in {r.id: r for r in taken}.values()]), dim)
    centres = _spread(sample, wanted)
    n = len(centres)
    placed = stored(rows.mapInPandas(_assign(centres), "id long, v array<long>, q boolean, cell int, gap double, norm double"), "knn-cells")
    # Rows of one id count once: all of them may be the query's own.
    inner = np.full(n, FAR)
    nearest = placed.groupBy("cell", "id").agg(F.min("gap").alias("gap"))
    nearest = nearest.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("gap", "id")))
    for r in nearest.where(F.col("r") == k + 1).collect():
        inner[r.cell] = r.gap * (1 + SLACK) + SLACK
    asked = placed.where("q")
    radius, norm, sure, counts = np.full(n, -FAR), np.zeros(n), np.full(n, -FAR), {}
    for r in asked.groupBy("cell").agg(F.count_distinct("id").alias("n"), F.max("gap").alias("gap"), F.max("norm").alias("norm")).collect():
        radius[r.cell], norm[r.cell], counts[r.cell] = r.gap * (1 + SLACK) + SLACK, r.norm * (1 + SLACK), r.n
    if not counts:
        return None
    for r in asked.select("cell", "v").mapInPandas(_reached(sample, k), "cell int, sure double").groupBy("cell").agg(F.min("sure").alias("sure")).collect():
        sure[r.cell] = r.sure
    far = _norms(centres)
    dots = _products(centres, centres).astype(np.float64)
    by_pivot = dots - np.maximum(radius, 0.0)[:, None] * far[None, :] - norm[:, None] * inner[None, :]
    by_pivot -= SLACK * (np.abs(dots) + 1)
    used = np.isin(np.arange(n), list(counts))
    least = np.where(used, np.maximum(by_pivot.max(axis=1), sure), FAR)
    groups, place = pack([(c, counts[c]) for c in _tour(centres) if c in counts], query_block)
    bounds = (np.maximum(radius, 0.0), norm, least)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(groups), dtype=np.int64)
        for batch in batches:
            total += np.bincount(_groups_of(batch, centres, *bounds, groups)[1], minlength=len(groups))
        yield pd.DataFrame({"group": np.arange(len(groups), dtype=np.int32), "n": total})

    needed = dict(map(tuple, placed.select("v").mapInPandas(sizes, "group int, n long").groupBy("group").agg(F.sum("n")).collect()))
    return Plan(placed, dim, count, sum(counts.values()), centres, bounds, groups, place, [needed.get(g, 0) for g in range(len(groups))])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int | None = None,
    query_block: int = QUERY_BLOCK,
    data_block: int = DATA_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that is_query holds for."""
    p = plan(vectors, is_query, id_col=id_col, vector=vector, k=k, scale=scale, pivots=pivots, query_block=query_block)
    if p is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = [max(1, -(-n // data_block)) for n in p.needed]
    first, parts = (F.array(*[F.lit(p.place.get(c, (0, 1))[i]) for c in range(len(p.pivots))]) for i in (0, 1))
    of_group = F.get(F.array(*[F.lit(b) for b in blocks]), F.col("group"))
    hashed = F.xxhash64("id")
    group = F.get(first, F.col("cell")) + F.pmod(hashed, F.get(parts, F.col("cell")).cast("long")).cast("int")
    # A repeated id is asked once: its rows of smallest vector.
    asked = p.placed.where("q").groupBy("id").agg(F.min(F.struct("v", "cell")).alias("x")).select("id", "x.v", "x.cell")
    asked = asked.withColumn("group", group).select("group", F.explode(F.sequence(F.lit(0), of_group - 1)).alias("dblock"), "id", "v")
    pivots_, bounds, groups = p.pivots, p.bounds, p.groups

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, to = _groups_of(batch, pivots_, *bounds, groups)
            yield pd.DataFrame({"group": to.astype(np.int32), "id": batch["id"].to_numpy()[at], "v": batch["v"].to_numpy()[at]})

    spread = p.placed.select("id", "v").mapInPandas(route, "group int, id long, v array<long>")
    spread = spread.select("group", F.pmod(hashed, of_group.cast("long")).cast("int").alias("dblock"), "id", "v")
    key = ["group", "dblock"]
    best = asked.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(_solve(k, p.dim), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: DuckDB SQL for the query over embeddings.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
