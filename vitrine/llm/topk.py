"""Exact top-k search by Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size, queries likewise; every block of queries meets every
block of candidates once. A block keeps, for each dimension, its candidates sorted by that component. The
queries of a block walk down all lists together, from both ends. Candidates newly seen are scored for every
query still open by one matrix product; a query stops when the best score that an unseen candidate could
still reach, the threshold, is below its k-th. The few best of each block are then merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import stored

#: Rows in a block of candidates and in a block of queries.
CANDIDATES = 8_192
QUERIES = 512
#: Entries of each end of the lists that are walked first; each step is four times as deep.
DEPTH = 16
#: Scores are held between these.
LEAST, MOST = -(2**63), 2**63 - 1


def doubles(vector: Column) -> Column:
    """The components as doubles; null where the vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(1.7976931348623157e308)))
    return F.when(good, x)


def whole_numbers(rows: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of each component, and which rows hold one too large for products in doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(rows * scale)
    limit = np.sqrt(2.0**53 / max(1, rows.shape[1]))
    return out, (np.abs(out) > limit).any(axis=1) if rows.shape[1] else np.zeros(len(rows), bool)


def exact(left: np.ndarray, right: np.ndarray, scale: float) -> np.ndarray:
    """Scores of rows of any size in whole numbers without a bound, then held to 64 bits."""
    step = lambda x: int(x) * int(scale) if abs(x) >= 2.0**60 and scale == int(scale) else int(np.floor(x * scale))
    a, b = (np.array([[step(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (left, right))
    return np.array([[min(max(int(sum(x * y)), LEAST), MOST) for y in b] for x in a], object).reshape(len(a), len(b))


class Best:
    """The best ``k`` candidates of each query so far: places, in the order of ids, and scores."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.place = np.full((queries, k), np.iinfo(np.int64).max)
        self.score = np.full((queries, k), -np.inf)

    def add(self, rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the candidates at ``places`` for the queries ``rows``."""
        bar = self.score[rows, -1]
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        x, y = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        own = rows[x]
        row = np.concatenate([own, np.repeat(rows, self.k)])
        place = np.concatenate([places[y], self.place[rows].ravel()])
        score = np.concatenate([scores[x, y], self.score[rows].ravel()])
        first = np.lexsort((place, -score, row))
        row, place, score = row[first], place[first], score[first]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < self.k
        self.place[row[kept], nth[kept]], self.score[row[kept], nth[kept]] = place[kept], score[kept]


class Lists:
    """Sorted lists of one block of candidates, of whole numbers whose products are exact in doubles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # ids are in order, so a smaller place is a smaller id
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        #: Products made by the last search.
        self.scored = 0

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> Best:
        """The ``k`` best places of each query, without those of its own id."""
        n, best = len(self.ids), Best(len(queries), k)
        low, high = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        seen, open_, depth, self.scored = np.zeros(n, bool), np.arange(len(queries)), min(DEPTH, n), 0
        while len(open_):
            every = 2 * depth >= n or not self.vectors.shape[1]
            met = np.arange(n) if every else np.unique(np.concatenate([self.order[:depth].ravel(), self.order[n - depth :].ravel()]))
            met = met[~seen[met]]
            seen[met] = True
            scores = queries[open_] @ self.vectors[met].T
            self.scored += scores.size
            for i in np.flatnonzero(high[open_] > low[open_]):
                at = np.searchsorted(met, [low[open_[i]], high[open_[i]]])
                scores[i, at[0] : at[1]] = -np.inf
            best.add(open_, met, scores)
            if every:
                break
            reach = np.maximum(queries[open_] * self.sorted[depth], queries[open_] * self.sorted[n - 1 - depth]).sum(axis=1)
            open_, depth = open_[reach >= best.score[open_, -1]], depth * 4
        return best


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, scale: float) -> list[list[tuple[int, int]]]:
    """The ``k`` best candidates of each query as (score, id), best first, ties to the smaller id."""
    first = np.argsort(ids, kind="stable")
    ids, vectors = ids[first], vectors[first]
    q, wide_q = whole_numbers(queries, scale)
    c, wide_c = whole_numbers(vectors, scale)
    out: list[list[tuple[int, int]]] = [[] for _ in own]
    rows, lists = np.flatnonzero(~wide_q), Lists(ids[~wide_c], c[~wide_c])
    best = lists.top(own[rows], q[rows], k)
    for i, place, score in zip(rows.tolist(), best.place, best.score, strict=True):
        out[i] = [(int(x), int(lists.ids[p])) for x, p in zip(score, place, strict=True) if x > -np.inf]
    # rows too large for doubles meet all others in whole numbers
    for x, y in ((np.flatnonzero(wide_q), np.arange(len(ids))), (rows, np.flatnonzero(wide_c))):
        if len(x) and len(y):
            for i, line in zip(x.tolist(), exact(queries[x], vectors[y], scale), strict=True):
                out[i] += [(s, int(ids[j])) for s, j in zip(line, y.tolist(), strict=True) if ids[j] != own[i]]
    return [sorted(r, key=lambda r: (-r[0], r[1]))[:k] for r in out]


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    candidate_rows: int = CANDIDATES, query_rows: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each row of ``queries`` by the inner
    product of scaled whole numbers, ties to the smaller id; all of them if there are fewer.

    Candidates with the query's own id take no part for it. Vectors that are null or hold a null or
    non-finite component take no part, and neither do rows without an id. Only vectors of one length are
    compared. Repeated candidate rows are ranked each; a repeated query row gives its ranks again. Finite
    components of any size take part: what doubles can't multiply exactly is multiplied in whole numbers
    without a bound, and a score outside 64 bits is held at the nearest 64-bit number, where scores tie. An
    empty table of either gives no row; other columns are left out, whatever their names.
    """

    def clean(df: DataFrame) -> DataFrame:
        out = df.select(df[f"`{key}`"].cast("long").alias("id"), doubles(df[f"`{vector}`"]).alias("v"))
        return stored(out.dropna().withColumn("row", F.monotonically_increasing_id()), "vectors")

    q, c = clean(queries), clean(candidates)
    # two counts reach the driver; blocks are dealt by a hash of the row, so equal ids or vectors spread
    nq, nc = (max(1, -(-df.count() // rows)) for df, rows in ((q, query_rows), (c, candidate_rows)))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("id", "v", "row", F.size("v").alias("dims"), block(nq, 1).alias("qb")).select("*", every(nc).alias("cb"))
    c = c.select("id", "v", F.size("v").alias("dims"), block(nc, 2).alias("cb")).select("*", every(nq).alias("qb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            own = left["id"].to_numpy()
            found = search(_matrix(left["v"]), own, _matrix(right["v"]), right["id"].to_numpy(), k, scale)
            for row, i, best in zip(left["row"].to_pylist(), own.tolist(), found, strict=True):
                out["row"] += [row] * len(best)
                out["query_id"] += [i] * len(best)
                out["vec_id"] += [v for _, v in best]
                out["score"] += [s for s, _ in best]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    cell = ["dims", "cb", "qb"]
    found = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    # at most k rows of each block and query arrive here
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)
