"""Nearest neighbours by largest inner product: a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks is one cell of a
grid, worked by one task that holds just these two blocks.  Within a cell, tiles of
int8 products bound every inner product from below and above (the quantisation
residuals are known exactly); only pairs whose upper bound reaches the k-th best so
far are recomputed from the original vectors in double precision and go through the
heap of their query.  The lists of a query from all cells are then merged by heaps, a
fixed number at a time.  The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import with_row_key

QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 8_192
TILE = 256, 4_096
#: Lists that one merge takes at most.
FAN_IN = 64
NAMES = ["query_id", "j", "vec_ids", "scores"]
SCHEMA = "query_id long, j long, vec_ids array<long>, scores array<double>"


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale by row, norm of what they stand for, norm of the residual."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    stands = q * scale[:, None]
    return q, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def distinct_enough(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of which fewer than k + 1 equal vectors have a smaller id; no other can be among k nearest."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    return np.sort(order[rank <= k])


def search_cell(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best (score, id) among the candidates, best first, ties to the smaller id."""
    keep = distinct_enough(ids, c, k)
    ids, c = ids[keep], c[keep]
    q8, q_scale, q_norm, q_rest = quantise(q)
    c8, c_scale, c_norm, c_rest = quantise(c)
    c_full = c_norm + c_rest
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    for a in range(0, len(q), TILE[0]):
        rows = slice(a, a + TILE[0])
        best = np.full(len(q8[rows]), -np.inf)
        for b in range(0, len(c), TILE[1]):
            cols = slice(b, b + TILE[1])
            # Products of int8 sum exactly in float32 up to a thousand components, in float64 beyond.
            kind = np.float32 if q.shape[1] <= 1024 else np.float64
            about = (q8[rows].astype(kind) @ c8[cols].astype(kind).T).astype(np.float64)
            about *= q_scale[rows, None] * c_scale[cols]
            error = q_rest[rows, None] * c_full[cols] + q_norm[rows, None] * c_rest[cols]
            error += 1e-12 * (q_norm[rows, None] * c_norm[cols] + 1)
            own = query_ids[rows, None] == ids[cols]
            about[own] = -np.inf
            if about.shape[1] >= k:
                low = np.partition(about - error, about.shape[1] - k, axis=1)[:, -k]
                best = np.maximum(best, low)
            i, j = np.nonzero((about + error >= best[:, None]) & ~own)
            exact = np.empty(len(i))
            for s in range(0, len(i), 1 << 16):
                some = slice(s, s + (1 << 16))
                exact[some] = (q[a + i[some]].astype(np.float64) * c[b + j[some]].astype(np.float64)).sum(axis=1)
            for row, score, vec in zip((a + i).tolist(), exact.tolist(), (-ids[b + j]).tolist(), strict=True):
                heap = heaps[row]
                if len(heap) < k:
                    heapq.heappush(heap, (score, vec))
                elif (score, vec) > heap[0]:
                    heapq.heapreplace(heap, (score, vec))
            full = [(n, h[0][0]) for n, h in enumerate(heaps[rows]) if len(h) == k]
            for n, score in full:
                best[n] = max(best[n], score)
    return [[(s, -v) for s, v in sorted(h, reverse=True)] for h in heaps]


def merge_lists(lists: list[list[tuple[float, int]]], k: int) -> list[tuple[float, int]]:
    """The k best of lists that are each best first."""
    merged = heapq.merge(*lists, key=lambda x: (-x[0], x[1]))
    return [x for x, _ in zip(merged, range(k), strict=False)]


def _rows(query_ids: list[int], j: list[int], found: list[list[tuple[float, int]]]) -> pa.Table:
    return pa.table(
        [
            pa.array(query_ids, pa.int64()),
            pa.array(j, pa.int64()),
            pa.array([[v for _, v in x] for x in found], pa.list_(pa.int64())),
            pa.array([[s for s, _ in x] for x in found], pa.list_(pa.float64())),
        ],
        NAMES,
    )


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of each query row by inner product, exactly.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller
    vec_id; all candidates if there are fewer than k.

    Defined cases: rows with a null id, or a vector that is null, zero or holds null or
    non-finite components, take no part; vectors of different lengths are not compared;
    of several rows with a query's id the least vector (in array order) is the query,
    and none of them is its candidate; other repeated rows are a candidate each; other
    columns are ignored; an empty table or query set gives an empty result.
    """
    vectors, key = with_row_key(vectors)
    base = vectors.filter(is_query.isNotNull() & F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    # Candidates are dealt by their place in the files: rows that share an id, or all they hold, go to many blocks.
    place = F.xxhash64(*key, F.lit(7)).alias("place")
    base = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"), place)
    queries = base.filter("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    candidates = base.withColumn("dim", F.size("v"))
    n = candidates.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m"))
    grid = n.select(
        "dim", F.greatest(F.ceil(F.col("m") / QUERY_BLOCK), F.lit(1)).cast("int").alias("rows"), F.ceil(F.col("n") / CANDIDATE_BLOCK).cast("int").alias("cols")
    ).filter("m > 0")
    # A row for each length of vector that occurs.
    q_side = queries.join(F.broadcast(grid), "dim").select(
        "dim", F.pmod(F.xxhash64("id"), "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "id", "v"
    )
    c_side = candidates.join(F.broadcast(grid), "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod("place", "cols").cast("int").alias("j"), "id", "v"
    )

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        left, right = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not left.num_rows or not right.num_rows:
            return _rows([], [], [])
        ids = left.column("id").to_numpy()
        found = search_cell(ids, _matrix(left), right.column("id").to_numpy(), _matrix(right), k)
        return _rows(ids.tolist(), [key[2].as_py()] * len(ids), found)

    both = q_side.withColumn("asks", F.lit(True)).unionByName(c_side.withColumn("asks", F.lit(False)))
    lists = both.groupBy("dim", "i", "j").applyInArrow(cell, SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        found = [list(zip(s, v, strict=True)) for s, v in zip(table.column("scores").to_pylist(), table.column("vec_ids").to_pylist(), strict=True)]
        return _rows(table.column("query_id")[:1].to_pylist(), [table.column("j")[0].as_py() // FAN_IN], [merge_lists(found, k)])

    width = grid.agg(F.max("cols")).first()[0] or 0
    while width > 1:
        lists = lists.groupBy("query_id", F.floor(F.col("j") / FAN_IN).alias("g")).applyInArrow(merge, SCHEMA)
        width = -(-width // FAN_IN)
    out = lists.select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))

