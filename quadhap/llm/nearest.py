"""Nearest neighbours by inner product: a block matrix join over int8 vectors with exact error bounds.

Vectors are scaled to int8 row by row. The product of two int8 rows, times their scales, is
off by at most ``|eq| |c| + |q'| |ec|``, with the lengths of the actual rounding errors eq, ec
and of the vectors. In a tile of query and candidate blocks, the k-th largest lower bound of
a query is a floor; candidates whose upper bound is under it cannot be among its k nearest.
The rest are computed again in double precision and merged by a heap per query. So the result
is exact.

Queries are the rows the caller states, cut into blocks of ``block`` rows; candidates are
dealt over ``slices`` tasks per query block, and each task keeps k rows per query, so that
shuffles carry k rows per query and task. Of vectors that occur many times only the k+1
smallest ids can be among anyone's k nearest; the others are folded before the join.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows with a null id; repeated rows of one id count once, with the first vector
in array order; ties go to the smaller id; vectors of another length than a query's are no
candidates for it; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
BLOCK = 1024
TILE = 2048
#: Candidates one task holds at most, about.
SLICE_ROWS = 1 << 16
OUT = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, vector`` (doubles) of rows that can take part, one per id."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(whole).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(v).alias("vector"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the rounding errors and of the rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1), np.linalg.norm(x, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added in component order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def tile_survivors(qa, sa, ea, na, qb, sb, eb, nb, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile whose upper bound reaches the query's floor, and the raised floors. Products of int8 are below 2**14, so float32 sums of up to 1024 of them are exact; longer rows are added up in double."""
    kind = np.float32 if qa.shape[1] <= 1024 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    slack = ea[:, None] * nb[None, :] + (na + ea)[:, None] * eb[None, :]
    slack += 1e-12 * (na[:, None] * nb[None, :]) * qa.shape[1]
    if product.shape[1] >= k:
        low = product - slack
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
    i, j = np.nonzero(product + slack >= floor[:, None])
    return i, j, floor


def search_block(q_ids: np.ndarray, q: np.ndarray, candidates, k: int):
    """The k best of a stream of candidate (ids, rows) for a block of queries: heaps of (score, -id)."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    qa, sa, ea, na = quantise(q)
    for ids, rows in candidates:
        # the query itself may stand in the tile, so one more candidate must beat the floor
        i, j, floor = tile_survivors(qa, sa, ea, na, *quantise(rows), k + 1, floor)
        other = q_ids[i] != ids[j]
        i, j = i[other], j[other]
        score = exact_products(q[i], rows[j])
        for row, s, c in zip(i.tolist(), score.tolist(), ids[j].tolist()):
            heap = heaps[row]
            if len(heap) < k:
                heapq.heappush(heap, (s, -c))
            elif (s, -c) > heap[0]:
                heapq.heapreplace(heap, (s, -c))
        for row in set(i.tolist()):
            if len(heaps[row]) == k:
                floor[row] = max(floor[row], heaps[row][0][0])
    return heaps


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, slices: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every usable row that ``is_query`` (a condition on ``id``) picks, its k nearest among all other rows."""
    rows = usable(vectors)
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    slices = slices or max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, -(-n // SLICE_ROWS))
    blocks = max(1, -(-n_queries // block))
    same = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth")
    number = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    chosen = rows.where(is_query).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("qb"), F.explode(number(slices)).alias("cs"), "id", "vector")
    against = few.select(F.explode(number(blocks)).alias("qb"), F.pmod(F.xxhash64(F.lit("slice"), "id"), F.lit(slices)).alias("cs"), "id", "vector")

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        q_size, c_size = (np.array([len(v) for v in t.column("vector").to_pylist()], np.int64) for t in (queries, candidates))
        for d in np.unique(q_size):
            q, c = queries.filter(pa.array(q_size == d)), candidates.filter(pa.array(c_size == d))
            matrix = lambda t, d=d: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if not len(c):
                continue
            q_ids, c_ids, c_rows = q.column("id").to_numpy(), c.column("id").to_numpy(), matrix(c)
            heaps = search_block(q_ids, matrix(q), ((c_ids[a : a + TILE], c_rows[a : a + TILE]) for a in range(0, len(c_ids), TILE)), k)
            out += [(int(i), -c, s) for i, heap in zip(q_ids, heaps) for s, c in heap]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    partial = chosen.groupBy("qb", "cs").cogroup(against.groupBy("qb", "cs")).applyInArrow(run, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
