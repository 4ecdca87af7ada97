"""Exact nearest neighbours as a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks is one cell and
one task. In a cell unit vectors are rounded to int8 and tiles multiplied; with the
exact length of each rounding error, Cauchy and Schwarz bound the true cosine from
both sides. Candidates whose upper bound reaches the k-th lower bound are
recomputed in double precision on the original vectors and merged by heaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

QUERY_ROWS = 4096
CANDIDATE_ROWS = 16384
TILE = 1024
# Products of int8 sums are exact in float32 up to this many dimensions at once.
EXACT_DIMENSIONS = 1024


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row and the length of its rounding error, of unit rows."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - small * scale[:, None]) ** 2).sum(axis=1))
    return small, scale, error + 1e-9


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMENSIONS):
        part = slice(at, at + EXACT_DIMENSIONS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision, summed in order of dimension."""
    dot = np.cumsum(rows * q, axis=1)[:, -1]
    lengths = np.cumsum(rows * rows, axis=1)[:, -1] * np.cumsum(q * q)[-1]
    return np.clip(dot / np.sqrt(lengths), -1.0, 1.0)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, keepdims=True))
    return np.ldexp(rows, -exponent)


def cell(query_ids, queries, ids, vectors, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k best of a cell for each query."""
    small_q, scale_q, error_q = quantise(queries)
    small_v, scale_v, error_v = quantise(vectors)
    heaps: list[list] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)
    for at in range(0, len(ids), TILE):
        part = slice(at, at + TILE)
        near = int8_products(small_q, small_v[part]) * (scale_q[:, None] * scale_v[part])
        # |q.v - q'.v'| <= |q - q'| |v| + |q'| |v - v'| with |v| = 1 and |q'| <= 1 + |q - q'|.
        slack = error_q[:, None] + (1 + error_q[:, None]) * error_v[part]
        lower = near - slack
        if lower.shape[1] > k:
            # One of the k + 1 best may be the query itself.
            bar = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)]
            floor = np.maximum(floor, bar)
        for i, j in enumerate(np.flatnonzero(row) for row in near + slack >= floor[:, None]):
            j = j[ids[part][j] != query_ids[i]]
            if not len(j):
                continue
            for score, vec in zip(cosine(queries[i], vectors[part][j]), ids[part][j]):
                item = (float(score), -int(vec))
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], item)
                elif item > heaps[i][0]:
                    heapq.heapreplace(heaps[i], item)
            if len(heaps[i]) == k:
                floor[i] = max(floor[i], heaps[i][0][0] - 1e-9)
    return [(int(query_ids[i]), -vec, score) for i, heap in enumerate(heaps) for score, vec in heap]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows whose vectors take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of each query by cosine.

    Rows are (vec_id, embedding). Vectors that are null, empty, zero or hold null or
    non-finite components take no part, on either side; vectors of another number of
    dimensions are no candidates. Ties go to the smaller vec_id; fewer candidates
    give fewer rows. Repeated candidate rows count once, repeated queries too. Components
    may be as large or small as doubles are; other columns are ignored.
    """
    wanted = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    offered = usable(vectors)
    n, q = offered.count(), wanted.count()
    across, down = max(1, -(-n // candidate_rows)), max(1, -(-q // query_rows))
    block = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")
    grid = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = wanted.select(block(down).alias("qb"), grid(across).alias("cb"), F.size("v").alias("dims"), "vec_id", "v")
    right = offered.select(grid(down).alias("qb"), block(across).alias("cb"), F.size("v").alias("dims"), "vec_id", "v")

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if len(a) and len(b):
            dims = a.column("dims")[0].as_py()
            read = lambda t: (
                t.column("vec_id").to_numpy(),
                np.concatenate([np.asarray(c.flatten()) for c in t.column("v").chunks]).reshape(-1, dims),
            )
            (query_ids, qs), (ids, vs) = read(a), read(b)
            qs, vs = scaled(qs), scaled(vs)
            order = np.argsort(ids, kind="stable")
            ids, vs = ids[order], vs[order]
            once = np.concatenate([[True], ids[1:] != ids[:-1]])
            rows = cell(query_ids, qs, ids[once], vs[once], k)
        names = ("query_id", "vec_id", "score")
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds))})

    keys = ("qb", "cb", "dims")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
