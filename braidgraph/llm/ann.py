"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into groups of bounded size; each cell of the grid (query group x candidate group)
meets in one task. There both sides are rounded to int8 with a scale per vector, tiles of integer products give every
distance to within a bound known from the rounding errors' norms, pairs whose lower bound is beyond the current k-th
upper bound are dropped, and the rest are recomputed in double precision and kept in a heap per query. The cells' lists
are merged by rank, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._common import ready

#: Rows and numbers of a query group and of a candidate group, about, and rows of the tiles inside a cell.
#: Rows are sent once for each group of the other side, so equal groups send least for the memory that a cell may take.
GROUP, GROUP_NUMBERS, TILE = 16_384, 1 << 23, 2_048
#: A sum of int8 products is exact in float32 up to this many dimensions.
EXACT_FLOAT32 = (1 << 24) // (127 * 127)


def usable(vec: str) -> F.Column:
    """Neither null nor empty nor zero, and all components finite."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norms of the rows and of their rounding errors."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, distances(x, np.zeros_like(x)), distances(x, q * scale[:, None])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components added in order: the same in every tile and engine.

    Where squares leave the range of double precision, gaps are divided by a power of two first.
    """
    with np.errstate(over="ignore", under="ignore"):
        gap = (x - y).T
        total = np.zeros(gap.shape[1])
        for part in gap:
            total += part * part
        out = np.sqrt(total)
        odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-280))
        if len(odd):
            half = x[odd] / 2 - y[odd] / 2  # a gap itself may be out of range
            most = np.maximum(np.abs(half).max(1, initial=0.0), 5e-324)
            unit = np.ldexp(1.0, np.clip(np.frexp(most)[1], -1021, 1023))
            out[odd] = np.sqrt(((half / unit[:, None]) ** 2).sum(1)) * unit * 2
        return out


def cell(qid: np.ndarray, qkey: np.ndarray, q: np.ndarray, cid: np.ndarray, ckey: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(query id, query key, candidate id, distance) of the k nearest candidates of each query, its own row left out."""
    kind = np.float32 if q.shape[1] <= EXACT_FLOAT32 else np.float64
    q8, qs, qn, qe = rounded(q)
    c8, cs, cn, ce = rounded(c)
    q8, c8 = q8.astype(kind), c8.astype(kind)
    first = {x: i for i, x in reversed([*enumerate(zip(cid.tolist(), ckey.tolist(), strict=True))])}
    own = np.array([first.get(x, -1) for x in zip(qid.tolist(), qkey.tolist(), strict=True)], np.int64)  # equal rows: one of them
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]  # of (-distance, -id): the worst on top
    for a in range(0, len(q), 256):
        rows = slice(a, a + 256)
        bound = np.full(len(qid[rows]), np.inf)
        for b in range(0, len(c), TILE):
            cols = slice(b, b + TILE)
            with np.errstate(over="ignore", invalid="ignore"):
                dot = (q8[rows] @ c8[cols].T).astype(np.float64) * qs[rows, None] * cs[None, cols]
                # |x.y - dot| <= |x| |error of y| + |y| |error of x| + |error of x| |error of y|, and some for rounding
                off = qn[rows, None] * ce[None, cols] + qe[rows, None] * (cn + ce)[None, cols]
                square = qn[rows, None] ** 2 + cn[None, cols] ** 2
                mid, off = square - 2 * dot, 2 * off + 1e-12 * square + 1e-300
                high, low = mid + off, mid - off
            other = own[rows, None] != np.arange(b, b + len(c8[cols]))[None, :]
            high = np.where(other & ~np.isnan(high), high, np.inf)
            if high.shape[1] > k:
                bound = np.minimum(bound, np.partition(high, k - 1, axis=1)[:, k - 1])
            r, s = np.nonzero(other & ~(low > bound[:, None]))  # a bound out of range rules nothing out
            for at in range(0, len(r), 1 << 16):
                rr, ss = r[at : at + (1 << 16)], s[at : at + (1 << 16)]
                exact = distances(q[a + rr], c[b + ss])
                for i, d, j in zip((a + rr).tolist(), exact.tolist(), cid[b + ss].tolist(), strict=True):
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], (-d, -j))
                    elif (-d, -j) > heaps[i][0]:
                        heapq.heapreplace(heaps[i], (-d, -j))
            for i in range(a, a + len(bound)):
                if len(heaps[i]) == k:
                    worst = heaps[i][0][0]
                    bound[i - a] = min(bound[i - a], worst * worst * (1 + 1e-9) + 1e-300)
    return [(int(qid[i]), int(qkey[i]), -j, -d) for i, h in enumerate(heaps) for d, j in h]


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose id is divisible by `every`.

    score is the Euclidean distance in double precision; ties go to the smaller id. Null ids and vectors that are null,
    zero or hold null or non-finite components take no part; vectors of another length are no candidates, and vectors of
    any length are taken whole. Distances beyond the range of double precision are infinite. A query's own row is no
    candidate, but any other row is, one with the same id too. Rows equal in id and vector are one query, with all but
    one of them among its candidates. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ready(spark)
    # single precision travels as it is and is widened in the cells
    kind = vectors.schema[vec].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), (F.col(vec) if single else F.col(vec).cast("array<double>")).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    v = v.withColumn("key", F.xxhash64("v"))
    asks = v.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    n, m, dim = v.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    group = max(1, min(GROUP, GROUP_NUMBERS // dim))
    nq, nc = max(1, -(-m // group)), max(1, -(-n // group))
    spread = lambda groups, seed: F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.lit(groups)).cast("int")
    # each query goes to every candidate group and each candidate to every query group: the grid's cells
    left = asks.select("id", "key", "v", F.size("v").alias("dim"), spread(nq, 1).alias("gq"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("gc"))
    right = v.select("id", "key", "v", F.size("v").alias("dim"), spread(nc, 2).alias("gc"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("gq"))

    def run(ask: pa.Table, have: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, float]] = []
        if ask.num_rows and have.num_rows:
            dim = ask["dim"][0].as_py()
            q, c = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for t in (ask, have))
            rows = cell(ask["id"].to_numpy(), ask["key"].to_numpy(), q, have["id"].to_numpy(), have["key"].to_numpy(), c, k)
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "key", "vec_id", "score"])

    grid = ["dim", "gq", "gc"]
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(run, "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
