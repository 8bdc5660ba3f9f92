"""Nearest neighbours by a block matrix join over int8 tiles (operator 6).

Inside a tile every vector is rounded to int8 with a scale of its own, and the
length of what rounding lost is kept. The product of two rounded matrices gives all
distances at once, each with an interval that surely holds the true one. Pairs
whose interval starts beyond the k-th smallest interval end can't be among the k
nearest; the others are computed again in double precision on the original values,
and heaps merge the tiles. Nothing is approximated in the result.

Null, empty, zero or non-finite vectors and rows without id take no part; vectors
of another dimension are no candidates; equal distances go to the smaller id; an
empty table gives no rows. Rows that repeat an id are rows of their own: each is a
candidate for the others and, if its id is asked for, a query with results of its own.
Other columns are left behind, whatever their names. Where squares leave the range of
doubles, distances are computed on vectors scaled by a power of two; a distance beyond
that range is infinite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.llm import tiles
from inkplane.llm.common import cut

#: Dimensions whose int8 products add up exactly in single precision.
EXACT_DIMS = 1024


def rounded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes as float32, scales, lengths of the rounding errors, lengths of the rounded vectors)."""
    scale = np.abs(m).max(axis=1) / 127
    scale[scale < 1e-300] = 1
    codes = np.rint(m / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.sqrt(((m - back) ** 2).sum(axis=1)), np.sqrt((back**2).sum(axis=1))


@np.errstate(over="ignore", invalid="ignore")
def intervals(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the squared distances of all pairs."""
    (qc, qs, qe, qn), (vc, vs, ve, vn) = rounded(q), rounded(v)
    product = np.zeros((len(q), len(v)))
    for at in range(0, q.shape[1], EXACT_DIMS):
        product += qc[:, at : at + EXACT_DIMS] @ vc[:, at : at + EXACT_DIMS].T
    product *= qs[:, None] * vs[None, :]
    error = qn[:, None] * ve[None, :] + qe[:, None] * (vn + ve)[None, :]
    q2, v2 = (q * q).sum(axis=1)[:, None], (v * v).sum(axis=1)[None, :]
    middle, error = q2 + v2 - 2 * product, 2 * error + 1e-12 * (q2 + v2)
    # what can't be told, as squares are too large, is kept
    return np.nan_to_num(middle - error, nan=-np.inf, posinf=-np.inf, neginf=-np.inf), np.nan_to_num(middle + error, nan=np.inf, posinf=np.inf, neginf=np.inf)


@np.errstate(over="ignore", under="ignore", invalid="ignore")
def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added up in the order of the components, as plain loops and SQL do."""

    def roots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        total = np.zeros(len(v))
        for j in range(len(q)):
            d = v[:, j] - q[j]
            total += d * d
        return np.sqrt(total)

    out = roots(q, v)
    most = np.abs(v - q).max(axis=1, initial=0)
    for i in np.flatnonzero(np.isfinite(most) & ((most > 1e150) | (most < 1e-150)) & (most > 0)):
        by = 2.0 ** -np.floor(np.log2(most[i]))
        out[i] = roots(q * by, v[i : i + 1] * by)[0] / by
    return out


def _tile(part: pa.Table, k: int) -> pa.Table:
    (q_rids, q_ids, q, _), (v_rids, v_ids, v, _) = tiles.split_tile(part)
    rows: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(q_ids) if len(v_ids) else 0, tiles.AT_ONCE):
        some = slice(start, start + tiles.AT_ONCE)
        low, high = intervals(q[some], v)
        own = q_rids[some, None] == v_rids[None, :]
        high[own] = np.inf
        reach = np.partition(high, k - 1, axis=1)[:, k - 1] if len(v_ids) >= k else np.full(len(low), np.inf)
        for i in range(len(low)):
            at = np.flatnonzero((low[i] <= reach[i]) & ~own[i])
            exact = distances(q[start + i], v[at])
            best = np.lexsort((v_ids[at], exact))[:k]
            rows.append((np.full(len(best), q_rids[start + i]), np.full(len(best), q_ids[start + i]), v_ids[at][best], exact[best]))
    return tiles.found_table(rows, np.float64)


def search(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every query row, by Euclidean distance."""
    some = F.exists(F.col("v"), lambda x: x != 0)
    rows = cut(tiles.vectors(df, key, vector, is_query).filter(some))
    queries = rows.filter("asked").withColumn("bound", F.lit(None).cast("double"))
    dealt = tiles.tile_rows(queries, rows, [], tiles.QUERY_BLOCK, tiles.VECTOR_BLOCK)
    found = dealt.groupBy("dim", "qb", "vb").applyInArrow(lambda part: _tile(part, k), f"{tiles.FOUND} double")
    return tiles.merged(found, k, False).drop("query_rid")
