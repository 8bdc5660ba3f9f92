"""Exact top-k inner products by norm buckets (operator 3).

Vectors are grouped by length into classes whose lengths differ by a tenth at most.
A first pass over about SEED of the longest vectors (drawn by hash from the classes that
hold more than k of them, so one class of all vectors is split too) gives each query a
floor, its k-th best score so far. Vectors too short for every floor of a block of
queries aren't sent to it. In every bucket the floor gives a local cosine threshold,
floor / (|q| * longest length): above 1 the bucket is skipped; where it is high,
candidates must have their largest query coordinates within the interval that the
threshold allows. Of those left, and where it is low, the product over the half of the
coordinates that are largest in the query, plus the lengths of the other halves, has to
reach the floor. The products of what is left are computed exactly on integers.

Null, empty or non-finite vectors and rows without id take no part; vectors of
another dimension are no candidates; equal scores go to the smaller id; an empty
table gives no rows. Rows that repeat an id are rows of their own: each is a candidate
for the others and, if its id is asked for, a query with results of its own. Other
columns are left behind, whatever their names. Components that don't fit into 64 bits,
and scores that don't, count as the nearest number that does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm import tiles
from inkplane.llm.common import cut

#: Ratio of lengths within a bucket, threshold from which single coordinates prune, how many of them are looked at, and vectors of the first pass.
STEP, COSINE, FOCUS, SEED = 1.1, 0.55, 4, 512
EXACT, LARGEST = float(1 << 53), (1 << 63) - 1


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-numbered doubles."""
    most = (np.abs(q).max(initial=0) or 1) * (np.abs(v).max(initial=0) or 1) * q.shape[1]
    if most < 1 << 24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if most < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(v).T, -LARGEST - 1, LARGEST).astype(np.int64)


def candidates(q: np.ndarray, turned: np.ndarray, length: np.ndarray, floor: float) -> np.ndarray:
    """Places of the vectors that may reach ``floor`` with ``q``; they are the columns of ``turned``, longest first."""
    own = float(np.sqrt(q @ q))
    if not np.isfinite(floor) or floor <= 0 or own == 0:
        return np.arange(len(length))
    reach = own * length * (1 + 1e-9)
    n = int(np.searchsorted(-reach, -floor, side="right"))  # those long enough
    if n == 0:
        return np.arange(0)
    cosine, unit = floor / (own * length[0]), q / own
    order, at = np.argsort(-np.abs(unit)), np.arange(n)
    if cosine >= COSINE:
        # with cosine >= t, |angle of p_f - angle of q_f| <= acos(t) for every coordinate f of the unit vectors
        keep = np.ones(n, bool)
        for f in order[:FOCUS]:
            part = turned[f, :n] / length[:n]
            slack = np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[f] ** 2))) + 1e-9
            if unit[f] > -cosine:
                keep &= part >= cosine * unit[f] - slack
            if unit[f] < cosine:
                keep &= part <= cosine * unit[f] + slack
        at = np.flatnonzero(keep)
    # q.v <= q_f.v_f + |rest of q| |rest of v|; what is added to the squares covers their rounding
    f = order[: (len(q) + 1) // 2]
    some = turned[f, :n] if len(at) == n else turned[np.ix_(f, at)]
    rest = np.sqrt(np.maximum(length[at] ** 2 - (some * some).sum(axis=0), 0) + 1e-13 * length[at] ** 2)
    own_rest = np.sqrt(max(own**2 - float(q[f] @ q[f]), 0) + 1e-13 * own**2)
    return at[q[f] @ some + own_rest * rest >= floor - 1e-9 * own * length[at]]


def _tile(part: pa.Table, k: int) -> pa.Table:
    (q_rids, q_ids, q, floors), (v_rids, v_ids, v, _) = tiles.split_tile(part)
    length = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((v_ids, -length))
    v_rids, v_ids, v, length = v_rids[order], v_ids[order], v[order], length[order]
    turned, rows = np.ascontiguousarray(v.T), []
    for start in range(0, len(q_ids) if len(v_ids) else 0, tiles.AT_ONCE):
        some = slice(start, start + tiles.AT_ONCE)
        picked = [candidates(x, turned, length, f) for x, f in zip(q[some], floors[some], strict=True)]
        # where most pairs are left, one product of matrices is cheaper than one for each query
        whole = products(q[some], v) if 2 * sum(map(len, picked)) > len(picked) * len(v) else None
        for i, at in enumerate(picked, start):
            at = at[v_rids[at] != q_rids[i]]
            score = whole[i - start, at] if whole is not None else products(q[i : i + 1], v[at])[0]
            best = np.lexsort((v_ids[at], -score.astype(object) if score.min(initial=0) == -LARGEST - 1 else -score))[:k]
            rows.append((np.full(len(best), q_rids[i]), np.full(len(best), q_ids[i]), v_ids[at][best], score[best]))
    return tiles.found_table(rows, np.int64)


def search(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of every query row."""
    rows = tiles.vectors(df, key, vector, is_query)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    step = F.when(F.col("length") > 0, F.floor(F.log("length") / np.log(STEP)).cast("int")).otherwise(F.lit(-(1 << 30)))
    rows = cut(rows.withColumn("bucket", step))
    queries = rows.filter("asked").select("rid", "id", "v", "dim", "length")
    # first pass: some vectors of the longest classes of each dimension that together hold more than k
    longer = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    top = counts.withColumn("before", F.coalesce(F.sum("n").over(longer), F.lit(0))).filter(F.col("before") <= k).groupBy("dim").agg(F.min("bucket").alias("top"), F.sum("n").alias("held"))
    seeds = F.pmod(F.xxhash64("rid", F.lit("seed")), F.ceil(F.col("held") / F.lit(max(SEED, 2 * k)))) == 0
    topped = rows.join(F.broadcast(top), "dim").withColumn("seed", (F.col("bucket") >= F.col("top")) & seeds).drop("top", "held")
    longest, others = topped.filter("seed").drop("seed"), topped.filter("NOT seed").drop("seed")
    keys = ["dim", "qb", "bucket", "vb"]
    run, found = (lambda part: _tile(part, k)), f"{tiles.FOUND} bigint"
    free = queries.withColumn("bound", F.lit(None).cast("double"))
    first = cut(tiles.tile_rows(free, longest, ["bucket"], tiles.QUERY_BLOCK, tiles.VECTOR_BLOCK).groupBy(*keys).applyInArrow(run, found))
    reached = tiles.merged(first, k, True).filter(F.col("rank") == k).select(F.col("query_rid").alias("rid"), F.col("score").cast("double").alias("bound"))
    bounded = queries.join(reached, "rid", "left").withColumn("need", F.when((F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length") * (1 - 1e-9)).otherwise(F.lit(0.0)))
    rest = tiles.tile_rows(bounded, others, ["bucket"], tiles.QUERY_BLOCK, tiles.VECTOR_BLOCK).groupBy(*keys).applyInArrow(run, found)
    return tiles.merged(first.unionByName(rest), k, True).drop("query_rid")
