"""Searches against brute force, with ties, repeated rows, odd vectors and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplane.llm import nearest, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def made(seed=1, n=700, dim=16, spread=False):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
    if spread:
        m *= rng.lognormal(0, 1, (n, 1)).astype(np.float32)
    m[50:60] = m[40]  # ties
    m[61] = 0
    rows = [(i, [float(x) for x in r], 0, "x", 1) for i, r in enumerate(m)]
    rows += [(1000, None, 0, "x", 1), (1001, [1.0, None], 0, "x", 1), (1002, [float("nan")] * dim, 0, "x", 1), (1050, [], 0, "x", 1), (None, [1.0] * dim, 0, "x", 1), (1100, [float("inf")] * dim, 0, "x", 1), (1150, [0.5, 0.5], 0, "x", 1)]
    return m, rows


def best(ids, scores, own, k):
    order = sorted((s, i) for i, s in zip(ids, scores, strict=True) if i != own)
    return [(i, s) for s, i in order[:k]]


@pytest.mark.parametrize("spread", [False, True])
def test_topk_equals_brute_force(spark, monkeypatch, spread):
    m, rows = made(spread=spread)
    monkeypatch.setattr("inkplane.llm.tiles.VECTOR_BLOCK", 128)
    monkeypatch.setattr("inkplane.llm.tiles.QUERY_BLOCK", 8)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(256 * m.astype(float)).astype(np.int64)
    want = {q: [(n, i, -s) for n, (i, s) in enumerate(best(range(len(m)), -(whole @ whole[q]), q, 5), 1)] for q in range(0, len(m), 50)}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_floors_prune_and_lose_nothing():
    """Vectors of one length: the floors of a first block leave less than half of the other pairs, and all that reach them."""
    rng = np.random.default_rng(6)
    v = np.floor(256 * (m := rng.normal(size=(4000, 64))) / np.linalg.norm(m, axis=1, keepdims=True))
    v = v[np.argsort(-(v * v).sum(axis=1))]
    length = np.sqrt((v * v).sum(axis=1))
    turned, left = np.ascontiguousarray(v.T), 0
    for q in v[::50]:
        score = v @ q
        floor = np.sort(score[rng.choice(4000, 512, replace=False)])[-5]
        at = topk.candidates(q, turned, length, float(floor))
        assert set(np.flatnonzero(score >= floor)) <= set(at)
        left += len(at)
    assert left < 80 * 4000 / 2
    print(f"pairs left: {left / 80 / 4000:.2f}")


def test_topk_seeds_split_one_class(spark, monkeypatch):
    """A first pass far smaller than the class, and one too small to give floors, change nothing."""
    m, rows = made(seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    found = []
    for seed in (512, 16, 1):
        monkeypatch.setattr(topk, "SEED", seed)
        found.append(sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())))
    assert found[0] == found[1] == found[2] and found[0]


def test_nearest_equals_brute_force(spark, monkeypatch):
    m, rows = made(seed=2)
    monkeypatch.setattr("inkplane.llm.tiles.VECTOR_BLOCK", 128)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = m.astype(float)
    ids = [i for i in range(len(m)) if i != 61]
    for q in range(0, len(m), 100):
        want = best(ids, np.sqrt(((x[ids] - x[q]) ** 2).sum(axis=1)), q, 10)
        mine = sorted(got[q])
        assert [(i, pytest.approx(s)) for i, s in want] == [(i, s) for _, i, s in mine]
    assert set(got) == set(range(0, len(m), 100))


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(20, 30)), rng.normal(size=(50, 30)) * rng.lognormal(size=(50, 1))
    low, high = nearest.intervals(q, v)
    true = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()


def test_large_whole_numbers_stay_exact():
    q = np.array([[2.0**52, 3.0]])
    assert topk.products(q, np.array([[2.0, 5.0]]))[0, 0] == 2**53 + 15


def by_hand(rows, k, score, step):
    """Every query row against every other row; rows are (id, vector)."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % step == 0:
            best = sorted((score(x, y), v) for j, (v, y) in enumerate(rows) if j != i)[:k]
            out += [(q, n, v, s) for n, (s, v) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 8])
def test_repeated_ids_are_rows_of_their_own(spark, dim):
    rng = np.random.default_rng(4)
    rows = [(int(i % 130), [float(x) for x in np.round(rng.normal(size=dim), 2)]) for i in range(260)] + [(100, [1.0] * dim)] * 2
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows] + [(7, [0.0] * dim, 0, "x", 1), (100, None, 0, "x", 1)], SCHEMA.replace("float", "double"))
    near = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(df, F.col("vec_id") % 100 == 0, 4).collect())
    want = by_hand(rows, 4, lambda x, y: float(nearest.distances(np.array(x), np.array([y]))[0]), 100)
    assert near == want and sum(1 for r in near if r[0] == 100 and r[1] == 1) == 4
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in [*rows, (7, [0.0] * dim)]]
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert top == sorted((q, n, v, -s) for q, n, v, s in by_hand(whole, 5, lambda x, y: -sum(a * b for a, b in zip(x, y, strict=True)), 50))


def test_numbers_beyond_the_range(spark):
    rows = [(i, [1e200 * (i + 1), -1e200], 0, "x", 1) for i in range(12)] + [(200 + i, [1e-200 * (i + 1), 1e-200], 0, "x", 1) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    near = {}
    for r in nearest.search(df, F.col("vec_id") % 100 == 0, 3).collect():
        near.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert [near[0][n][0] for n in (1, 2, 3)] == [1, 200, 201] and near[0][1][1] == pytest.approx(1e200) and near[0][2][1] == pytest.approx(2**0.5 * 1e200)
    assert [near[200][n][0] for n in (1, 2, 3)] == [201, 202, 203] and near[200][1][1] == pytest.approx(1e-200)
    top = topk.search(df, F.col("vec_id") == 0, 2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in top) == [(1, 1, (1 << 63) - 1), (2, 2, (1 << 63) - 1)]


def test_floor_where_the_longest_class_is_small(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 6))
    m[3] *= 50
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA.replace("float", "double"))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert top == sorted((q, n, v, -s) for q, n, v, s in by_hand(whole, 5, lambda x, y: -sum(a * b for a, b in zip(x, y, strict=True)), 50))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.search(df, F.col("vec_id") % 50 == 0, 5).count() == 0
    assert nearest.search(df, F.col("vec_id") % 100 == 0, 10).count() == 0
