"""Eigenpairs and projections against a library's solver and whole-numbered brute force."""

import math

import numpy as np
import pytest

from inkplane.llm import symmetric, whitening

SCHEMA = "vec_id long, embedding array<float>, v int, i string"


@pytest.mark.parametrize("kind", ["random", "clusters", "identity", "low rank", "blocks", "huge", "tiny", "one", "two", "wide"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(5)
    n = {"one": 1, "two": 2, "wide": 150}.get(kind, 64)
    a = rng.standard_normal((n, n))
    a = a @ a.T
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    if kind == "clusters":
        a = q @ np.diag(np.repeat([5, 5 + 1e-12, 5 - 1e-7, 1], n // 4)) @ q.T
    elif kind == "identity":
        a = 3.0 * np.eye(n)
    elif kind == "low rank":
        a = q[:, :3] @ np.diag([9.0, 4, 4]) @ q[:, :3].T
    elif kind == "blocks":
        a[: n // 2, n // 2 :] = a[n // 2 :, : n // 2] = 0
    elif kind in ("huge", "tiny"):
        a *= 1e200 if kind == "huge" else 1e-200
    a = (a + a.T) / 2
    k = min(n, 32)
    values, x = symmetric.eigenpairs(a, k)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:k]
    size = want.max()
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12
    assert np.abs(a @ x - x * values).max() <= 1e-12 * size


def brute(rows, k=32):
    """(n, deviations, projections, shares) by whole numbers and a library's solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, (y @ q) / np.sqrt(e), e / (y * y).sum() * n


def made(n=300, dim=40, seed=3):
    rng = np.random.default_rng(seed)
    m = (rng.standard_normal((n, dim)) * np.linspace(3, 0.3, dim) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]).astype(np.float32)
    m[20:25] = m[10]
    good = [(i, [float(c) for c in v]) for i, v in enumerate(m)] + [(None, [float(c) for c in m[5]]), (7, [float(c) for c in m[6]])]
    bad = [(1000, None), (1001, [1.0] * (dim - 1) + [None]), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (1004, []), (1005, [0.5, 0.25])]
    return good, bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def test_whitening_equals_brute_force(spark):
    good, bad = made()
    got = whitening.whiten(frame(spark, good + bad).repartition(5)).collect()
    n, deviation, projected, shares = brute(good)
    assert len(got) == len(good) * 32 and {r.n for r in got} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == sorted((i is None, i or 0, d) for (i, _), d in zip(good, deviation, strict=True))
    mine = np.zeros((300, 32))
    for r in got:
        if r.vec_id is not None and r.vec_id != 7:
            mine[r.vec_id, r.component - 1] = r.whitened
    keep = [i for i in range(300) if i != 7]
    signs = np.sign((mine[keep] * projected[keep]).sum(axis=0))
    assert np.abs(mine[keep] * signs - projected[keep]).max() < 1e-9
    for r in got:
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-10)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_few_dimensions_and_low_rank(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 7), 1.0]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 100 and got[0].identity_error < 1e-9


def test_far_numbers(spark):
    rows = [(i, [float(1 << 60) * (i % 3), float(i % 4)]) for i in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} == {1} and got[0].identity_error < 1e-6
    rows = [(i, [float(i * 1000), float(i % 4)]) for i in range(40)]
    n, deviation, _, _ = brute(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d) for i, d in enumerate(deviation)}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        out = whitening.whiten(frame(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_any_partitioning_gives_the_same_components(spark):
    good, _ = made(seed=9)
    a, b = (whitening.fit(frame(spark, good).repartition(k)) for k in (1, 7))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.values, b.values)
