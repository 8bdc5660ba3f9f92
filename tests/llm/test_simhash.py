"""Fingerprints, BK-trees and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkplane.llm import simhash
from inkplane.llm.components import components

SCHEMA = "doc_id long, text string, fp string, root string"


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[top(i)] = top(j)
    best = {}
    for i, d in enumerate(ids):
        best.setdefault(top(i), []).append(d)
    return [min((d for d in best[top(i)] if d is not None), default=None) for i in range(len(ids))]


def documents():
    rng = np.random.default_rng(5)
    vocabulary = ["Wort%d" % i for i in range(300)] + ["é", "x y", "\x1cz"]
    texts = []
    for _ in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 60))))
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 4))):
            near = words.copy()
            near[int(rng.integers(len(near)))] = "changed"
            texts.append("\n".join(near) if rng.random() < 0.3 else " ".join(near))
    texts += [None, "", " \t ", "one", "ONE", "two words", "word " * 100_000, texts[0], texts[0].upper()]
    return [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "alone and lost here now", "a", "b"), (3, texts[3], "a", "b")]


def test_fingerprints():
    for _, t, *_ in documents():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_classes(spark):
    rows = documents()
    got = sorted(map(tuple, simhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    fps = [simhash.fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], plain_components([r[0] for r in rows], fps), strict=True), key=str)
    assert got == want


def near_values(rng, n):
    base = rng.integers(0, 2**63, n // 20, dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(6):
        flip = rng.random(n) < 0.5
        out = np.where(flip, out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), out)
    return np.unique(out)


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(6)
    values = near_values(rng, 1500)
    tree = np.sort(rng.integers(0, 3, len(values)))
    forest = simhash.Forest(values[:, None], tree)
    q, node = forest.within(values[:, None], forest.roots[tree], 4)
    mine = set(zip(q.tolist(), node.tolist(), strict=True))
    d = np.bitwise_count(values[:, None] ^ values[None])
    a, b = np.nonzero((d <= 4) & (tree[:, None] == tree[None]))
    assert mine == set(zip(a.tolist(), b.tolist(), strict=True)) and len(mine) > len(values) * 2


def test_split_shards_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(7)
    values = near_values(rng, 400)
    values = np.unique(np.concatenate([values, (values & np.uint64(0xFFF)) | np.uint64(0xABC0000000000000)]))  # one large shard
    ids = list(range(len(values)))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    signed = values.view(np.int64).tolist()
    want = plain_components(ids, values.tolist())
    mine = [found.get(v, v) for v in signed]
    groups = lambda x: {frozenset(i for i in ids if x[i] == k) for k in set(x)}
    assert groups(mine) == groups(want)


@pytest.mark.parametrize("finish", [0, 700, 1 << 18])
def test_long_chains(spark, monkeypatch, finish):
    monkeypatch.setattr("inkplane.llm.components.FINISH", finish)
    rng = np.random.default_rng(8)
    names = rng.permutation(2000).tolist()
    links = spark.createDataFrame([(names[i], names[i + 1]) for i in range(1999) if i % 500 != 499], "a long, b long")
    got = components(links)
    assert got.count() == 2000 and got.select("root").distinct().count() == 4
    assert components(links.filter(F.lit(False))).count() == 0
    pair = lambda c: F.struct((F.col(c) % 7).alias("d"), F.col(c).alias("h")).alias(c)
    both = components(links.select(pair("a"), pair("b")))
    groups = {frozenset(r.of) for r in both.groupBy("root").agg(F.collect_list("node.h").alias("of")).collect()}
    assert groups == {frozenset(names[k : k + 500]) for k in range(0, 2000, 500)}


def near_components(ids, texts):
    """Of all pairs of 128-bit fingerprints, by hand."""
    fps = [sum(x << (64 * i) for i, x in enumerate(simhash.fingerprint_bits(t, simhash.NEAR_WORDS, 2))) for t in texts]
    return plain_components(ids, fps, simhash.NEAR)


def test_trees_of_two_numbers():
    rng = np.random.default_rng(16)
    values = np.stack([near_values(rng, 700)[:500], near_values(rng, 700)[:500]], axis=1)
    forest = simhash.Forest(values, np.zeros(500, int))
    q, node = forest.within(values, forest.roots[np.zeros(500, int)], 30)
    d = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2)
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= 30)), strict=True))


def test_near_copies_are_found_and_others_left(spark):
    """Pairs of five-word shingles at Jaccard 0.8 or more, and pairs well below, in whole texts."""
    rng = np.random.default_rng(17)
    vocabulary = [f"w{i}" for i in range(2000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near, far = [], [], []
    for i in range(150):
        words = list(rng.choice(vocabulary, int(rng.integers(100, 400))))
        other, changes = words.copy(), max(1, int(len(words) * (0.018 if i % 2 else 0.09)))
        for at in rng.choice(len(words), changes, replace=False):
            other[int(at)] = "changed"
        j = len(shingles(words) & shingles(other)) / len(shingles(words) | shingles(other))
        rows += [(2 * i, " ".join(words), "a", "b"), (2 * i + 1, " ".join(other), "a", "b")]
        if j >= 0.8:
            near.append(2 * i + 1)
        elif j < 0.5:
            far.append(2 * i + 1)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 300 and len(near) > 50 and len(far) > 50
    assert np.mean([got[i] == i - 1 for i in near]) >= 0.9 and np.mean([got[i] == i for i in far]) >= 0.9
    assert all(got[i] == i for i in range(0, 300, 2))


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (None, "only this one", "a", "b"), (3, "only this one", "a", "b"), (3, "x " * 50_000, "a", "b"), (4, "ONLY  this\none", "a", "b")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 3), (3, 3), (3, 3), (4, 3)], key=str)
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty(spark):
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0
