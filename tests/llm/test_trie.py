"""Nodes of the trie against a plain walk over all prefixes, for many cuts into segments and shards."""

import hashlib
import math
import random
import zlib

import pytest

from inkplane.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    return out


def brute(rows):
    made = sequences(rows)
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, of in members.items():
        ends = sorted(c for c in of if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs=260, most=14):
    rng = random.Random(seed)
    texts = ["", "a", "bé", "字形 x", "long " * 5]
    rows = []
    for c in range(convs):
        n = rng.choice([1, 2, 3, 5, most])
        if c % 3 == 0:  # copies of a conversation, and prefixes of it
            rows += [(c, t, "user", f"same {t}") for t in range(rng.choice([n, most]))]
        else:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*texts, None])) for t in range(n)]
    rows += [(1000 + k, 5, "user", "no first one of its hundred") for k in range(1, 20)]
    rows += [(2007, None, "system", "first"), (2007, 3, "user", "b"), (2007, 1, "user", "a"), (None, 1, "user", "lost"), (-250, 0, "user", "below"), (-200, 0, "user", "zero"), (-200, 1, "user", "one")]
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.trie(df).select(*NAMES).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = made(1)
    assert set(got(spark, rows)) ^ set(brute(rows)) == set()


@pytest.mark.parametrize("segment, per_shard, most", [(3, 20, 7), (1, 10000, 3)])
def test_segments_and_shards(spark, monkeypatch, segment, per_shard, most):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "ROWS", per_shard)
    rows = made(segment, convs=130, most=most)
    assert got(spark, rows) == brute(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 64)
    rows = [(7, t, "user", f"turn {t % 90}") for t in range(300)] + [(c, t, "user", f"turn {t % 90}") for c in (8, 9) for t in range(150)] + [(1, 0, "user", "hello")]
    assert got(spark, rows) == brute(rows)


def test_few_rows(spark):
    for rows in ([], [(None, 1, "user", "x")], [(5, None, None, None)], [(3, 0, "user", "only")]):
        assert got(spark, rows) == brute(rows)


def test_repeated_turns_stay(spark):
    rows = [(7, 0, "user", "x"), (7, 0, "user", "x"), (7, 1, "user", "y"), (13, 0, "user", "x")]
    assert got(spark, rows) == brute(rows)
