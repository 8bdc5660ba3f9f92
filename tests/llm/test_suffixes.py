"""Repeated strings against brute force, and the parts of the sort on their own."""

import hashlib

import numpy as np
import pytest

from inkplane.llm import suffixes

SCHEMA = "doc_id long, text string, key string, n int, kept string"


def brute(rows, length=100):
    """Per row: (doc_id, n_bytes, n_removed, n_spans, digest)."""
    import xxhash

    order = {}
    for r in rows:
        t = (r[1] or "").encode()
        order[-(1 << 63) if r[0] is None else r[0], np.int64(np.uint64(xxhash.xxh64_intdigest(t, 42)))] = t
    seen, gone = set(), {}
    for k in sorted(order):
        t, out = order[k], np.zeros(len(order[k]) + 1, int)
        for s in range(len(t) - length + 1):
            w = hash(t[s : s + length])
            if w in seen:
                out[s] += 1
                out[s + length] -= 1
            seen.add(w)
        gone[t, k] = np.cumsum(out)[: len(t)] > 0
    result = []
    for r in rows:
        t = (r[1] or "").encode()
        g = gone[t, (-(1 << 63) if r[0] is None else r[0], np.int64(np.uint64(xxhash.xxh64_intdigest(t, 42))))]
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        n = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        result.append((r[0], len(t), int(g.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


def documents(big=True):
    rng = np.random.default_rng(12)
    letters = list("abcdeéñ ß\n")
    prose = lambda n: "".join(rng.choice(letters, n))
    passages = [prose(int(rng.integers(60, 400))) for _ in range(6)]
    rows = []
    for i in range(120):
        text = prose(int(rng.integers(0, 500)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(text) + 1))
            p = passages[int(rng.integers(6))]
            text = text[:at] + p[int(rng.integers(0, 20)) :] + text[at:]
        rows.append((i, text, "x", 1, "y"))
    rows += [(200, rows[5][1], "x", 1, "y"), (201, rows[6][1] + "!", "x", 1, "y"), (202, "a" * 3000, "x", 1, "y"), (203, "ab" * 400 + "c" + "ab" * 300, "x", 1, "y")]
    rows += [(204, None, "x", 1, "y"), (205, "", "x", 1, "y"), (206, "z" * 99, "x", 1, "y"), (207, "q" * 100, "x", 1, "y"), (208, "q" * 100, "x", 1, "y")]
    rows += [(None, rows[7][1], "x", 1, "y"), rows[9], (9, rows[9][1][:150] + "differs", "x", 1, "y")]
    if big:
        long = "".join(rng.choice(letters, 1_060_000))
        rows.append((300, long + long[1_000_000:1_050_000], "x", 1, "y"))
    return rows


def test_digests(spark):
    rows = documents()
    got = sorted(map(tuple, suffixes.digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows) and sum(r[2] > 0 for r in got) > 50


@pytest.mark.parametrize("most", [1, 5])
def test_large_groups_are_narrowed(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "GROUP_RUNS", most)
    rows = documents(big=False)
    line = "one line of ninety bytes that very many documents carry at many places, in many contexts.."
    rng = np.random.default_rng(13)
    rows += [(400 + i, "".join(rng.choice(list("abcd"), 120)) + line + "".join(rng.choice(list("abcd"), 120)), "x", 1, "y") for i in range(40)]
    got = sorted(map(tuple, suffixes.digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_columns_and_empty(spark):
    out = suffixes.remove(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "text", "key", "n", "removed", "kept"] and out.count() == 0


@pytest.mark.parametrize("text", [b"banana", b"aaaa", b"abab" * 9, b"", b"z", bytes(range(250, 0, -1)), b"\x00ab\x00ab\x00"])
def test_two_stage(text):
    data = np.frombuffer(text, np.uint8)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    # suffixes that run into the end come in any order beyond depth; here depth covers all
    assert suffixes.two_stage(data, 260).tolist() == want if len(text) else len(suffixes.two_stage(data, 260)) == 0


def test_common_prefix():
    text = np.frombuffer(b"abcdabcfzzzz", np.uint8)
    assert suffixes.common_prefix(text, np.array([0, 1]), np.array([4, 0]), 4).tolist() == [3, 0]


def test_sift_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(14)
    n = 300
    rows = sorted((int(rng.integers(0, 60)), int(rng.integers(0, 3)), int(i), 0, 0) for i in range(n))
    columns = list(zip(*rows, strict=True))
    whole = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([5] * n, pa.int32()), pa.array([1] * n, pa.int32())], suffixes._RUN_NAMES)
    several = {k for k in columns[0] if len({r[1] for r in rows if r[0] == k}) > 1}
    seen, want = set(), set()
    for k, g, d, *_ in rows:
        if (k, g) in seen:
            want.add((k, d, -5))
        elif k in several:
            want.add((k, d, 5))
        seen.add((k, g))
    for size in (1, 2, 7, 300):
        parts = [whole.slice(i, size) for i in range(0, n, size)]
        got = [(r["key"], r["d"], r["n"]) for b in suffixes._sift(iter(parts)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
