"""Fuzzy line deduplication against brute force."""

import numpy as np
import pyarrow as pa
import xxhash

from inkplane.llm import lines

SCHEMA = "doc_id long, text string, k string, line int, n_lines int"


def sets(line):
    n = lines.SHINGLE
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))} if len(line) >= n else {line}


def text_hash(text):
    """What tells the texts of one doc_id apart, as a signed number."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    docs = sorted({(-(1 << 63) if r[0] is None else r[0], text_hash(r[1]), r[1]) for r in rows if r[1] is not None})
    seen, label = {}, []
    at = []
    for d in docs:
        for n, line in enumerate(d[2].split("\n")):
            if line.strip():
                at.append((d, n, line))
    distinct = sorted({a[2] for a in at})
    seen = {x: i for i, x in enumerate(distinct)}
    label = list(range(len(distinct)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    s = [sets(x) for x in distinct]
    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                label[top(i)] = top(j)
    taken, gone = set(), set()
    for d, n, line in at:
        t = top(seen[line])
        if t in taken:
            gone.add((d, n))
        taken.add(t)
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        d = (-(1 << 63) if r[0] is None else r[0], text_hash(r[1]), r[1])
        parts = r[1].split("\n")
        lost = [n for n in range(len(parts)) if (d, n) in gone]
        out.append((r[0], "\n".join(p for n, p in enumerate(parts) if n not in lost) if lost else r[1], sum(bool(p.strip()) for p in parts), len(lost)))
    return sorted(out, key=str)


def documents():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdeñ"), int(rng.integers(2, 8))))
    pool = [" ".join(word() for _ in range(int(rng.integers(1, 40)))) for _ in range(60)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(int(rng.integers(1, 6))):
            line = pool[int(rng.integers(len(pool)))]
            if rng.random() < 0.4:
                parts = line.split()
                parts[int(rng.integers(len(parts)))] = word()
                line = " ".join(parts)
            own += [line] + [""] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(own), "x", 1, 5))
    rows += [(100, None, "x", 1, 5), (101, "", "x", 1, 5), (102, "\n \n", "x", 1, 5), (103, "a\na\nb\n", "x", 1, 5), (104, "a", "x", 1, 5), (105, "long" * 50_000, "x", 1, 5)]
    rows += [(None, "a\nnobody's line here", "x", 1, 5), rows[3], (3, "other text of three", "x", 1, 5)]
    return rows


def test_equals_brute_force(spark):
    rows = documents()
    out = lines.dedup(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "k", "line", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    assert sum(r[3] for r in got) > 50
    want = brute(rows)
    assert got == want  # rows that repeat an id and rows without one, too


def test_recall_of_the_bands():
    rng = np.random.default_rng(10)
    base = ["".join(rng.choice(list("abcdefghij klm"), 230)) for _ in range(800)]
    near = []
    for x in base:
        at = int(rng.integers(20, 200))
        near.append(x[:at] + "#" * 10 + x[at + 10 :])
    close = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) >= 0.8 for a, b in zip(base, near, strict=True)]
    hit = (lines.bands(base) == lines.bands(near)).any(axis=1)
    assert sum(close) > 700 and hit[np.array(close)].mean() > 0.995


def test_bands_find_all_but_a_thousandth():
    assert (1 - lines.LEAST**lines.ROWS) ** lines.BANDS < 0.001


def test_a_short_line_with_one_word_changed(spark):
    line = "the committee will meet again on Monday in the large hall behind the old town library today"
    rows = [(1, line, "x", 1, 1), (2, line.replace("large", "small"), "x", 1, 1), (3, line[:-1] + "i", "x", 1, 1)]
    out = {r.doc_id: r.n_dropped for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 0, 2: 1, 3: 1}


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 10)
    monkeypatch.setattr(lines, "GATHER", 30)
    base = "the same long passage that many documents carry with a small change each " * 3
    rows = [(i, base + str(i), "x", 1, 1) for i in range(120)]
    out = lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.doc_id for r in out if r.text] == [0] and sum(r.n_dropped for r in out) == 119


def test_empty(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_keys_are_those_of_spark(spark):
    texts = ["a", "ünï", "x" * 100, "日本", " "]
    keys = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) AS k").collect()]
    assert [lines.line_key(t) for t in texts] == [k % (1 << 64) for k in keys]


def test_bits_of_near_lines_agree():
    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list("abcdefghij klm"), 230)) for _ in range(2000)]
    near = [x[:100] + "0123456789ABCDEFGHI" + x[119:] for x in base]
    close = np.array([len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for a, b in zip(base, near, strict=True)])
    a, b = (lines.one_bits(lines.signatures(x)) for x in (base, near))
    agree = lines.BITS - np.bitwise_count(a ^ b)
    assert close.max() < 0.87 and (agree[close >= 0.8] >= lines.AGREE).all()
    assert (lines.BITS - np.bitwise_count(a[1:] ^ a[:-1]) >= lines.AGREE).mean() < 0.1


def test_parts_of_a_target(monkeypatch):
    """Whatever the parts, near lines of small bands make the same pairs, and all lines of crowded bands go on."""
    rng = np.random.default_rng(13)
    base = ["".join(rng.choice(list("abcdefghij klm"), 120)) for _ in range(60)]
    texts = base + [x[:-2] + "zz" for x in base[:20]] + [base[50][:-1] + c for c in "nopqrstuvwxyz"] + base[:5]

    def found(held, few):
        monkeypatch.setattr(lines, "HELD", held)
        monkeypatch.setattr(lines, "FEW", few)
        parts = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7])], ["t"]) for i in range(0, len(texts), 7)]
        packs = pa.Table.from_batches([x for p in parts for x in lines._entries(iter([p]), 8)]).sort_by("target")
        out = pa.Table.from_batches(list(lines._sharing(iter(packs.to_batches(max_chunksize=9)))))
        return set(zip(*(out.column(c).to_pylist() for c in ("band", "a", "b")), strict=True))

    whole = found(1 << 20, 32)
    assert all(band is None for band, _, _ in whole) and found(3, 32) == whole and len(whole) == 20 + 14 * 13 // 2
    for held in (1 << 20, 3):
        crowd = found(held, 5)
        assert len({k for band, k, _ in crowd if band is not None}) == 14 and len({p for p in crowd if p[0] is None and p in whole}) >= 20


def test_similar_is_exact():
    rng = np.random.default_rng(14)
    a = ["".join(rng.choice(list("ab c"), int(rng.integers(1, 60)))) for _ in range(300)]
    b = [x[: int(rng.integers(1, len(x) + 1))] + "b" for x in a]
    want = [len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y)) for x, y in zip(a, b, strict=True)]
    assert lines.similar(a, b, 0.8).tolist() == want and 20 < sum(want) < 280


def test_lines_apart_from_the_first_of_a_crowded_band(spark, monkeypatch):
    """A chain of lines, each near the next only: none may be lost whichever line a band is held against."""
    monkeypatch.setattr(lines, "FEW", 2)
    monkeypatch.setattr(lines, "BLOCK", 3)
    rng = np.random.default_rng(15)
    text, chain = list("".join(rng.choice(list("abcdefghijklm"), 200))), []
    for step in range(12):
        text[step * 12 : step * 12 + 12] = list("".join(rng.choice(list("NOPQRSTUVWXYZ"), 12)))
        chain.append("".join(text))
    rows = [(i, x, "x", 1, 1) for i, x in enumerate(chain)] + [(50, "something else altogether", "x", 1, 1)]
    out = {r.doc_id: r.n_dropped for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: int(0 < i < 12) for i in [*range(12), 50]}


def test_blocks_search_no_strangers(monkeypatch):
    """Lines whose buckets of hashes rule a link out aren't searched; all links are found all the same."""
    rng = np.random.default_rng(16)
    line = lambda: "".join(rng.choice(list("abcdefghij klm"), 300))
    texts, searched = [line() for _ in range(60)], []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args: searched.append(len(v)) or search(a, v, *args))

    def found(texts):
        searched.clear()
        s = [lines.distinct(lines.shingles([x])[0]) for x in texts]
        return lines.linked(s, np.full(len(s), 2), 0.8)

    assert found(texts) == [] and not searched
    texts += [x[:at] + "#" * 6 + x[at + 6 :] for x in texts[:20] for at in (50, 120)]
    label = list(range(len(texts)))
    for i, j in found(texts):
        assert len(sets(texts[i]) & sets(texts[j])) >= 0.8 * len(sets(texts[i]) | sets(texts[j]))
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert label == [*range(60), *(i for i in range(20) for _ in range(2))] and searched


def test_short_and_odd_lines_have_shingles_of_their_own():
    texts = ["a", "ab", "abcd", "abcde", "abcdef", "a", "日本", "日本語の本棚", "\ud800x", "x" * 70_000]
    hashes, starts = lines.shingles(texts)
    found = [set(x.tolist()) for x in np.split(hashes, starts[1:])]
    assert [len(x) for x in found] == [len(sets(x)) for x in texts]
    same = [[bool(a & b) for b in found] for a in found]
    assert same == [[bool(sets(a) & sets(b)) for b in texts] for a in texts]
    least = lines.signatures(texts)
    assert all((least == lines.signatures([x])).all(axis=0)[i] for i, x in enumerate(texts))
    assert [list(range(x.start, x.stop)) for x in lines.runs(np.array([5, 9, 1, 1, 7]), 7)] == [[0], [1], [2, 3], [4]]
