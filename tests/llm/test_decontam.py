"""Occurrences of benchmark windows against a plain search of every position."""

import hashlib
import random
import re

import pytest

from inkplane.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items):
    tests = {}
    for item, text in items:
        w = split(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            tests.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(t) for t in tests}
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (t := tuple(w[k : k + size])) in tests:
                    hit |= set(range(k, k + size))
                    ids |= {str(i) for i in tests[t] if i is not None}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = ["ab", "Cd", "e", "f9", "été", "字形", "Ünter", "x" * 40, "the", "of"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    items = [(i, say(rng.choice([10, 12, 25]))) for i in range(40)] + [(100, None), (101, ""), (102, " .,"), (103, "Only three words"), (104, "zygote"), (None, "nameless item of five words"), (3, "one two three four five six seven eight nine ten eleven")]
    items += [(200 + i, "a passage that very many of the items do have in common") for i in range(30)]
    docs = []
    for i in range(150):
        text = say(rng.randrange(60))
        if i % 3 == 0:
            passage = rng.choice(items)[1] or ""
            text += passage.upper().replace(" ", "  ") + say(rng.randrange(30))
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "..."), (503, "zygote"), (504, "ZYGOTE zygote only THREE words!"), (505, "nameless item of five words"), (506, "nameless item of five"), (1, "zygote"), (1, "zygote"), (None, "zygote é")]
    return docs, items


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, i string, t int")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, s string")
    return d, b, sorted((tuple(r) for r in decontam.digests(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = made()
    want = brute(docs, items)
    assert got(spark, docs, items)[2] == want
    assert 20 < sum(r[5] for r in want) < len(want)  # both kinds


def test_short_pieces_and_small_shards(spark, monkeypatch):
    docs, items = made(2)
    docs.append((900, " ".join(t or "" for _, t in docs) * 2))
    monkeypatch.setattr(decontam, "PIECE", 200)
    monkeypatch.setattr(decontam, "SHARD", 50)
    # functions travel to the workers by reference, so the limits are tried in this process too
    d, b, rows = got(spark, docs, items)
    assert rows == brute(docs, items)
    owned = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            owned.setdefault(" ".join(w[k : k + 10]), set()).add(item)
    pairs = sorted((s, str(i) if i is not None else None) for s, of in owned.items() for i in of)
    want = {t or "": brute([(0, t)], items)[0] for _, t in docs}
    for size in (7, 1000):
        shards = [decontam.Shard.made(*zip(*pairs[k : k + size], strict=True)) for k in range(0, len(pairs), size)]
        texts = [(t or "").encode() for _, t in docs]
        for group in (texts, *[[t] for t in texts]):
            found = [decontam.Found() for _ in group]
            for shard in (None, *shards):
                decontam._search(group, found, shard)
            for text, f in zip(group, found, strict=True):
                _, n, hit, n_items, _, _ = want[text.decode()]
                assert (f.n_words, sum(s[1] - s[0] for s in f.merged()), len(f.items)) == (n, hit, n_items)


def test_spans_point_at_the_text(spark):
    text = "Vorwort – ÉTÉ: One, TWO three\nfour five six seven eight nine ten eleven; Ende"
    b = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = decontam.scan(d, b).collect()
    (s,) = r.spans
    assert r["items"] == ["7"] and (s.first_word, s.end_word) == (3, 14)  # the dash is a word too
    assert text.encode()[s.first_byte : s.end_byte].decode() == "One, TWO three\nfour five six seven eight nine ten eleven"


def test_jumps_skip_most_positions():
    shard = decontam.Shard.made(["one two three four five six seven eight nine ten"], ["1"])
    (c,) = shard.classes
    assert (c.shift == 9).mean() > 0.99 and c.shift.min() == 0
    assert sorted(set(c.shift.tolist())) == list(range(10))


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    rows = got(spark, docs, items)[2]
    assert [r[:4] for r in rows] == [(1, 2, 0, 0)] * len(docs)


def test_a_word_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 64)
    text = ("a" * 500 + " b c d e f g h i zz " + "y" * 300).encode()
    found = [decontam.Found()]
    shard = decontam.Shard.made(["b c d e f g h i zz " + "y" * 300], ["q"])
    for s in (None, shard):
        decontam._search([text], found, s)
    assert found[0].n_words == 11 and [x[:2] for x in found[0].merged()] == [(1, 11)] and found[0].items == {"q"}
