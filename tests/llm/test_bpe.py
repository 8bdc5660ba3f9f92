"""BPE against the tokenizers library."""

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkplane.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string"
MINE, THEIRS = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
ODD = ["", " ", "<|endoftext|>", "a<|endoftext|>B <|startoftext|> 'S it's IT'S we'LL", "ΑΣ ΟΔΟΣ.", "é é İstanbul ß ẞ", "x" * 5000, "ab" * 3000 + "\x1c\x85  ٣4 ½ Ⅷ", "日本語 한국어 🙂", "a b　c﻿d"]


def check(mine, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_odd_texts():
    for text in ODD:
        check(MINE, THEIRS, text)


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{c}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        ids = [e.ids for e in THEIRS.encode_batch(part, add_special_tokens=False)]
        assert MINE.encode_all(part).to_pylist() == ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=40))
def test_any_text(text):
    check(MINE, THEIRS, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("aAé\u0301\u0327ΣσİßÅẞ1²٣ \t\u2028\u0085'st|<>\U00011935\U00011930\U0001e900가ᄀ") + ["<|endoftext|>", "<|ENDOFTEXT|>"]), max_size=30).map("".join))
def test_awkward_text(text):
    check(MINE, THEIRS, text)


def test_query(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    theirs = THEIRS
    got = {r.doc_id: r for r in bpe.tokens(df, PATH).collect()}
    assert bpe.tokens(df, PATH).count() == len(rows)
    assert [got[i].n_tokens for i in (1, 2, 4)] == [len(theirs.encode(ODD[i]).ids) for i in (1, 2, 4)] and got[None].n_tokens == 0
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert back[7] == theirs.decode(theirs.encode(ODD[7]).ids, skip_special_tokens=False)
    assert bpe.tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    again = bpe.decode(df.selectExpr("doc_id", "array(320, null) as ids", "'x' as decoded").union(spark.sql("SELECT 1L, CAST(NULL AS ARRAY<INT>), 'y'")), PATH)
    assert again.columns == ["doc_id", "ids", "decoded"] and again.filter("doc_id = 1").orderBy("decoded").first().decoded is None


def test_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 16)
    texts = [None, "", "one two", "two <|endoftext|> three " * 3, "one", None, "Ünï"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    made = list(bpe._encode_batches(iter([batch]), PATH, "t"))
    assert len(made) > 2 and [x for b in made for x in b.column("k").to_pylist()] == list(range(len(texts)))
    assert [x for b in made for x in b.column("ids").to_pylist()] == [THEIRS.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    check(bpe.Bpe(PATH), Tokenizer.from_file(PATH), "one two three four five one two, three. four")
