"""Language ID: held-out accuracy, families, and odd texts."""

import numpy as np

from inkplane.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"
SOUNDS = {"en": "the of ing and tion wh er", "de": "der ung sch keit ein und ä", "es": "de ción os que la ar ñ", "fr": "le eau tion é de oux ment", "xx": "ka ku ki mo ma zu ri"}


def prose(rng, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def documents(n=300):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, lang, int(rng.integers(3, 80))), lang, None, "old") for i in range(n) for lang in [list(SOUNDS)[i % 5]]]
    odd = [None, "", "123 4 !", "\n\t", "ç", "the " * 200_000]
    return rows + [(1000 + i, t, None, 1.0, None) for i, t in enumerate(odd)] + [(None, "the ing of and wh", "en", None, None), rows[0]]


def test_accuracy_on_held_out_documents(spark):
    rows = documents()
    got = langid.predictions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and lang.get(r.doc_id)]
    assert len(held) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    named = {r.doc_id: r.lang_pred for r in got}
    assert [named[1000 + i] for i in range(4)] == ["und"] * 4
    assert named[1004] != "und" and named[1005] == "en" and named[None] == "en"


def test_nothing_to_learn_from(spark):
    assert langid.predictions(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.predictions(none).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(i, f"word {i}", "en", None, None) for i in range(10)], SCHEMA)
    assert {r.lang_pred for r in langid.predictions(one).collect()} == {"en"}


def test_extra_columns_stay(spark):
    df = spark.createDataFrame(documents(50), SCHEMA)
    out = langid.identify(df, langid.fit(df))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.count() == df.count()


def test_families():
    assert langid.family("pt-BR") == "romance" and langid.family("xx") == "xx"


def test_runs_of_three_letters_keep_apart():
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    runs = np.stack(np.meshgrid(letters, letters, letters), -1).reshape(-1, 3)
    assert len({int(langid.hashed(r, 3)[0]) for r in runs}) > 7000


def test_one_id_on_every_row(spark):
    rng = np.random.default_rng(6)
    rows = [(7, prose(rng, lang, 30), lang, None, None) for _ in range(500) for lang in ("en", "fr")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.identify(df, langid.fit(df, 100)).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    same = spark.createDataFrame([(7, "the ing of and wh", "en", None, None)] * 900 + [(7, "le eau tion de oux", "fr", None, None)] * 900, SCHEMA)
    assert {(r.lang, r.lang_pred) for r in langid.identify(same, langid.fit(same, 50)).collect()} == {("en", "en"), ("fr", "fr")}


def test_profiles_of_pieces(monkeypatch):
    text = "Über den Wolken, " * 40 + "ß é ñ " * 30
    whole = langid.profile(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "PIECE", size)
        assert np.array_equal(langid.profile(text), whole)
    assert langid.profile("a").sum() > 0
