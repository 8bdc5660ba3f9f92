"""The pipeline against a brute-force version of its stages."""

import hashlib
import re

import numpy as np
import public_tokenizers
import test_lines
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline

SOUNDS = {"en": "the of ing and tion wh er", "de": "der ung sch keit ein und ä", "es": "de ción os que la ar ñ", "fr": "le eau tion é de oux ment"}


def documents():
    rng = np.random.default_rng(11)

    def line(lang, n):
        parts = SOUNDS[lang].split()
        return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n)).capitalize()

    rows = []
    for i in range(120):
        lang = list(SOUNDS)[i % 4]
        rows.append([i, "\n".join(line(lang, int(rng.integers(5, 30))) for _ in range(int(rng.integers(1, 6)))), lang, f"s{i % 3 if i % 2 else 0}"])
    for i in range(120, 150):
        base = rows[i - 120]
        text = base[1] if i % 2 else re.sub(r"(\S+) (\S+)$", r"\2 \1 more", base[1])
        rows.append([i, text if i % 3 else base[1].replace("\n", " "), base[2], base[3]])
    rows += [[150, None, "en", "s0"], [151, "", None, None], [152, "12 34", "de", "s1"], [153, "All rights reserved.\n" + rows[0][1], None, None], [154, "All rights reserved.", "en", "s2"]]
    return [(*r, len(r[1] or "")) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    after = {x[0]: x for x in test_lines.brute([(r[0], r[1]) for r in kept])}
    left = [(r[0], after[r[0]][1]) for r in kept if after[r[0]][3] == 0 or after[r[0]][3] < after[r[0]][2]]
    component = test_simhash.near_components([r[0] for r in left], [r[1] for r in left])
    left = [r for r, c in zip(left, component, strict=True) if r[0] == c]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, text in left:
        ids = t.encode(text, add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((d, len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_equals_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = brute(rows)
    assert got == want and 60 < len(got) < 140


def scheduled(units, blocks):
    """(slot, source, block) by releases and deadlines; the schedule starts anew when a source runs out."""
    done, slot = dict.fromkeys(units, 0), 0
    while live := [s for s in sorted(units) if done[s] < blocks[s]]:
        total, start, had = sum(units[s] for s in live), slot, dict.fromkeys(live, 0)
        while all(done[s] < blocks[s] for s in live):
            s = min((-(-(had[s] + 1) * total // units[s]), s) for s in live if had[s] * total // units[s] <= slot - start)[1]
            yield slot, s, done[s]
            done[s], had[s], slot = done[s] + 1, had[s] + 1, slot + 1


def mixture(rows, block=16):
    """(slot, place, doc_id) in the order of the mixture, by hand."""
    own = {}
    for d, source in rows:
        own.setdefault("" if source is None else "=" + source, []).append(d)
    most = max(len(x) for x in own.values()) ** 0.5
    blocks = {s: -(-len(x) // block) for s, x in own.items()}
    out = []
    for t, s, k in scheduled({s: int(len(x) ** 0.5 / most * 1e12 + 0.5) for s, x in own.items()}, blocks):
        ids = sorted(own[s], key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
        out += [(t, i, d) for i, d in enumerate(ids[k * block : (k + 1) * block])]
    return out


def test_mixture_orders_the_result(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    source = {r[0]: r[3] for r in rows}
    assert got == [d for _, _, d in mixture([(d, source[d]) for d in got])] and len(got) > 60
    docs = spark.createDataFrame([r for r in rows if r[0] in got], SCHEMA)
    placed = corpus_pipeline.encode_tokens(spark, docs, "").collect()
    assert sorted((r.mix_slot, r.mix_place, r.doc_id) for r in placed) == mixture([(d, source[d]) for d in got])


def test_tokens_stand_where_the_mixture_put_them(spark, tmp_path, monkeypatch):
    """Whatever the mixture stage decides is the order of the result; a stage that mixes otherwise gives another one."""
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 5.0), ("s2", 3.0)], "source string, weight double")
    seen = []

    def weighted(spark, docs, sf_dir):
        mixed = corpus_pipeline.mixing.mix(docs, weights, block_rows=16).persist()
        seen.append([(r.mix_slot, r.mix_place, r.doc_id) for r in mixed.sort("mix_slot", "mix_place").collect()])
        return corpus_pipeline.mixing.in_order(mixed, 3).select(docs.columns)

    def turned(spark, docs, sf_dir):
        return docs.repartitionByRange(3, docs["doc_id"].desc()).sortWithinPartitions(docs["doc_id"].desc())

    for stage in (weighted, turned):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage if n == "mixture" else s) for n, s in corpus_pipeline.STAGES])
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
        assert len(got) > 60 and got == ([d for _, _, d in seen[0]] if stage is weighted else sorted(got, reverse=True))
    docs = spark.createDataFrame([r for r in rows if r[0] in got], SCHEMA)
    weighted(spark, docs, "").write.parquet(f"{tmp_path}/mixed.parquet")
    placed = corpus_pipeline.encode_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed.parquet"), "").collect()
    assert sorted((r.mix_slot, r.mix_place, r.doc_id) for r in placed) == seen[1]


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.createDataFrame([(*r, "more", 1) for r in documents()], SCHEMA + ", lang_pred string, k int")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        sizes.append(out.count())
    assert sizes[0] == 152 and sizes[3] == docs.count()


def test_empty_and_without_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    rows = [(None, "the same words here again", "en", None, 25)] * 3 + [(None, "something quite different from that", None, "a", 3), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [stage(spark, docs, "").count() for _, stage in corpus_pipeline.STAGES] == [4, 3 + 2, 3, 5, 5]


def test_one_id_on_two_texts(spark):
    one, two = "the river runs past the old mill and under the stone bridge", "seven ships with red sails left the northern harbour at dawn"
    rows = [(1, one, "en", "a", 1), (2, two, "en", "a", 1), (2, one, "en", "a", 1)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, one), (2, two)]
    rows = [(2, one, "en", "a", 1), (2, two, "en", "a", 1)]
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 2
