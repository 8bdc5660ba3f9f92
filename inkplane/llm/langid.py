"""Language identification by family first, then by pairwise linear SVMs (operator 1).

Letters of the whole text give a profile: shares of hashed runs of 2 and 3 bytes
of the lower-cased text. One linear SVM for each family, against the rest, picks
the family; within it, one SVM for each pair of its languages votes, and summed
margins break ties. Families are the usual ones of each language code; an unknown
code is a family of its own.

Training reads a bounded sample: ``per_language`` documents of each language,
those of the smallest hash, whole texts. Every SVM is fitted in a task of its own
from these profiles. The weights (buckets x SVMs) are small and fixed in size.

A text that is null or has no letter is ``und`` with score 0, as is every text if
there was nothing to learn from; null and empty languages are not learned. Texts of any
length are read whole, in pieces. One language alone is predicted for all texts with a
letter, score 1. Rows that repeat id or text count as often, in training too, and get
results of their own; equal margins go to the first language by name. An empty table
gives no rows. Other columns come along, whatever their names; ``lang_pred`` and
``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import text_slices

#: Languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne", "si"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
    "malayic": ("id", "ms"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BUCKETS = 1 << 14
#: Documents of a language in the training sample, and rows of one SVM's task at most.
PER_LANGUAGE, TASK_ROWS = 400, 2000
EPOCHS, PENALTY = 40, 1e-4
#: Characters of a text that are profiled at a time.
PIECE = 1 << 20
UNKNOWN = "und"


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def hashed(raw: np.ndarray, width: int) -> np.ndarray:
    """Bucket of the run of ``width`` bytes that starts at each place but the last ones."""
    n = len(raw) - width + 1
    code = np.zeros(max(n, 0), np.uint32)
    for i in range(width):
        code = code * np.uint32(257) + raw[i : i + n]
    code = (code + np.uint32(width)) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def profile(text: str) -> np.ndarray:
    """Shares of the buckets, from pieces of the text; a text too short for a run has none."""
    count, carried = np.zeros(BUCKETS, np.int64), b" "
    for at in range(0, len(text) + 1, PIECE):
        piece = text[at : at + PIECE].lower().encode("utf-8", "replace")
        data = carried + piece + (b" " if at + PIECE > len(text) else b"")
        raw = np.frombuffer(data, np.uint8)
        for width in (2, 3):  # runs that end in this piece
            skip = max(0, len(carried) - width + 1) if at else 0
            count += np.bincount(hashed(raw[skip:], width), minlength=BUCKETS)
        carried = data[-2:]
    return count / max(1, count.sum())


@dataclass(frozen=True)
class Model:
    """Weights (bucket x SVM) with intercepts; SVMs are families first, then pairs within families."""

    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) for rows of margins."""
        n, first = len(margins), len(self.families) if len(self.families) > 1 else 0
        chosen = margins[:, :first].argmax(axis=1) if first else np.zeros(n, int)
        squash = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        score = squash(margins[:, :first].max(axis=1)) if first else np.ones(n)
        lang = np.empty(n, object)
        for f, name in enumerate(self.families):
            rows, codes = np.flatnonzero(chosen == f), self.languages[name]
            votes, total, least = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes))), np.full((len(rows), len(codes)), np.inf)
            for p, (a, b) in enumerate(self.pairs):
                if a in codes:
                    m, i, j = margins[rows, first + p], codes.index(a), codes.index(b)
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    total[:, i] += m
                    total[:, j] -= m
                    least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            best = (votes + 1e-3 * np.tanh(total)).argmax(axis=1)
            lang[rows] = np.array(codes, object)[best]
            if len(codes) > 1:
                score[rows] *= squash(least[np.arange(len(rows)), best])
        return lang, score


def fit_svm(x: np.ndarray, y: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged stochastic subgradients, in a fixed order. Classes weigh alike whatever their sizes."""
    order = np.arange(len(x)) if order is None else order
    rng = np.random.default_rng(0)
    n = len(x)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    w, b, mean_w, mean_b, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    for epoch in range(EPOCHS):
        for at in np.array_split(order[rng.permutation(n)], max(1, n // 16)):
            t += 1
            rate = 1 / (PENALTY * (t + 1 / PENALTY))
            slack = y[at] * (x[at] @ w + b) < 1
            step = (weight[at] * y[at] * slack) / len(at)
            w = (1 - rate * PENALTY) * w + rate * (step @ x[at])
            b += rate * 0.1 * step.sum()
            if epoch >= EPOCHS // 2:
                mean_w += w
                mean_b += b
    steps = max(1, t - (EPOCHS // 2) * max(1, n // 16))
    return mean_w / steps, mean_b / steps


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, place, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "place", "text")), strict=True):
            share = profile(text)
            at = np.flatnonzero(share)
            row = [pa.array([lang]), pa.array([place], pa.int32()), pa.array([at.astype(np.int32)]), pa.array([share[at].astype(np.float32)])]
            yield pa.RecordBatch.from_arrays(row, ["lang", "place", "at", "share"])


def _fit(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    (task,) = (k.as_py() for k in key)
    x = np.zeros((part.num_rows, BUCKETS), np.float32)
    lists = part.column("at").combine_chunks()
    rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
    x[rows, lists.flatten().to_numpy()] = part.column("share").combine_chunks().flatten().to_numpy()
    x = np.sqrt(x, out=x)  # shares become rows of length 1, and the most frequent runs weigh less
    order = sorted(range(len(x)), key=lambda i: xxhash.xxh64_intdigest(x[i]))  # rows come in any order
    w, b = fit_svm(x, part.column("y").to_numpy().astype(float), np.array(order))
    return pa.table({"task": pa.array([task], pa.int32()), "w": [w.astype(np.float32)], "b": [float(b)]})


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, place, text): ``per_language`` documents of each language at most, those of the smallest hashes of id and text.

    Every task passes on no more than these of its own rows (a group limit), so no language meets whole in one.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & has_letter(F.col("text")))
    rows = usable.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("_h"))
    order = Window.partitionBy("lang").orderBy("_h", F.md5("text"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language).select("lang", "place", "text")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from (doc_id, lang, text); None if no document has a language and a letter."""
    rows = sample(docs, per_language).mapInArrow(_profiles, "lang string, place int, at array<int>, share array<float>")
    rows = rows.persist()
    try:
        codes = sorted(r[0] for r in rows.select("lang").distinct().collect())
        if not codes:
            return None
        families = tuple(sorted({family(c) for c in codes}))
        languages = {f: tuple(c for c in codes if family(c) == f) for f in families}
        pairs = tuple(p for f in families for p in combinations(languages[f], 2))
        heads = list(families) if len(families) > 1 else []
        each = max(10, TASK_ROWS // len(codes))
        roles = [(t, c, 1 if family(c) == f else -1, each) for t, f in enumerate(heads) for c in codes]
        roles += [(len(heads) + t, c, 1 if c == p[0] else -1, TASK_ROWS // 2) for t, p in enumerate(pairs) for c in p]
        weights, intercepts = np.zeros((BUCKETS, len(heads) + len(pairs)), np.float32), np.zeros(len(heads) + len(pairs))
        if roles:
            tasks = docs.sparkSession.createDataFrame(roles, "task int, lang string, y int, most int")
            dealt = rows.join(F.broadcast(tasks), "lang").filter(F.col("place") <= F.col("most"))
            fitted = dealt.groupBy("task").applyInArrow(_fit, "task int, w array<float>, b double")
            for r in fitted.collect():  # the model: buckets x SVMs, a fixed size
                weights[:, r.task], intercepts[r.task] = r.w, r.b
        return Model(families, languages, pairs, weights, intercepts)
    finally:
        rows.unpersist()


def _margins(texts: list[str], model: Model) -> np.ndarray:
    out = np.empty((len(texts), model.weights.shape[1]))
    for i, text in enumerate(texts):
        share = profile(text)
        at = np.flatnonzero(share)
        out[i] = np.sqrt(share[at]) @ model.weights[at] + model.intercepts
    return out


def _predict(batches: Iterator[pa.RecordBatch], shared, keep_text: bool) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        for start, n in text_slices(batch, "_text"):
            part = batch.slice(start, n)
            texts, letters = part.column("_text").to_pylist(), part.column("_letter").to_numpy(zero_copy_only=False)
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            at = np.flatnonzero(letters)
            if len(at):
                lang[at], score[at] = model.predict(_margins([texts[i] for i in at], model))
            names = [n for n in ("_row", "_text") if n == "_row" or keep_text]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``df`` with ``lang_pred`` and ``score`` (0 to 1). Nothing but the text is looked at."""
    names = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if model is None:
        return df.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # the text goes to Python once, and comes back only if it is kept
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text])
    rows = df.select(others.alias("_row"), F.col(text).cast("string").alias("_text"), has_letter(F.col(text)).alias("_letter"))
    shared, keep_text = df.sparkSession.sparkContext.broadcast(model), text in names
    kind = f"_row {rows.schema['_row'].dataType.simpleString()}{', _text string' if keep_text else ''}, lang_pred string, score double"
    made = rows.mapInArrow(lambda it: _predict(it, shared, keep_text), kind)
    return made.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id's text divisible by 5; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def predictions(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, learned from the others' languages."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), per_language)
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
