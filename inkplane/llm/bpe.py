"""BPE encoding and decoding with a public vocabulary file (operator 10).

Method: the symbols of a word form a doubly linked list, a heap holds the merge
ranks of adjacent pairs, and entries whose symbols changed meanwhile are skipped.
Decoding concatenates vocabulary strings. A word's merges depend on nothing but
the word, so the runs between white space are numbered within a slice of a batch
(Arrow), each different one is merged once, and the ids of all texts are taken from
those of the runs.

Letters, numbers, white space, lower case and composed forms have to be those of the
tokenizers library, whose Unicode tables are of another version than Python's. Runs
of the blocks in ``SAME``, where both agree on every code point, are normalised and
split in Python, texts with any other character by the library's own normaliser and
splitter of the file. Merging and decoding are never left to it.

Null texts count as empty and give no tokens; a text of any length is encoded whole.
Rows that repeat stay rows of their own, null keys stay null, an empty table gives
no rows, columns other than the key are left behind whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from inkplane.llm.common import text_slices

#: Words remembered by a task in each of two generations, and the longest of them; both bound memory only.
KEPT_WORDS, KEPT_LENGTH = 150_000, 64
#: Bytes of text that are numbered and encoded at a time.
SLICE = 8 << 20
#: Blocks of code points on which Python and the library agree (Latin, Greek, Cyrillic, punctuation, kana, Han, Hangul).
SAME = ((0x00, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x205E), (0x3001, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


#: Stands before a special token among the runs.
SPECIAL = "A"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free letter from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + n) for n, b in enumerate(spare)}


class Bpe:
    """A vocabulary with word ends, lower case and dropped white space, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = len(self.vocab)
        self.ranks = {self.vocab[a] * self.size + self.vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = regex.compile("[^" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in SAME) + "]")
        self.space = regex.compile(r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        bare = {**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(bare))
        letters = _byte_letters()
        self.first = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.end] for b in range(256)]
        self.by_id = pa.array([self.strings.get(i) for i in range(max(self.strings) + 1)], pa.string())
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        first, made, rank_of, size = self.first, self.made, self.ranks.get, self.size
        raw = word.encode()
        ids = [first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        # rank of every symbol with its right neighbour; an entry is rank * n + place: ordered by rank, then from the left
        now = [rank_of(a * size + b, -1) for a, b in pairwise(ids)]
        now.append(-1)
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank = entry // n
            i = entry - rank * n
            if now[i] != rank:
                continue  # stale: one of the two symbols has been merged since
            j = right[i]
            ids[i] = new = made[rank]
            ids[j] = now[j] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                now[i] = r = rank_of(new * size + ids[k], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            else:
                now[i] = -1
            h = left[i]
            if h >= 0:
                now[h] = r = rank_of(ids[h] * size + new, -1)
                if r >= 0:
                    heappush(heap, r * n + h)
        return tuple([x for x in ids if x >= 0])

    def remembered(self, run: str) -> tuple[int, ...]:
        """Ids of a word or run: a word by itself is split into nothing but itself."""
        ids = self.young.get(run)
        if ids is None:
            ids = self.old.get(run)
            if ids is None:
                ids = self.of_run(run)
            if len(run) <= KEPT_LENGTH:
                if len(self.young) >= KEPT_WORDS:
                    self.old, self.young = self.young, {}
                self.young[run] = ids
        return ids

    def of_run(self, run: str) -> tuple[int, ...]:
        """Ids of a run without white space: those of its words."""
        if run[0] == SPECIAL:
            return (self.special[run[1:]],)
        if not run.isascii() and self.odd.search(run):
            words = [run[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(run)]
        elif run.isalpha():
            return self.merge(run)
        elif run[:-1].isalpha() and not run[-1].isalpha():  # a word and the mark behind it
            words = [run[:-1], run[-1]]
        else:
            words = self.word.findall(run)
        if len(words) == 1:
            return self.merge(run)
        return tuple(chain.from_iterable([self.remembered(w) for w in words]))

    def plain(self, text: str) -> str:
        """A text without special tokens, normalised; single white-space characters become spaces."""
        if text.isascii():
            return self.space.sub(" ", text.lower())
        if self.odd.search(text):
            return self.space.sub(" ", self.library.normalizer.normalize_str(text))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form of sigma here
        return self.space.sub(" ", text.lower())

    def normal(self, text: str | None) -> str:
        """Runs of a text, separated by spaces; special tokens are runs behind a letter that lower case never has."""
        text = (text or "").encode("utf-8", "replace").decode() if text and not text.isascii() else text or ""
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        return " ".join([SPECIAL + part if part in self.special else self.plain(part) for part in self.specials.split(text)])

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of every text: those of each different run, taken for all its occurrences."""
        split = pc.split_pattern(pa.array([self.normal(t) for t in texts], pa.string()), " ")
        runs = split.flatten().dictionary_encode()
        codes = runs.indices.to_numpy()
        known, other = self.young.get, self.remembered
        ids = [known(r) or other(r) if r else () for r in runs.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))
        before = np.concatenate([[0], np.cumsum(size[codes])])
        places = before[split.offsets.to_numpy()].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(places), listed.take(runs.indices).flatten())

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """Vocabulary strings joined by one space; null for null."""
        flat = self.by_id.take(ids.flatten())
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, flat), " ")
        return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string())) if ids.null_count else joined

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].as_py()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        for start, n in text_slices(batch, text, SLICE):
            part = batch.slice(start, n)
            made = bpe.encode_all(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], [*names, "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode_all(batch.column(ids))], [*batch.schema.names, out])


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array<int>), a row for each row of ``df``. Other columns are left behind.

    ``path`` names the vocabulary file, on every executor.
    """
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(lambda it: _encode_batches(it, path, "_text"), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``: vocabulary strings joined by one space, as the file names no decoder.

    A column of the name ``out`` is replaced; an id beyond the vocabulary is an error.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInArrow(lambda it: _decode_batches(it, path, ids, out), schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` and ``decoded``: encoding and decoding in one Python worker instead of two."""
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decode_batches(_encode_batches(batches, path, "_text"), path, "ids", "decoded")
        pa.default_memory_pool().release_unused()  # the worker stays, idle, for later stages

    return rows.mapInArrow(run, schema)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """The digests of ids and of decoded texts, one row for each document."""
    both = round_trip(docs, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
