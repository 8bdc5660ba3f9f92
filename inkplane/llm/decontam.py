"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 12).

Symbols are words: runs of digits, a-z (A-Z lower-cased) and code points from U+0080
on. Test strings are the windows of ``WINDOW`` consecutive words of each item, or an
item's whole sequence where it has fewer. For each length of test string a table of
shifts, by a hash of a block of two words, tells how far a scan may jump from where it
stands; only where the shift is zero are test strings looked up, by the hash of that
block and the window's, and compared byte by byte. Many lanes of one text scan at once.

Test strings are dealt evenly into shards of about ``SHARD`` (string, item) pairs, each
a file in the shared folder; a task holds one shard and one piece of text at a time, so
neither the benchmark's size nor a string that very many items share grows its memory.
Texts of any length go by in pieces that overlap by a window.

Null texts and items have no words. Repeated rows get a result each; an item's rows that
repeat its id are one item; what items without id hit counts as hit, but they are no
items of a document. Empty tables give no rows or no hits. Other columns are left
behind, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkplane.llm.common import fresh_path, text_slices

WINDOW = 10
#: Pairs of test string and item that a task holds at once.
SHARD = 1 << 17
#: Bytes of a long text that are looked at together; positions that a lane scans.
PIECE, LANE = 1 << 20, 128
#: Logarithm of the size of a table of shifts.
BITS = 18

#: Word bytes, lower-cased; zero for others.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)
SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
#: Between texts: a word that no UTF-8 text has.
BARRIER = b"\n\xff\n"

# odd multipliers of the hashes; what they miss is only speed, as strings are compared in the end
_BYTE, _WORD, _BLOCK, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93
_powers = {_BYTE: np.ones(1, np.uint64), pow(_BYTE, -1, 1 << 64): np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        most = np.full(max(n, PIECE + 4096), base, np.uint64)
        most[0] = 1
        _powers[base] = np.multiply.accumulate(most)
    return _powers[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of some bytes: hashes, and where they are in the bytes and in ``text``, which has one space behind each."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    text: bytes

    def string(self, first: int, last: int) -> bytes:
        return self.text[self.at[first] : self.at[last] + self.end[last] - self.begin[last]]


def words(data: bytes) -> Words:
    low = FOLD[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low > 0
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept = (inside[1:-1] | inside[:-2]).astype(bool)  # word bytes, and the first byte behind each word
    text = low[kept]
    at = np.cumsum(end - begin + 1) - (end - begin + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(text * _power(_BYTE, len(text)), out=sums[1:])
    hashes = (sums[at + end - begin] - sums[at]) * _power(pow(_BYTE, -1, 1 << 64), len(text) + 1)[at]
    text[text == 0] = 32
    return Words(_mixed(hashes), begin, end, at, text.tobytes())


def _block(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the block of words that ends at ``at``."""
    own = h[at] * np.uint64(_BLOCK)
    if length > 1:
        own = own + h[at - 1]
    return (_mixed(own) >> np.uint64(64 - BITS)).astype(np.int64)


def _prints(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that end at ``at``."""
    total = np.zeros(len(at), np.uint64)
    for k in range(length):
        total = total * np.uint64(_WORD) + h[at - length + 1 + k]
    return _mixed(total)


@dataclass
class Class:
    """Test strings of one length: shifts by block, and the strings in order of block and hash."""

    length: int
    strings: list[bytes]
    ids: np.ndarray
    shift: np.ndarray = field(default=None)
    keys: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        w = words(b"\n".join(self.strings))
        last = np.arange(len(self.strings)) * self.length + self.length - 1
        size = min(2, self.length)  # words of a block
        self.shift = np.full(1 << BITS, self.length - size + 1, np.uint8)
        for back in range(self.length - size, -1, -1):  # smaller shifts come later and win
            self.shift[_block(w.hashes, last - back, self.length)] = back
        keys = self._key(w.hashes, last)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids, self.strings = keys[order], self.ids[order], [self.strings[i] for i in order]

    def _key(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (_block(h, at, self.length).astype(np.uint64) << np.uint64(64 - BITS)) | (_prints(h, at, self.length) >> np.uint64(BITS))

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, string's id) of every occurrence."""
        h, n = w.hashes, len(w.hashes)
        at = np.arange(self.length - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        hits = [np.zeros(0, np.int64)]
        while len(at):
            step = self.shift[_block(h, at, self.length)]
            hits.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        at = np.concatenate(hits)
        key = self._key(h, at)
        left, right = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = np.flatnonzero(right > left)
        good_at, good = [], []
        for p, a, b in zip(at[some].tolist(), left[some].tolist(), right[some].tolist(), strict=True):
            string = w.string(p - self.length + 1, p)
            for i in range(a, b):
                if self.strings[i] == string:
                    good_at.append(p)
                    good.append(i)
        return np.array(good_at, np.int64), self.ids[np.array(good, np.int64)]


@dataclass
class Shard:
    """Classes of test strings, and the items of each string."""

    classes: list[Class]
    items: list[list[str]]

    @classmethod
    def made(cls, strings: list[str], items: list[str | None]) -> Shard:
        owners: dict[str, list[str]] = {}
        for s, i in zip(strings, items, strict=True):
            owners.setdefault(s, []).extend([] if i is None else [i])
        by: dict[int, list[int]] = {}
        every = sorted(owners)
        for i, s in enumerate(every):
            by.setdefault(s.count(" ") + 1, []).append(i)
        return cls([Class(n, [every[i].encode() for i in of], np.array(of)) for n, of in sorted(by.items())], [owners[s] for s in every])


# --- test strings ------------------------------------------------------------------------


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, length in text_slices(batch, "t", PIECE):
            part = batch.slice(start, length)
            strings, items = [], []
            for item, text in zip(part.column("i").to_pylist(), part.column("t").to_pylist(), strict=True):
                total = 0
                for piece, _, again in _pieces((text or "").encode()):
                    w = words(piece)
                    n, total = len(w.hashes), total + len(w.hashes) - again
                    made = {w.string(k, k + WINDOW - 1).decode() for k in range(n - WINDOW + 1)}
                    strings += made
                    items += [item] * len(made)
                if 0 < total < WINDOW:  # then the last piece has them all
                    strings.append(w.string(0, total - 1).decode())
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(items, pa.string())], ["s", "i"])


def _file(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Writes a shard under a temporary name, then moves it."""
    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    name, temporary = f"shard-{TaskContext.get().partitionId()}", f"{path}/{uuid.uuid4().hex}.part"
    kinds, n = pa.schema([("s", pa.string()), ("i", pa.string())]), 0
    with files.open_output_stream(temporary) as raw, pa.ipc.new_stream(raw, kinds) as out:
        for batch in batches:
            out.write_batch(batch.cast(kinds))
            n += batch.num_rows
    if n:
        files.move(temporary, f"{path}/{name}")
    else:
        files.delete_file(temporary)
    yield pa.RecordBatch.from_arrays([pa.array([name] * bool(n), pa.string())], ["name"])


def shards(items: DataFrame) -> tuple[str, list[str]]:
    """Folder and names of the files that hold the test strings of (item_id, text), evenly dealt."""
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    pairs = rows.mapInArrow(_windows, "s string, i string").distinct()
    root = fresh_path(items.sparkSession, "decontam")
    pairs.write.parquet(f"{root}/pairs")
    pairs = items.sparkSession.read.schema("s string, i string").parquet(f"{root}/pairs")
    parts = -(-pairs.count() // SHARD)
    if not parts:
        return root, []
    named = pairs.repartition(parts).mapInArrow(lambda it: _file(it, root), "name string")
    return root, sorted(r.name for r in named.collect())


_held: dict[str, Shard] = {}


def _load(root: str, name: str) -> Shard:
    """A shard; a worker keeps the last one."""
    key = f"{root}/{name}"
    if key not in _held:
        _held.clear()
        files, path = fs.FileSystem.from_uri(root)
        with files.open_input_stream(f"{path}/{name}") as raw, pa.ipc.open_stream(raw) as stream:
            table = stream.read_all()
        _held[key] = Shard.made(table.column("s").to_pylist(), table.column("i").to_pylist())
    return _held[key]


# --- documents ---------------------------------------------------------------------------


def _pieces(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, where they begin, words that the piece before had too): pieces end between words and repeat the last words of the one before."""
    start = again = end = 0
    while True:
        cut = SEPARATOR.search(data, min(end + PIECE, len(data)))
        end = cut.start() if cut else len(data)
        yield data[start:end], start, again
        if end >= len(data):
            return
        w = words(data[start:end])
        again = min(WINDOW - 1, len(w.hashes))
        start = start + int(w.begin[-again]) if again else end


def _runs(w: Words, shard: Shard) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal runs of hit words (first, last + 1), and (last word, string) of the occurrences."""
    change, pairs = np.zeros(len(w.hashes) + 1, np.int32), []
    for c in shard.classes:
        at, which = c.found(w)
        np.add.at(change, at - c.length + 1, 1)
        np.add.at(change, at + 1, -1)
        pairs += zip(at.tolist(), which.tolist(), strict=True)
    inside = np.zeros(len(w.hashes) + 2, np.int8)
    inside[1:-1] = np.cumsum(change)[:-1] > 0
    edge = np.diff(inside)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)), pairs


@dataclass
class Found:
    """What is known of a text so far: words, spans (first word, last + 1, first byte, last + 1), items."""

    n_words: int = 0
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    items: set[str] = field(default_factory=set)

    def merged(self) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        for s in sorted(self.spans):
            if out and s[0] <= out[-1][1]:
                a, b = out[-1], max(out[-1], s, key=lambda x: x[1])
                out[-1] = (a[0], b[1], a[2], b[3])
            else:
                out.append(s)
        return out


def _search(texts: list[bytes], found: list[Found], shard: Shard | None) -> None:
    """Adds to ``found`` what one shard says about some texts; without a shard only words are counted."""
    if len(texts) == 1:
        base = 0
        for piece, begin, again in _pieces(texts[0]):
            w = words(piece)
            if shard is None:
                found[0].n_words += len(w.hashes) - again
            else:
                runs, pairs = _runs(w, shard)
                first = base - again
                found[0].spans += [(first + a, first + b, begin + int(w.begin[a]), begin + int(w.end[b - 1])) for a, b in runs]
                for s in {s for _, s in pairs}:
                    found[0].items.update(shard.items[s])
            base += len(w.hashes) - again
        return
    w = words(BARRIER.join(texts))
    ends = np.cumsum([len(t) + len(BARRIER) for t in texts])
    of = np.searchsorted(ends - len(BARRIER), w.begin, "right")  # barriers belong to the text behind them
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    if shard is None:
        for k, n in enumerate(np.diff(first).tolist()):
            found[k].n_words += n - (k > 0)
        return
    runs, pairs = _runs(w, shard)
    for a, b in runs:
        k = int(of[a])
        word, byte = int(first[k]) + (k > 0), int(ends[k]) - len(BARRIER) - len(texts[k])
        found[k].spans.append((a - word, b - word, int(w.begin[a]) - byte, int(w.end[b - 1]) - byte))
    for k, s in {(int(of[p]), s) for p, s in pairs}:
        found[k].items.update(shard.items[s])


SPAN = "struct<first_word: long, end_word: long, first_byte: long, end_byte: long>"
_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "end_word", "first_byte", "end_byte")]))


def _scan(batches: Iterator[pa.RecordBatch], root: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Found() for _ in range(batch.num_rows)]
        parts = list(text_slices(batch, "t", PIECE))
        for name in [None, *names]:
            shard = _load(root, name) if name else None
            for start, length in parts:
                texts = [(t or "").encode() for t in batch.column("t").slice(start, length).to_pylist()]
                _search(texts, found[start : start + length], shard)
        spans = [[dict(zip(("first_word", "end_word", "first_byte", "end_byte"), s, strict=True)) for s in f.merged()] for f in found]
        columns = [pa.array([f.n_words for f in found], pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(f.items) for f in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "spans", "items"])


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) of documents (doc_id, text): maximal runs of hit words, in words and UTF-8 bytes, and the ids, as sorted strings, of the items (item_id, text) with an occurring window."""
    root, names = shards(items)
    rows = docs.select("doc_id", F.col("text").alias("t"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.DataType.fromDDL(SPAN))), T.StructField("items", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(lambda it: _scan(it, root, names), kind)


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``scan`` as counts and a digest of the items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return scan(docs, items).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )
