"""Removal of repeated 100-byte strings with suffix arrays by two-stage sorting (operator 8).

A byte goes if it lies in a string of ``length`` bytes that also starts earlier, by
(doc_id, start). Strings are judged on the input and never cross documents.

Which suffixes meet. Every window of ``length`` bytes has an anchor, the leftmost of
its smallest ``GRAM``-byte runs in an order of hashes, so equal windows have equal
anchors in equal places. Neighbouring windows of one anchor form a run. Runs whose
anchor occurs once in the corpus can't repeat; of runs with equal bytes all but the
first are repeats. What is left are different runs around one anchor, mostly at the
ends of repeats: their bytes are fetched, and suffixes are sorted by anchor.

Anchors with more than ``GROUP_RUNS`` different runs are narrowed first: the windows
of a run are dealt into halves by where the anchor lies, each with a longer string
that all its windows share, until groups are small or windows stand alone.

Sorting. Suffixes smaller than their successors (type B) are sorted directly; the
others (type A) are induced: scanning the buckets of first bytes in order puts the
predecessor of each suffix into its own bucket. Common prefixes of neighbours in
that order tell which windows are equal; all but the first of them are repeats.

Null texts count as empty. Rows without doc_id come first in the order. Rows that
repeat a doc_id stand one behind the other by text hash; equal rows are one
document and end up alike. Texts of any length are read whole, in pieces. Runs are
told apart by 128 bits of hashes. Other columns come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import crowded, cut, packed, unpacked

LENGTH, GRAM = 100, 24
PIECE = 1 << 20
#: Different runs of an anchor that are sorted together at most; bytes that a task sorts at a time.
GROUP_RUNS, SORT_BYTES = 2048, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 24) - 1)
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, of its inverse, and a random word for each byte."""
    n = PIECE + 4 * LENGTH + 2
    up, down = (np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(b), np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down, np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64)


def runs(data: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(key, digest, start, windows, anchor - start) of every run of the windows that ``first`` allows to start.

    ``data`` holds at most PIECE bytes and what the last windows need.
    """
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length or not first.any():
        return none
    up, down, words = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words[data] * up[: len(data)], out=total[1:])
    n = len(data) - GRAM + 1
    gram = _mix((total[GRAM:] - total[:n]) * down[:n])
    least = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    starts = np.flatnonzero(first[: len(least)])
    if not len(starts):
        return none
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    start, anchor = starts[at], anchor[at]
    count = np.diff(np.append(at, len(starts)))
    digest = (total[start + count + length - 1] - total[start]) * down[start]
    digest = _mix(digest + U(_BASE) * (count + 1000 * (anchor - start)).astype(np.uint64))
    return gram[anchor], digest, start, count, anchor - start


def _combine(key, digest, d, h, s) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the first, by (d, h, s), of their (key, digest); rows that are no twin of the one before, by all five)."""
    order = np.lexsort((s, h, d, digest, key))
    head, own = np.ones((2, len(order)), bool)
    head[1:] = _differ(order, key, digest)
    own[1:] = head[1:] | _differ(order, d, h, s)
    first, single = np.zeros((2, len(order)), bool)
    first[order[head]], single[order[own]] = True, True
    return first, single


def _differ(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in some column, from the second row on."""
    return np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])


RUN = "key long, digest long, d long, h long, s long, n int, off int"
_RUN_NAMES = ["key", "digest", "d", "h", "s", "n", "off"]
_RUN_KINDS = [pa.int64()] * 5 + [pa.int32()] * 2


def _run_batch(key, digest, d, h, s, n, off) -> pa.RecordBatch:
    """Rows to be grouped by key. A run that is known to be a repeat has n < 0 and a key of its own."""
    if not len(key):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in _RUN_KINDS], _RUN_NAMES)
    first, single = _combine(key, digest, d, h, s)
    key, digest, d, h, s, n, off, first = (x[single] for x in (key, digest, d, h, s, n, off, first))
    n = np.where(first, n, -n)
    key = np.where(first, key, _mix(h.view(np.uint64) + s.astype(np.uint64)))
    digest = np.where(first, digest, U(0))
    columns = [key.view(np.int64), digest.view(np.int64), d, h, s, n.astype(np.int32), off.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RUN_KINDS, strict=True)], _RUN_NAMES)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where windows may start, document of each byte, place in it), of about PIECE bytes at most."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        lengths = np.array([len(x) for _, _, x in held])
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        begin = np.cumsum(lengths) - lengths
        within = np.arange(len(data)) - np.repeat(begin, lengths)
        document = np.repeat(np.array([i for i, _, _ in held]), lengths)
        place = within + np.repeat(np.array([b for _, b, _ in held]), lengths)
        return data, within <= np.repeat(lengths, lengths) - length, document, place

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for b in range(0, len(text) - length + 1, PIECE):
            part = text[b : b + PIECE + length - 1]
            if held and size + len(part) > PIECE:
                yield joined()
                held, size = [], 0
            held.append((i, b, part))
            size += len(part)
    if held:
        yield joined()


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "h"))
        found: list[tuple] = []
        for data, first, document, place in _pieces([(t or "").encode() for t in batch.column("t").to_pylist()], length):
            key, digest, start, n, off = runs(data, first, length)
            found.append((key, digest, d[document[start]], h[document[start]], place[start], n, off))
        if found:
            yield _run_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))


SORTED = "key long, d long, h long, s long, n int, off int"
_SORTED_NAMES = ["key", "d", "h", "s", "n", "off"]


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, digest, d, h, s): passes on repeats (n < 0) and first runs of keys that have several.

    Nothing is gathered: of the last key only its last digest and, while it is the only one, its first run are kept.
    """
    last_key = last_digest = last_place = None
    single: pa.RecordBatch | None = None  # the only run so far of the last key
    for batch in batches:
        if not batch.num_rows:
            continue
        key, digest, d, h, s, n = (batch.column(c).to_numpy() for c in ("key", "digest", "d", "h", "s", "n"))
        known = n < 0
        same_key, same, twin = np.zeros((3, len(key)), bool)
        same_key[1:] = key[1:] == key[:-1]
        same[1:] = same_key[1:] & (digest[1:] == digest[:-1])
        twin[1:] = same[1:] & (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        if last_key is not None and key[0] == last_key:
            same_key[0], same[0] = True, digest[0] == last_digest
            twin[0] = same[0] and (d[0], h[0], s[0]) == last_place
        head = ~same & ~known
        group = np.cumsum(~same_key)  # 0: the last batch's last key
        heads = np.bincount(group[head], minlength=group[-1] + 1)
        carried = last_key is not None and key[0] == last_key
        if carried and (single is None or heads[0]):
            heads[0] += 2  # this key has several
        if single is not None and (not carried or heads[0]):
            if carried:
                yield _as_sorted(single)
            single = None
        elif single is not None and group[-1] > 0:
            single = None
        several = heads[group] >= 2
        final = group == group[-1]
        take = (known | same | (head & several)) & ~twin
        n = np.where(known | same, -np.abs(n), n)
        out = batch.set_column(5, "n", pa.array(n, pa.int32()))
        yield _as_sorted(out.filter(pa.array(take)))
        waiting = head & final & ~several
        if waiting.any():
            single = batch.filter(pa.array(waiting))
        last_key, last_digest, last_place = key[-1], digest[-1], (d[-1], h[-1], s[-1])


def _as_sorted(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in _SORTED_NAMES], _SORTED_NAMES)


TEXTED = "key long, d long, h long, s long, n int, off int, seg binary"


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents with their list of runs: the bytes of each run."""
    for batch in batches:
        rows: list[tuple] = []
        for d, h, t, needed in zip(*(batch.column(c).to_pylist() for c in ("d", "h")), unpacked(batch.column("t")), batch.column("needed").to_pylist(), strict=True):
            for r in needed:
                rows.append((r["key"], d, h, r["s"], r["n"], r["off"], t[r["s"] : r["s"] + r["n"] + length - 1]))
                if len(rows) >= 20_000:
                    yield _texted(rows)
                    rows = []
        if rows:
            yield _texted(rows)


def _texted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_SORTED_NAMES, "seg"])


def _halve(batches: Iterator[pa.RecordBatch], level: int, length: int) -> Iterator[pa.RecordBatch]:
    """Runs dealt into ranges of 2**level places of the anchor, keyed by what all windows of a range share.

    Of parts with equal key and bytes within a batch only the first goes on; the others are repeats.
    """
    width = 1 << level
    for batch in batches:
        rows: list[tuple] = []
        for d, h, s, n, off, seg in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "s", "n", "off", "seg")), strict=True):
            low = off - n + 1
            for r in range(low // width, off // width + 1):
                o_low, o_high = max(low, r * width), min(off, r * width + width - 1)
                begin = off - o_high  # of the first window of this part, from s
                core = seg[max(0, off - r * width) : off + length - min(length - GRAM, r * width + width - 1)] if r * width <= off else b""
                part = seg[begin : begin + (o_high - o_low) + length]
                key = xxhash.xxh64_intdigest(core, 1000 * level + r)
                rows.append((key, xxhash.xxh64_intdigest(part, o_high), d, h, s + begin, o_high - o_low + 1, o_high, part))
        if not rows:
            continue
        key, digest, d, h, s, n, off, seg = zip(*rows, strict=True)
        key, digest = np.array(key, np.uint64), np.array(digest, np.uint64)
        numbers = [np.array(x, np.int64) for x in (d, h, s, n, off)]
        first, single = _combine(key, digest, *numbers[:3])
        key, first, numbers = key[single], first[single], [x[single] for x in numbers]
        seg = [x for x, y in zip(seg, single, strict=True) if y]
        numbers[3] = np.where(first, numbers[3], -numbers[3])
        key = np.where(first, key, _mix(numbers[1].view(np.uint64) + numbers[2].astype(np.uint64)))
        segs = [x if f else None for x, f in zip(seg, first, strict=True)]
        columns = [pa.array(key.view(np.int64)), *(pa.array(x) for x in numbers[:3]), *(pa.array(x, pa.int32()) for x in numbers[3:]), pa.array(segs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*_SORTED_NAMES, "seg"])


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of bytes below 255, in order of the first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    up = np.empty(n, np.int8)  # sign of the next byte minus this one; the end is smaller than any byte
    up[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    up[-1] = -1
    move = np.where(up != 0, np.arange(n), n)
    small = up[np.minimum.accumulate(move[::-1])[::-1]] > 0  # type B: smaller than its successor
    b = np.flatnonzero(small)
    padded = np.zeros(n + depth, np.uint8)
    padded[:n] = text + 1  # 0 is left to the end
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[b]
    b = b[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    by_byte = np.searchsorted(text[b], np.arange(257))  # sorted, so first bytes ascend
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Type A predecessors, into the buckets of their bytes; those of bucket ``c`` are returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        first = text[before]
        for x in np.unique(first):
            if x != c:
                induced[x].append(before[first == x])
        return before[first == c]

    induced[text[-1]].append(np.array([n - 1]))  # from the end of the text
    for c in range(256):
        at = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(at):
            out.append(at)
            at = induce(at, c)
        own = b[by_byte[c] : by_byte[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``depth``; both have as many bytes."""
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 15):
        differ = view[a[at : at + (1 << 15)]] != view[b[at : at + (1 << 15)]]
        out[at : at + (1 << 15)] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def repeats(segments: list[bytes], windows: np.ndarray, d: np.ndarray, h: np.ndarray, s: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that equals an earlier one; segment i holds ``windows[i]`` windows."""
    text = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in segments])[:-1]])
    window = np.full(len(text), -1, np.int32)
    owner = np.repeat(np.arange(len(segments)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[owner] + inside
    window[starts] = np.arange(len(owner))
    order = window[two_stage(text, length)]
    order = order[order >= 0]  # windows in order of suffixes
    equal = np.zeros(len(order), bool)
    equal[1:] = common_prefix(text, starts[order[:-1]], starts[order[1:]], length) >= length
    group = np.cumsum(~equal) - 1
    columns = (s[owner] + inside, h[owner], d[owner])
    by_place, rank = np.lexsort(columns), np.zeros(len(owner), np.int64)
    rank[by_place[1:]] = np.cumsum(_differ(by_place, *columns))  # twins share a rank
    earliest = np.full(group[-1] + 1 if len(group) else 0, len(owner))
    np.minimum.at(earliest, group, rank[order])
    again = order[rank[order] != earliest[group]]
    return owner[again], inside[again]


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; whole keys are sorted together, several at a time."""
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> pa.RecordBatch:
        n, d, h, s = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "d", "h", "s"))
        owner, inside = repeats(rows.column("seg").to_pylist(), n, d, h, s, length)
        order = np.lexsort((inside, owner))
        owner, inside = owner[order], inside[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(owner)))
        o, b = owner[at], s[owner[at]] + inside[at]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d[o], h[o], b, b + count + length - 1)], ["d", "h", "b", "e"])

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            held.append(batch.slice(at, 2000))
            if sum(x.nbytes for x in held) < SORT_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.searchsorted(rows.column("key").to_numpy(), rows.column("key")[-1].as_py()))
            if whole:
                yield work(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


SPANS = "d long, h long, b long, e long"


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, h, b, e): bytes [b, e) of document (d, h) are repeats; spans may overlap. ``docs`` has (d, h, t)."""
    parts = crowded(docs.sparkSession)
    found = docs.mapInArrow(lambda it: _scan(it, length), RUN)
    dealt = found.repartition(parts, "key").sortWithinPartitions("key", "digest", "d", "h", "s")
    sifted = cut(dealt.mapInArrow(_sift, SORTED))
    known = lambda x: x.filter("n < 0").select("d", "h", F.col("s").alias("b"), (F.col("s") - F.col("n") + length - 1).alias("e"))
    done = [known(sifted)]
    needed = sifted.filter("n > 0").groupBy("d", "h").agg(F.collect_list(F.struct("key", "s", "n", "off")).alias("needed"))
    left = cut(packed(docs, "d", "h").join(needed, ["d", "h"]).mapInArrow(lambda it: _cut_out(it, length), TEXTED))
    level = (length - GRAM).bit_length()
    while True:
        sizes = left.groupBy("key").agg(F.count("*").alias("c"))
        sized = left.join(sizes, "key")
        small = sized.filter((F.col("c") > 1) & ((F.col("c") <= GROUP_RUNS) | F.lit(level == 0))).drop("c")
        groups = small.repartition(parts, "key").sortWithinPartitions("key", "d", "h", "s")
        done.append(cut(groups.mapInArrow(lambda it: _sorted_groups(it, length), SPANS)))
        large = sized.filter((F.col("c") > GROUP_RUNS) & F.lit(level > 0)).drop("c")
        if level == 0 or large.isEmpty():
            break
        level -= 1
        halves = cut(large.mapInArrow(lambda it, n=level: _halve(it, n, length), TEXTED))
        done.append(known(halves))
        left = halves.filter("n > 0")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, kept = [], [], []
        for text, found in zip(unpacked(batch.column("t")), batch.column("_found").to_pylist(), strict=True):
            merged: list[dict] = []
            for x in sorted((x["b"], x["e"]) for x in found or ()):
                if merged and x[0] <= merged[-1]["e"]:
                    merged[-1]["e"] = max(merged[-1]["e"], x[1])
                else:
                    merged.append({"b": x[0], "e": x[1]})
            t = text or b""
            ends = [0, *(y for x in merged for y in (x["b"], x["e"])), len(t)]
            texts.append(text)
            removed.append(merged)
            kept.append(b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        kind = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
        whole = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), whole, pa.array(removed, kind), pa.array(kept, pa.binary())], ["_row", "t", "removed", "kept"])


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with ``removed`` (maximal spans of bytes, [b, e)) and ``kept`` (the other bytes)."""
    if not GRAM < length < 1 << 12:
        raise ValueError("the length must be above GRAM bytes, and below 4096")
    names = [c for c in df.columns if c not in ("removed", "kept")]
    d = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    t = F.col(text).cast("string")
    # where no id repeats, the id alone names a document, and rows shuffle without a hash of the text
    unique = df.groupBy(d.alias("d")).agg(F.count("*").alias("c")).filter("c > 1").isEmpty()
    h = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(t, F.lit("")))
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text]).alias("_row")

    def keyed(*more: Column) -> DataFrame:
        return df.select(*more, d.alias("d"), h.alias("h"), t.alias("t"))

    found = spans(keyed(), length).groupBy("d", "h").agg(F.collect_set(F.struct("b", "e")).alias("_found"))
    rows = packed(keyed(others), "_row", "d", "h").join(found, ["d", "h"], "left").select("_row", "t", "_found")
    kind = rows.schema["_row"].dataType.simpleString()
    made = rows.mapInArrow(_clean, f"_row {kind}, t string, removed array<struct<b: long, e: long>>, kept binary")
    columns = [F.col("t").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names]
    return made.select(*columns, "removed", "kept")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of what ``remove`` does to every document."""
    sizes = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["b"])
    out = remove(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), sizes.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
