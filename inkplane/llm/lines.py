"""Fuzzy line deduplication by MinHash (operator 7).

Lines (parts of a text between line feeds, other than blank ones) of all documents
are made distinct by hash. A line's shingles are its runs of ``SHINGLE`` characters,
the whole line if it is shorter; runs of 5 keep a line of 85 characters near that has
one word of 5 letters changed. MinHash signatures are cut into bands that find
pairs of Jaccard similarity 0.8 with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.999.
Lines that share a band also need ``AGREE`` equal bits of ``BITS`` one-bit hashes, which
a pair of similarity 0.8 misses less than once in 100,000 times and strangers that
share a band by chance nearly always do. What is left is compared by exact Jaccard
similarity of the shingle sets, every pair once. In a band of more than ``FEW`` lines
all are compared with one of them first, another for each band; only lines that end up
in another component than that one are compared with all lines of the band, in blocks.
Links go to the distributed union-find. Of each component the occurrence of the
smallest (doc_id, text hash, line number) stays.

Null texts stay null; blank lines stay, always. Rows without doc_id come first in
the order. Rows that repeat doc_id and text are one document and end up alike. A
text that loses all its lines becomes empty. An empty table gives no rows. Other
columns come along, whatever their names; ``n_lines`` and ``n_dropped`` are replaced.
A line of any length is compared whole. Lines are told apart by 64-bit hashes.

Bands are shuffled packed: a row holds what a slice of texts has for one target, a range
of band values. A target is sorted in parts of ``HELD`` entries; of crowded bands only one
line is kept while more parts come, so a hot band takes no memory.
The lines to compare are fetched in a second pass over the texts, by a filter of
``FILTER`` bits whatever the number of lines, before they are shuffled; texts are
shuffled once, compressed, to write the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import crowded, cut, packed, stored, text_slices, unpacked
from inkplane.llm.components import components

SHINGLE, ROWS, BANDS, LEAST = 5, 5, 18, 0.8
#: One-bit hashes of a line, and how many of them near lines have in common.
BITS, AGREE = 48, 32
#: Entries (band, line, bits) that a task sorts at a time; members of a band that are compared bit by bit.
HELD, FEW = 1 << 20, 32
#: Bytes of an entry: 40 bits of the band below its target, the line's hash, its bits.
BAND_BYTES, ENTRY = 5, 5 + 8 + BITS // 8
#: Bits of the filter for lines to fetch (4 MB).
FILTER = 1 << 25
#: Lines of a block; rows gathered before blocks are compared.
BLOCK, GATHER = 256, 8192
#: Characters that are hashed at a time (twice as many by 32 bits), so that the work stays in a core's cache; buckets that bound a common part.
STEP, BUCKETS = 1 << 15, 256
#: White space of blank lines.
BLANK = " \t\n\x0b\f\r"
_RNG = np.random.default_rng(77)
_TIMES = _RNG.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * 2 + 1


_SPREAD, _HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all of them, in place."""
    high = x >> _HALF
    for _ in range(2):
        x ^= high
        x *= _SPREAD
        np.right_shift(x, _HALF, out=high)
    x ^= high
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repetition."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def runs(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive runs of lines whose sizes add up to ``limit`` at most; one line at least."""
    ends, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield slice(start, end)
        start = end


def _chars(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all lines, where each line's begin). Short lines are filled up with line feeds, which no line has."""
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\n") for x in lines]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(length) - length


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all lines, where each line's begin). No line may be empty."""
    chars, begin = _chars(lines)
    n = max(len(chars) - SHINGLE + 1, 0)
    code, times = np.empty(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, STEP):
        part, wide = code[at : at + STEP], chars[at : at + STEP + SHINGLE - 1].astype(np.uint64)
        np.multiply(wide[: len(part)], times, out=part)
        for i in range(1, SHINGLE):
            part += wide[i : i + len(part)]
            if i < SHINGLE - 1:
                part *= times
        _mix(part)
    own = np.ones(n, bool)  # runs that don't reach into the next line
    for i in range(1, SHINGLE):
        own[begin[1:] - i] = False
    return code[own], begin - np.arange(len(begin)) * (SHINGLE - 1)


def signatures(lines: list[str]) -> np.ndarray:
    """(hash, line) matrix of least values: products of 32-bit hashes of the shingles with odd numbers."""
    length = np.maximum(np.fromiter(map(len, lines), np.int64, len(lines)), SHINGLE)
    out, buffer = np.empty((ROWS * BANDS, len(lines)), np.uint32), np.empty(0, np.uint32)
    for run in runs(length, 2 * STEP):
        chars, begin = _chars(lines[run])
        n = len(chars) - SHINGLE + 1
        low, times = chars[:n] * np.uint32(0x9E3779B1), np.uint32(0x9E3779B1)
        for i in range(1, SHINGLE):
            low += chars[i : i + n]
            if i < SHINGLE - 1:
                low *= times
        buffer = np.empty_like(low) if len(buffer) < n else buffer
        spread = buffer[:n]
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(low, np.uint32(shift), out=spread)
            low ^= spread
            low *= np.uint32(factor)
        np.right_shift(low, np.uint32(16), out=spread)
        low ^= spread
        # every other piece is a line's own; those between reach into the next line
        pieces = np.stack([begin, begin + length[run] - SHINGLE + 1], 1).ravel()[:-1]
        for i in range(ROWS * BANDS):
            np.multiply(low, _TIMES[i], out=spread)
            out[i, run] = np.minimum.reduceat(spread, pieces)[::2]
    return out


def band_values(least: np.ndarray) -> np.ndarray:
    """(line, band) matrix of band values from signatures."""
    out = np.empty((least.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(least.shape[1], b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + least[i])
        out[:, b] = value
    return out


def bands(lines: list[str]) -> np.ndarray:
    return band_values(signatures(lines))


def one_bits(least: np.ndarray) -> np.ndarray:
    """``BITS`` one-bit hashes of every line, from signatures."""
    out = np.zeros(least.shape[1], np.uint64)
    for i in range(BITS):
        bit = (least[i] * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64)
        out |= bit << np.uint64(i)
    return out


def line_key(line: str) -> int:
    """What ``F.xxhash64`` gives for the line, unsigned."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)


def _kept_lines(texts: list[str | None]) -> list[str]:
    return [p for t in texts if t for p in t.split("\n") if p.strip(BLANK)]


def _entries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(target, entries): the bands of the different lines of a slice of texts, by the first ``bits`` bits of the band."""
    for batch in batches:
        for start, n in text_slices(batch, "t", 8 << 20):
            lines = _kept_lines(batch.column("t").slice(start, n).to_pylist())
            k, first = np.unique(np.fromiter(map(line_key, lines), np.uint64, len(lines)), return_index=True)
            if not len(k):
                continue
            order = np.argsort(first)
            k, least = k[order], signatures([lines[i] for i in first[order]])
            value, mark = band_values(least).ravel(), np.repeat(one_bits(least), BANDS)
            target = (value >> np.uint64(64 - bits)).astype(np.uint16)
            order = np.argsort(target, kind="stable")
            entries = np.empty((len(value), ENTRY), np.uint8)
            for column, places, width in ((value, slice(0, BAND_BYTES), BAND_BYTES), (np.repeat(k, BANDS), slice(BAND_BYTES, BAND_BYTES + 8), 8), (mark, slice(BAND_BYTES + 8, ENTRY), BITS // 8)):
                entries[:, places] = column[order].view(np.uint8).reshape(-1, 8)[:, :width]
            targets, begin = np.unique(target[order], return_index=True)
            ends = np.append(begin, len(value)) * ENTRY
            whole = pa.Array.from_buffers(pa.binary(), len(targets), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entries)])
            yield pa.RecordBatch.from_arrays([pa.array(targets.astype(np.int32)), whole], ["target", "entries"])


def _column(entries: np.ndarray, start: int, width: int) -> np.ndarray:
    out = np.zeros((len(entries), 8), np.uint8)
    out[:, :width] = entries[:, start : start + width]
    return out.view(np.uint64).ravel()


def near_pairs(group: np.ndarray, mark: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within a group (rows are sorted by it) that agree on ``AGREE`` bits, one row at least being new."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, FEW):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        near = same[(np.bitwise_count(mark[same + step] ^ mark[same]) <= BITS - AGREE) & (new[same] | new[same + step])]
        left.append(near)
        right.append(near + step)
    return np.concatenate(left), np.concatenate(right)


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by target: (band, a, b), pairs to compare with band null, and lines of crowded bands with b null."""
    none = tuple(np.empty(0, np.uint64) for _ in range(4))
    kept, new, waiting, target = none, [], 0, None  # state of a kept line: 0 is new, 1 has met the others, 2 stands for a crowded band

    def sift(last: bool) -> pa.RecordBatch:
        nonlocal kept, new, waiting
        rows = np.frombuffer(b"".join(new), np.uint8).reshape(-1, ENTRY)
        found = (*(_column(rows, start, width) for start, width in ((0, BAND_BYTES), (BAND_BYTES, 8), (BAND_BYTES + 8, BITS // 8))), np.zeros(len(rows), np.uint64))
        band, k, mark, state = (np.concatenate(pair) for pair in zip(kept, found, strict=True))
        order = np.argsort(band)
        same = band[order[1:]] == band[order[:-1]]
        company = np.zeros(len(order), bool)
        company[1:] |= same
        company[:-1] |= same
        lone, order = order[~company], order[company]  # most bands have one line, which only later parts can meet
        lone = none if last else (band[lone], k[lone], mark[lone], np.maximum(state[lone], np.uint64(1)))
        order = order[np.lexsort((2 - state[order], k[order], band[order]))]
        single = np.ones(len(order), bool)
        single[1:] = (band[order[1:]] != band[order[:-1]]) | (k[order[1:]] != k[order[:-1]])
        band, k, mark, state = (x[order[single]] for x in (band, k, mark, state))
        head = np.ones(len(k), bool)
        head[1:] = band[1:] != band[:-1]
        group = np.cumsum(head) - 1
        crowd = (np.bincount(group, state == 2)[group] > 0) | (np.bincount(group)[group] > FEW)
        go, few = np.flatnonzero(crowd & (state < 2)), np.flatnonzero(~crowd)
        left, right = near_pairs(group[few], mark[few], state[few] == 0)
        left, right = few[left], few[right]
        if last:
            kept = none
        else:
            stay = head | ~crowd
            found = (band, k, mark, np.where(crowd, np.uint64(2), np.uint64(1)))
            kept = tuple(np.concatenate([x[stay], y]) for x, y in zip(found, lone, strict=True))
        new, waiting = [], 0
        whole = (np.uint64(target) << np.uint64(8 * BAND_BYTES) | band[go]).view(np.int64)
        k = k.view(np.int64)
        bands_out = pa.concat_arrays([pa.nulls(len(left), pa.int64()), pa.array(whole)])
        others = pa.concat_arrays([pa.array(k[right]), pa.nulls(len(go), pa.int64())])
        return pa.RecordBatch.from_arrays([bands_out, pa.array(np.concatenate([k[left], k[go]])), others], ["band", "a", "b"])

    for batch in batches:
        for t, entries in zip(batch.column("target").to_pylist(), batch.column("entries"), strict=True):
            if t != target:
                if target is not None:
                    yield sift(True)
                target = t
            elif waiting >= HELD:
                yield sift(False)
            new.append(entries.as_buffer())
            waiting += len(new[-1]) // ENTRY
    if target is not None:
        yield sift(True)


def linked(sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join the lines of a block as all pairs of similarity ``least`` do; 0 and 1 meet each other, 2 all.

    ``sets`` are sorted and without repetition. A line is compared with those that it
    isn't joined with yet, so copies of one line cost one comparison each.
    """
    n, label, out = len(sets), np.arange(len(sets)), []
    size = np.array([len(s) for s in sets])
    # lines have no more in common than their buckets of hashes have
    bucket = np.repeat(np.arange(n), size) * BUCKETS + (np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64)
    held = np.bincount(bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    held = held.astype(np.uint16) if held.max() < 1 << 16 else held
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[(label[others] != label[i]) & ((side[others] != side[i]) | (side[i] == 2))]
        others = others[np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i]) - 1e-9]
        most = np.minimum(held[others], held[i]).sum(axis=1, dtype=np.int64)
        others = others[most >= least * (size[i] + size[others] - most) - 1e-9]
        if not len(others):
            continue
        both = np.concatenate([sets[j] for j in others])
        at = np.searchsorted(sets[i], both)
        same = (sets[i][np.minimum(at, size[i] - 1)] == both).astype(np.int64)
        common = np.add.reduceat(same, np.cumsum(size[others]) - size[others])
        near = others[common >= least * (size[i] + size[others] - common) - 1e-9]
        for j in near:
            out.append((i, int(j)))
            a, b = label[i], label[j]
            label[label == max(a, b)] = min(a, b)
    return out


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, whose rows may span batches."""
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> pa.RecordBatch:
        block, k, side = (rows.column(c).to_numpy() for c in ("block", "k", "side"))
        hashes, starts = shingles(rows.column("line").to_pylist())
        sets = [distinct(s) for s in np.split(hashes, starts[1:])]
        cuts = np.flatnonzero(np.diff(block)) + 1
        a, b = [], []
        for s, e in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if e - s > 1:
                for i, j in linked(sets[s:e], side[s:e], least):
                    a.append(k[s + i])
                    b.append(k[s + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= GATHER or sum(x.nbytes for x in held) > 16 << 20:
            rows = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.searchsorted(rows.column("block").to_numpy(), rows.column("block")[-1].as_py()))
            if whole:
                yield work(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def similar(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether the shingle sets of a[i] and b[i] have Jaccard similarity ``least``, for up to 65,536 pairs."""

    hashes, starts = shingles(a + b)
    side = np.arange(2 * len(a), dtype=np.uint64)
    mark = np.where(side < len(a), side << np.uint64(48), (side - np.uint64(len(a))) << np.uint64(48) | np.uint64(1))  # pair, then side in the lowest bit
    keys = hashes >> np.uint64(17)
    keys <<= np.uint64(1)
    keys |= np.repeat(mark, np.diff(np.append(starts, len(hashes))))
    keys = distinct(keys)
    pair = (keys >> np.uint64(48)).astype(np.int64)
    keys >>= np.uint64(1)
    common = np.bincount(pair[1:][keys[1:] == keys[:-1]], minlength=len(a))
    return common >= least * (np.bincount(pair, minlength=len(a)) - common) - 1e-9


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, n in text_slices(batch, "x", 1 << 16):
            for at in range(start, start + n, 1 << 14):
                part = batch.slice(at, min(1 << 14, start + n - at))
                near = similar(part.column("x").to_pylist(), part.column("y").to_pylist(), least)
                yield part.select(["a", "b"]).filter(pa.array(near))


def _fetch(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(k, line) of the lines that pass the filter, and of few others."""
    words: np.ndarray = shared.value
    for batch in batches:
        for start, n in text_slices(batch, "t", 8 << 20):
            lines = _kept_lines(batch.column("t").slice(start, n).to_pylist())
            k, first = np.unique(np.fromiter(map(line_key, lines), np.uint64, len(lines)), return_index=True)
            place = k % np.uint64(FILTER)
            wanted = np.flatnonzero(words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(k[wanted].view(np.int64)), pa.array([lines[i] for i in first[wanted]], pa.string())], ["k", "line"])


def _filter(keys: DataFrame) -> np.ndarray:
    """Words of the filter: bit k mod ``FILTER`` is set for every k. Its size doesn't depend on the keys."""
    place = F.col("k").bitwiseAND(F.lit(FILTER - 1))
    bit = F.expr("shiftleft(1L, cast(k & 63 as int))")
    rows = keys.select(F.shiftright(place, 6).cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(FILTER // 64, np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return words


def joined(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(k, root): the components of near lines of the texts ``t`` of ``docs``, by their hashes; lines without a near one are absent."""
    spark = docs.sparkSession
    spread = crowded(spark)
    # more targets than partitions, so that a task's share comes in parts; a target is named by 16 bits at most
    bits = min(16, max(8, (2 * spread).bit_length()))
    packs = docs.select("t").mapInArrow(lambda it: _entries(it, bits), "target int, entries binary")
    packs = packs.repartition(spread, "target").sortWithinPartitions("target")
    found = stored(packs.mapInArrow(_sharing, "band long, a long, b long"), "bands")
    crowd = found.filter("b IS NULL").select("band", F.col("a").alias("k")).distinct()
    first = crowd.groupBy("band").agg(F.min_by("k", F.xxhash64("k", "band")).alias("first"))
    stars = crowd.join(first, "band").filter("k <> first").select(F.least("k", "first").alias("a"), F.greatest("k", "first").alias("b"))
    pairs = stored(found.filter("b IS NOT NULL").select("a", "b").unionByName(stars).distinct(), "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k"))
    shared_filter = spark.sparkContext.broadcast(_filter(keys))
    texts = docs.select("t").mapInArrow(lambda it: _fetch(it, shared_filter), "k long, line string")
    texts = stored(texts.groupBy("k").agg(F.first("line").alias("line")), "texts")
    shared_filter.destroy()
    x, y = (texts.select(F.col("k").alias(k), F.col("line").alias(line)) for k, line in (("a", "x"), ("b", "y")))
    near = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, least), "a long, b long"), "near")
    root = components(near).select(F.col("node").alias("k"), "root")
    if crowd.isEmpty():
        return root
    extra = _crowd_links(crowd, first, root, texts, least)
    for side in ("a", "b"):  # links between components found so far
        extra = extra.join(root.select(F.col("k").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    later = components(extra).select("node", F.col("root").alias("last"))
    moved = root.join(later, root["root"] == later["node"], "left").select("k", F.coalesce("last", "root").alias("root"))
    new = later.select(F.col("node").alias("k"), F.col("last").alias("root")).join(root.select("k"), "k", "left_anti")
    return cut(moved.unionByName(new))


def _crowd_links(crowd: DataFrame, first: DataFrame, root: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links of those lines of crowded bands that are in another component than the band's first line, with all of the band."""
    named = crowd.join(root, "k", "left").select("band", "k", F.coalesce("root", "k").alias("root"))
    own = first.join(root, first["first"] == root["k"], "left").select("band", F.coalesce("root", "first").alias("main"))
    rows = stored(named.join(own, "band").select("band", "k", (F.col("root") != F.col("main")).alias("apart")), "crowd")
    large = rows.groupBy("band").agg(F.count("*").alias("n"), F.max("apart").alias("some")).filter("some")
    rows = rows.join(large.select("band", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")), "band")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")).cast("int"))
    # a line apart goes to every block of its band and meets all in its own; the others stay in one
    meets = F.when(F.col("apart"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(o.alias("x"), F.when(o == F.col("own"), 2).otherwise(1).alias("side"))))
    meets = meets.otherwise(F.array(F.struct(F.col("own").alias("x"), F.lit(0).alias("side"))))
    dealt = rows.select("k", "band", F.explode(meets).alias("m")).select("k", F.xxhash64("band", "m.x").alias("block"), F.col("m.side").alias("side"))
    blocks = dealt.join(texts, "k").repartition(crowded(crowd.sparkSession), "block").sortWithinPartitions("block", "k")
    return blocks.mapInArrow(lambda it: _links(it, least), "a long, b long")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, drop in zip(unpacked(batch.column("t")), batch.column("drop").to_pylist(), strict=True):
            text = None if text is None else text.decode()
            parts = [] if text is None else text.split("\n")
            gone = set(drop or ())
            counts.append(sum(1 for p in parts if p.strip(BLANK)))
            dropped.append(len(gone))
            texts.append("\n".join([p for i, p in enumerate(parts) if i not in gone]) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(dropped, pa.int32())], ["_row", "t", "n_lines", "n_dropped"])


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``df`` with the text's repeated lines removed, ``n_lines`` and ``n_dropped`` (blank lines don't count)."""
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    whole = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text]).alias("_row")
    t = F.col(text).cast("string")
    docs = df.select(whole, F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), t.alias("t"), F.xxhash64(t).alias("h"))
    every = docs.select("d", "h", F.posexplode(F.split("t", "\n", -1)).alias("n", "line")).filter(F.trim(F.col("line"), F.lit(BLANK)) != "")
    every = every.withColumn("k", F.xxhash64("line"))
    occurrences = stored(every.select("k", F.struct("d", "h", "n").alias("at")), "lines")
    places = cut(occurrences.groupBy("k").agg(F.min("at").alias("at"), F.count("*").alias("c")))
    firsts = cut(places.join(joined(docs, least), "k", "left"))
    keep = firsts.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("at").alias("keep"))
    alone = firsts.filter(F.col("root").isNull() & (F.col("c") > 1)).select("k", F.col("at").alias("keep"))
    keepers = cut(firsts.filter(F.col("root").isNotNull()).join(keep, "root").select("k", "keep").unionByName(alone))
    gone = occurrences.join(keepers, "k").filter(F.col("at") != F.col("keep"))
    drops = gone.groupBy("at.d", "at.h").agg(F.collect_set("at.n").alias("drop"))
    rows = packed(docs, "_row", "d", "h", level=1).join(drops, ["d", "h"], "left").select("_row", "t", "drop")
    made = rows.mapInArrow(_drop, f"_row {docs.schema['_row'].dataType.simpleString()}, t string, n_lines int, n_dropped int")
    columns = [F.col("t").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names]
    return made.select(*columns, "n_lines", "n_dropped")
