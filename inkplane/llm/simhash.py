"""SimHash near-duplicates found with BK-trees (operator 5).

Fingerprints: a bit is set if more than half of the XXH64 values of a text's
four-word shingles have it. Two fingerprints link at ``radius`` differing bits or
fewer. Cut into radius + 1 pieces, linked fingerprints agree on one piece at least,
so each piece's value names a shard, and a fingerprint is looked up only in the
shards of its own pieces. A shard's members form a BK-tree: children keyed by their
Hamming distance to the parent, of which a search follows only the edges between
d - radius and d + radius. Shards of more than ``SHARD_ROWS`` members are split into
several trees, and their members are looked up in each of them; a task holds a few
trees at a time. Inside a task links are united, so that it passes on one link for
each member, not all pairs. Components come from the distributed union-find.

Near copies (``near_copies``) need a larger radius than pieces can serve: 128 bits (the
second half from the same hashes, mixed once more) of five-word shingles, linked at
``NEAR`` bits or fewer. Texts of Jaccard similarity 0.8 differ in 20 bits, give or take 4;
of 0.5 in 34, strangers in 64. Shards are named by ``SAMPLED`` bits in each of ``TABLES``
tables, which finds 0.99 of the pairs that differ in 20 bits and 0.93 at 26.

Texts that are null or have no word get fingerprint zero and link like any other.
Shingles that repeat count as often. Rows without doc_id get fingerprint and
component like others; a component of such rows alone has id null. Rows that repeat stay
rows of their own. Equal fingerprints are looked up once. A text of any length is read
whole. An empty table gives no rows. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import crowded, cut
from inkplane.llm.components import components, unite

WORDS, SEED, RADIUS = 4, 42, 4
#: Words of a shingle, bits that near copies may differ in, bits that name a shard, and tables of shards.
NEAR_WORDS, NEAR, SAMPLED, TABLES = 5, 26, 12, 40
#: Members of a tree at most; rows that a task gathers before it builds their trees; lookups at a time.
SHARD_ROWS, GATHER_ROWS, LOOKUPS = 4096, 32768, 1024
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return fingerprint_bits(text, words, 1)[0]


def fingerprint_bits(text: str | None, words: int, parts: int) -> tuple[int, ...]:
    """``parts`` numbers of 64 bits; the second and later ones count bits of the hashes mixed again."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return (0,) * parts
    whole = b" ".join(tokens)
    n = len(tokens) - words + 1
    if n <= 1:
        digests, n = xxhash.xxh64_digest(whole, SEED), 1
    else:
        ends = [e - 1 for e in accumulate(len(p) + 1 for p in tokens)]
        starts = [0, *[e + 1 for e in ends]]
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(whole[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)])
    found, hashes = [], np.frombuffer(digests, ">u8")
    for part in range(parts):
        if part:
            mixed = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            hashes = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).astype(">u8")
        raw = hashes.view(np.uint8).reshape(n, 8)
        counts = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS for i in range(8)])
        found.append(int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big"))
    return tuple(found)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint_bits(t.as_py(), words, len(names)) for t in batch.column("_text")], np.uint64).reshape(-1, len(names))
        yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found.T)], ["_key", *names])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(key, *names) for every row; each name holds 64 bits as a signed long."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _fingerprints(it, words, list(names)), f"_key {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("_key", key)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit numbers differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class Forest:
    """The BK-trees of several shards at once; a node is the place of its fingerprint."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        """``values`` are rows of 64-bit numbers; ``tree`` numbers the shard of each, whose first value is its root."""
        self.values, self.span = values, 64 * values.shape[1] + 1
        _, self.roots, inverse = np.unique(tree, return_index=True, return_inverse=True)
        waiting = np.setdiff1d(np.arange(len(values)), self.roots)
        at, edges, children = self.roots[inverse[waiting]], [], []
        while len(waiting):
            key = at * self.span + apart(values[waiting], values[at])
            edge, first, which = np.unique(key, return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(waiting[first])
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, at = waiting[rest], waiting[first][which][rest]
        edges, children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (edges, children))
        order = np.argsort(edges, kind="stable")
        self.edges, self.children = edges[order], children[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of queries, nodes) of all pairs at ``radius`` or less, each query in the tree of its root."""
        at, node, hits = np.arange(len(queries)), roots, []
        while len(at):
            d = apart(queries[at], self.values[node])
            near = d <= radius
            hits.append((at[near], node[near]))
            low = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            at = np.repeat(at, n)
            node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(at))]
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, int),) * 2


def links_of(values: np.ndarray, shard: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (member, first of its linked members) over whole shards: 0 in ``side`` is a tree's member, 1 is looked up, 2 is both."""
    label = np.arange(len(values))
    members, asked = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(members):
        return np.empty(0, int), np.empty(0, int)
    forest = Forest(values[members], shard[members])
    trees = shard[members][forest.roots]
    where = np.searchsorted(trees, shard[asked])
    there = (where < len(trees)) & (trees[np.minimum(where, len(trees) - 1)] == shard[asked])
    asked, where = asked[there], where[there]
    for at in range(0, len(asked), LOOKUPS):
        part = asked[at : at + LOOKUPS]
        q, node = forest.within(values[part], forest.roots[where[at : at + LOOKUPS]], radius)
        label = unite(label, part[q], members[node])
    moved = np.flatnonzero(label != np.arange(len(values)))
    return moved, label[moved]


def _links(batches: Iterator[pa.RecordBatch], radius: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a shard's rows may span batches, and whole shards are worked on together."""
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> pa.RecordBatch:
        fp = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
        a, b = links_of(fp.view(np.uint64), rows.column("shard").to_numpy(), rows.column("side").to_numpy(), radius)
        columns = [pa.array(np.ascontiguousarray(fp[side, i])) for side in (a, b) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, [f"{side}{n}" for side in "ab" for n in names])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= GATHER_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            shard = rows.column("shard").to_numpy()
            whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if whole:
                yield work(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs at ``radius`` or less do. ``fps`` holds distinct ``fp``."""
    pieces, start = [], 0
    for i in range(radius + 1):
        width = 64 // (radius + 1) + (i < 64 % (radius + 1))
        pieces.append(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1).alias("value")))
        start += width
    rows = fps.select("fp", F.explode(F.array(*pieces)).alias("p")).select("fp", F.col("p.i").alias("i"), F.col("p.value").alias("value"))
    return _meet(rows, ["fp"], radius).select(F.col("afp").alias("a"), F.col("bfp").alias("b"))


def _meet(rows: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Links (a*, b*) between the fingerprints ``names`` of rows (i, value) that are alike in both; large shards are split into trees."""
    large = rows.groupBy("i", "value").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).cast("int").alias("trees")).filter("trees > 1")
    rows = rows.join(large, ["i", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(*names, F.lit("tree")), F.col("trees")).cast("int"))
    # a tree of a split shard meets itself (side 2), and every later one of the shard (0 and 1)
    meets = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda o: F.struct(
        F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y"),
        F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    rows = rows.select(*names, "i", "value", F.explode(meets).alias("m"))
    rows = rows.select(*names, F.xxhash64("i", "value", "m.x", "m.y").alias("shard"), F.col("m.side").alias("side"))
    dealt = rows.repartition(crowded(rows.sparkSession), "shard").sortWithinPartitions("shard", *names)
    return dealt.mapInArrow(lambda it: _links(it, radius, names), ", ".join(f"{side}{n} long" for side in "ab" for n in names))


def _sampled_bits() -> list[tuple[int, int]]:
    """For each table, masks of the bits of both halves that name its shards."""
    rng, out = np.random.default_rng(128), []
    for _ in range(TABLES):
        mask = sum(1 << int(b) for b in rng.choice(128, SAMPLED, replace=False))
        signed = [x - (1 << 64) if x >> 63 else x for x in (mask & ((1 << 64) - 1), mask >> 64)]
        out.append((signed[0], signed[1]))
    return out


def near_copies(df: DataFrame, radius: int = NEAR, words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, component_id) for every row of ``df``: the smallest doc_id among near copies, directly or through others."""
    names = ["fp", "more"]
    docs = cut(fingerprints(df, words=words, names=tuple(names)).withColumn("node", F.xxhash64(*names)))
    firsts = cut(docs.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(n).alias(n) for n in names]))
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for i, (x, y) in enumerate(_sampled_bits())])
    rows = firsts.select(*names, F.explode(masks).alias("m"))
    rows = rows.select(*names, "m.i", F.xxhash64(F.col("fp").bitwiseAND(F.col("m.x")), F.col("more").bitwiseAND(F.col("m.y"))).alias("value"))
    found = _meet(rows, names, radius).select(F.xxhash64("afp", "amore").alias("a"), F.xxhash64("bfp", "bmore").alias("b"))
    return _named(docs.select("doc_id", "node"), firsts.select("node", "first"), found).select("doc_id", "component_id")


def _named(docs: DataFrame, firsts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, node, component_id) from (doc_id, node), (node, first) and links between nodes."""
    roots = components(found)
    placed = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(placed.join(ids, "root").select("node", "component_id"))
    return docs.join(named, "node").select("doc_id", "node", "component_id")


def grouped(df: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``."""
    docs = cut(fingerprints(df, words=words))
    firsts = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = _named(docs.withColumnRenamed("fp", "node"), firsts.withColumnRenamed("fp", "node"), links(firsts.select("fp"), radius))
    return named.select("doc_id", F.col("node").alias("fp"), "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint in hex, component_id), one row for each document."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
