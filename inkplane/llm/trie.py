"""Conversation prefix trie from padded turn-id matrices (operator 13).

A node is a distinct sequence of first turns (role, text). Conversations are cut into
segments of ``SEGMENT`` turns; segments behind equal prefixes form one group. Segments
are dealt to range shards in order of (group, turns, conversation). A shard pads its
turns' ids to a matrix, sorts its rows by numpy's lexsort, and ORs the masks of changed
columns along every row: what that leaves are the starts of the nodes of each depth,
and reduceat adds up their rows. Sums over subtrees are sums over rows as well: a leaf
counts at the last row of its node, shared tokens at the row that shares them with the
row before. The nodes that hold a shard's first or last row may go on in its
neighbours; they are recombined by key, with corrections from each pair of neighbouring
rows. Segments are worked off from the last to the first, and what lies below a
group is credited to one row of the segment before.

So no task holds more than a shard, however long a conversation is and however many
share their turns. Only a digest over the ids that end at one node is a stream through
one task, as SHA-256 is; it gets them packed.

Null roles and texts are empty. Rows without conv_id take no part. Turns are in order of
``turn``, null first; equal ones (repeated rows too) stand in order of their hashes and
stay turns of their own. Turns are equal where two hashes of 64 bits are. A conversation
without turns is a member of the root; an empty table has no root and gives no rows.
Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import crowded, stored

#: Turns of a segment; segments of a shard, on average.
SEGMENT, ROWS = 256, 1 << 14
#: Conversations of a hundred share the first turns of the first of them, fewer than SHARED.
HUNDRED, SHARED = 100, 6

TURN = "struct<hi: long, lo: long, tokens: long>"


# --- turns -------------------------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each turn's place among those of its conversation that the task has."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(place[-1]) + 1
        columns = [*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(place.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn struct) of every turn, numbered from 0 in its conversation; one with a large share of all turns spreads over many tasks."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("hi"), F.xxhash64(text, F.lit(1), role).alias("lo"), F.length(text).cast("long").alias("tokens")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "hi", "lo"]
    dealt = rows.repartitionByRange(crowded(spark), *order).sortWithinPartitions(*order).drop("turn")
    kept = stored(dealt.mapInArrow(_number, "conv_id long, hi long, lo long, tokens long, part int, place long"), "trie-turns")
    ends = kept.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last"))
    before, offset = None, 0
    offsets: list[tuple[int, int, int]] = []
    for r in sorted(ends.collect(), key=lambda r: r.part):  # a row for each task
        offset = offset if before == r.first else 0
        if offset:
            offsets.append((r.part, r.first, offset))
        offset = r.last.place + 1 + (offset if r.first == r.last.conv_id else 0)
        before = r.last.conv_id
    turn = F.struct("hi", "lo", "tokens")
    if not offsets:
        return kept.select("conv_id", F.col("place").alias("pos"), turn.alias("turn"))
    more = F.broadcast(spark.createDataFrame(offsets, "part int, conv_id long, more long"))
    return kept.join(more, ["part", "conv_id"], "left").select("conv_id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("pos"), turn.alias("turn"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the first of their hundred, in place of as many of their own: (conv_id, pos, turn), one row with a null turn for each conversation besides."""
    base, share = F.col("conv_id") - F.col("conv_id") % HUNDRED, F.crc32(F.col("conv_id").cast("string")) % SHARED
    first = turns.filter((F.col("pos") < SHARED - 1) & (F.col("conv_id") % HUNDRED == 0)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("lead"))
    first = stored(first.select(F.col("conv_id").alias("base"), F.col("lead.turn").alias("lead")), "trie-leads")
    keyed = turns.withColumns({"base": base, "share": share})
    own = keyed.join(first.select("base", F.size("lead").alias("n")), "base", "left").filter("pos >= share")
    own = own.select("conv_id", (F.col("pos") - F.col("share") + F.least("share", F.coalesce("n", F.lit(0)))).alias("pos"), "turn")
    every = keyed.filter("pos = 0").select("conv_id", "base", "share")
    lead = every.join(first, "base").select("conv_id", F.posexplode(F.slice("lead", F.lit(1), F.col("share").cast("int"))).alias("pos", "turn"))
    return own.unionByName(lead.withColumn("pos", F.col("pos").cast("long"))).unionByName(every.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(TURN).alias("turn")))


# --- shards ------------------------------------------------------------------------------

#: What a shard says: nodes (kind 0), its part of nodes that may go on elsewhere (1), its first and last row (2), nodes that a group below hangs on (3).
FIELDS = [
    ("kind", "int"), ("part", "int"), ("depth", "long"), ("conv_id", "long"), ("parent_conv_id", "long"), ("key", "string"), ("parent_key", "string"),
    ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends", "string"),
    ("first_group", "string"), ("first_turns", "turns"), ("last_group", "string"), ("last_turns", "turns"), ("last_goes_on", "boolean"),
]
SHARD = ", ".join(f"{c} {f'array<{TURN}>' if kind == 'turns' else kind}" for c, kind in FIELDS)
_TURNS = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("tokens", pa.int64())]))
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "turns": _TURNS}
_NOTHING = hashlib.sha256(b"").hexdigest()


def _batch(n: int, **given) -> pa.RecordBatch:
    columns = [pa.array(given[c], _KINDS[kind]) if c in given else pa.nulls(n, _KINDS[kind]) for c, kind in FIELDS]
    return pa.RecordBatch.from_arrays(columns, [c for c, _ in FIELDS])


def _keys(group: str, segment: int, hi: np.ndarray, lo: np.ndarray) -> list[str]:
    """Names of the nodes along a row, from depth 0 of its segment on."""
    h = hashlib.blake2b(f"{segment} {group}".encode(), digest_size=16)
    out = [h.hexdigest()]
    for a, b in zip(hi.tolist(), lo.tolist(), strict=True):
        h.update(a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True))
        out.append(h.hexdigest())
    return out


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, in order of the first column, then the next."""
    order = np.lexsort(columns[::-1])
    fresh = reduce(np.logical_or, [np.concatenate([[False], c[order][1:] != c[order][:-1]]) for c in columns])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _shard(batches: Iterator[pa.RecordBatch], segment: int, full: int) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    n = table.num_rows
    turns = table.column("turns").combine_chunks()
    turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
    lens = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    hi, lo, tokens = (turns.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "tokens"))
    conv, goes_on, leaves, saved, children = (table.column(c).to_numpy() for c in ("conv_id", "goes_on", "below_leaves", "below_saved", "below_children"))
    groups = np.array(table.column("grp").to_pylist(), object)
    names, group = np.unique(groups.astype(str), return_inverse=True)
    # the padded matrix: 0 where a row has ended
    width = int(lens.max())
    row, at = np.repeat(np.arange(n), lens), np.arange(len(hi)) - np.repeat(np.cumsum(lens) - lens, lens)
    ids, sizes, which = np.zeros((n, width), np.int32), np.zeros((n, width + 1), np.int64), np.zeros((n, width), np.int64)
    if len(hi):
        ids[row, at] = _ranks(hi, lo) + 1
        sizes[row, at + 1] = tokens
        which[row, at] = np.arange(len(hi))
    order = np.lexsort((conv, goes_on, *ids.T[::-1], group))
    ids, sizes, which, conv, goes_on, group, lens = ids[order], np.cumsum(sizes[order], axis=1), which[order], conv[order], goes_on[order], group[order], lens[order]
    leaves, saved, children = leaves[order], saved[order], children[order]
    # starts[r, d]: row r begins another node of depth d than the row before
    starts = np.ones((n, width + 1), bool)
    starts[1:, 0], starts[1:, 1:] = group[1:] != group[:-1], ids[1:] != ids[:-1]
    starts = np.logical_or.accumulate(starts, axis=1)
    common = np.minimum((~starts).sum(axis=1) - 1, lens)
    shared = sizes[np.arange(n), np.maximum(common, 0)]
    leaves = leaves + (~goes_on & (np.append(common[1:], -1) < lens))
    part = TaskContext.get().partitionId()
    path = [_keys(str(names[group[r]]), segment, hi[which[r, : lens[r]]], lo[which[r, : lens[r]]]) for r in (0, n - 1)]

    over = np.zeros(n, np.int64)  # each row's node at the depth before
    above_conv, above_edge = np.zeros(0, np.int64), np.zeros(0, np.int8)
    for depth in range(width + 1):
        alive = np.flatnonzero(lens >= depth)
        s = np.flatnonzero(starts[alive, depth])
        rows, size = alive[s], np.diff(np.append(s, len(alive)))
        add = lambda x: np.add.reduceat(x[alive], s)  # noqa: B023, E731
        least = np.minimum.reduceat(conv[alive], s)
        before = sizes[rows, depth - 1] if depth else 0
        tokens_saved = add(shared) - shared[rows] - (size - 1) * before + add(saved)
        if depth < width:
            kids = np.add.reduceat(((lens > depth) & starts[:, depth + 1]).astype(np.int64)[alive], s)
        else:
            kids = np.zeros(len(s), np.int64)
        if depth == full:
            kids = kids + add(children)
        edge = np.where(alive[s + size - 1] == n - 1, 2, 0).astype(np.int8)  # 1: along the first row, 2: along the last
        edge[rows == 0] = 1
        node = np.repeat(np.arange(len(s)), size)
        ended = (lens[alive] == depth) & ~goes_on[alive]
        ends: list[str | None] = [None] * len(s)
        of, ids_of = node[ended], conv[alive][ended]
        cuts = np.flatnonzero(np.diff(of)) + 1
        for k, some in zip(of[np.concatenate([[0], cuts])].tolist() if len(of) else (), np.split(ids_of, cuts), strict=False):
            ends[k] = ",".join(map(str, some.tolist()))
        key = [path[e - 1][depth] if e else None for e in edge.tolist()]
        if depth:
            above = over[rows]
            parent = above_conv[above]
            parent_key = [path[e - 1][depth - 1] if e else None for e in above_edge[above].tolist()]
            parent_ = pa.array(parent, pa.int64(), mask=above_edge[above] > 0)
        else:
            parent_, parent_key = pa.nulls(len(s), pa.int64()), [None] * len(s)
        digest = [e if k else hashlib.sha256(e.encode()).hexdigest() if e else _NOTHING for e, k in zip(ends, key, strict=True)]
        yield _batch(len(s), kind=(edge > 0).astype(np.int32), part=np.full(len(s), part, np.int32), depth=np.full(len(s), depth), conv_id=least, parent_conv_id=parent_, key=key, parent_key=parent_key, n_convs=size, n_children=kids, n_leaves=add(leaves), saved_tokens=tokens_saved, ends=digest)
        if depth == full:
            hung = np.flatnonzero(children[alive] > 0)
            at_node = node[hung]
            yield _batch(len(hung), kind=np.full(len(hung), 3, np.int32), conv_id=conv[alive][hung], parent_conv_id=pa.array(least[at_node], pa.int64(), mask=edge[at_node] > 0), parent_key=[key[k] for k in at_node.tolist()])
        over[alive] = node
        above_conv, above_edge = least, edge
    listed = lambda r: [{"hi": int(hi[x]), "lo": int(lo[x]), "tokens": int(tokens[x])} for x in which[r, : lens[r]]]
    yield _batch(1, kind=[2], part=[part], first_group=[str(names[group[0]])], first_turns=[listed(0)], last_group=[str(names[group[-1]])], last_turns=[listed(n - 1)], last_goes_on=[bool(goes_on[-1])])


def _correct(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """What nodes have counted twice, or not at all, as a shard doesn't know the last row of the one before."""
    for batch in batches:
        for r in batch.to_pylist():
            if r["last_group"] != r["first_group"]:
                continue
            a, b, common = r["last_turns"], r["first_turns"], 0
            while common < min(len(a), len(b)) and (a[common]["hi"], a[common]["lo"]) == (b[common]["hi"], b[common]["lo"]):
                common += 1
            turns = b[:common]
            keys = _keys(r["first_group"], segment, *(np.array([t[c] for t in turns], np.int64) for c in ("hi", "lo")))
            sizes = np.cumsum([0, *(t["tokens"] for t in turns)])
            depth = np.arange(common + 1)
            no_leaf = common == len(a) and not r["last_goes_on"]
            yield _batch(
                common + 1, kind=np.ones(common + 1, np.int32), depth=depth, key=keys, n_convs=np.zeros(common + 1, np.int64), n_children=-(depth < common).astype(np.int64),
                n_leaves=np.full(common + 1, -int(no_leaf)), saved_tokens=sizes[common] - sizes[np.maximum(depth - 1, 0)],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) from texts in order of (key, part), one after the other."""
    key, h = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])


NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def _level(rows: DataFrame, segment: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the segments ``rows``, with depths from their beginning, and (conv_id, parent_conv_id) of the nodes that a group below hangs on."""
    spark, full = rows.sparkSession, SEGMENT
    parts = max(crowded(spark), -(-n // ROWS))
    dealt = rows.repartitionByRange(parts, "grp", "turns", "goes_on", "conv_id")
    made = stored(dealt.mapInArrow(lambda it: _shard(it, segment, full), SHARD), "trie-shards")
    ends = made.filter("kind = 2").withColumn("number", F.row_number().over(Window.orderBy("part")))  # a row for each shard
    left = ends.select((F.col("number") + 1).alias("number"), "last_group", "last_turns", "last_goes_on")
    pairs = ends.select("number", "first_group", "first_turns").join(left, "number")
    partial = made.filter("kind = 1").unionByName(pairs.mapInArrow(lambda it: _correct(it, segment), SHARD))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = partial.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("parent_key").alias("parent_key"), *sums)
    chunks = made.filter("kind = 1 AND ends IS NOT NULL").select("key", "part", "ends").repartition(parts, "key").sortWithinPartitions("key", "part")
    whole = whole.join(chunks.select("key", "ends").mapInArrow(_digest, "key string, ends string"), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_NOTHING)))
    whole = stored(whole, "trie-edges")
    known = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    resolved = lambda df: df.join(known, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    inner = made.filter("kind = 0")
    sure = inner.filter("parent_key IS NULL").select(*NODE)
    nodes = sure.unionByName(resolved(inner.filter("parent_key IS NOT NULL")).select(*NODE)).unionByName(resolved(whole).select(*NODE))
    return nodes, resolved(made.filter("kind = 3")).select("conv_id", "parent_conv_id")


def _segments(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, turns) of (conv_id, pos, turn)."""
    listed = turns.groupBy("conv_id", F.expr(f"pos div {SEGMENT}").cast("int").alias("segment")).agg(F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("pos", "turn")))).alias("turns"))
    return stored(listed.select("conv_id", "segment", F.col("turns.turn").alias("turns")), "trie-segments")


def nodes(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, pos, turn); rows with a null turn make their conversation a member of the root.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    rows = _segments(turns)
    counts = {r.segment: r.n for r in rows.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each SEGMENT turns of the longest conversation
    last = max(counts, default=0)
    group, goes_on = F.lit(""), F.lit(False)
    if last:
        one = Window.partitionBy("conv_id").orderBy("segment")
        summed = lambda seed: F.sum(F.xxhash64("segment", "turns", F.lit(seed)).cast("decimal(38,0)")).over(one.rowsBetween(Window.unboundedPreceding, -1)).cast("string")
        group, goes_on = F.coalesce(F.concat_ws("_", summed(1), summed(2)), F.lit("")), F.lead("segment").over(one).isNotNull()
        rows = rows.withColumns({"grp": group, "goes_on": goes_on})
        rows = stored(rows, "trie-groups")
    else:
        rows = rows.withColumns({"grp": group, "goes_on": goes_on})
    out: DataFrame | None = None
    below: DataFrame | None = None  # groups of the segment behind
    hanging: DataFrame | None = None  # the nodes of that segment whose parent belongs to this one
    none = F.lit(0).cast("long")
    for segment in range(last, -1, -1):
        own = rows.filter(F.col("segment") == segment).drop("segment")
        if below is None:
            own = own.withColumns({"below_leaves": none, "below_saved": none, "below_children": none})
        else:
            own = own.join(below, "conv_id", "left").fillna(0, ["below_leaves", "below_saved", "below_children"])
        made, links = _level(own, segment, counts.get(segment, 0))
        if hanging is not None:
            placed = hanging.join(links.withColumnsRenamed({"conv_id": "top", "parent_conv_id": "above"}), F.col("parent_conv_id") == F.col("top"))
            out = _and(out, placed.withColumn("parent_conv_id", F.col("above")).select(*NODE))
        hanging = None
        if segment:
            made = stored(made, "trie-nodes")
            below = made.filter("depth = 0").select("conv_id", F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"), F.col("n_children").alias("below_children"))
            hanging = _deeper(made.filter("depth = 1"), segment)
            made = made.filter("depth > 1")
        out = _and(out, _deeper(made, segment))
    kept: list[Column] = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*kept, F.col("ends").alias("ends_sha256"))


def _deeper(made: DataFrame, segment: int) -> DataFrame:
    return made.select(*NODE).withColumn("depth", F.col("depth") + segment * SEGMENT)


def _and(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    return nodes(rebuilt(numbered(conversations)))
