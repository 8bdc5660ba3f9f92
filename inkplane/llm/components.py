"""Distributed union-find: connected components of links, by repeated contraction.

In a round every node moves to that neighbour, or itself, which comes first in an
order of hashes drawn anew for the round, and links between the same two nodes
become one. The number of the round is data, not part of the plan, so that the code
generated for one round serves all. A fixed share of the nodes goes in every round, on average, whatever
the shape of the links, so rounds grow with the logarithm of the nodes. Once no more
than ``FINISH`` links are left, one task unites what they join; that many fit any task.
Tables of every round lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import cut

#: Links that one task takes.
FINISH = 1 << 18


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of links (a, b); nodes are numbers or structs of numbers."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    n, nodes = table.num_rows, pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks])
    parts = [x.to_numpy(zero_copy_only=False) for x in (nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes])]
    order = np.lexsort(parts[::-1])
    fresh = reduce(np.logical_or, [np.concatenate([[True], x[order][1:] != x[order][:-1]]) for x in parts])
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    label = unite(np.arange(len(first)), number[:n], number[n:])
    for start in range(0, len(first), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(first[part])), nodes.take(pa.array(first[label[part]]))], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; nodes of a component share the root."""
    tidy = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    left = cut(links.select(*tidy(F.col(a), F.col(b)), F.lit(0).alias("turn")).filter("a < b").distinct())
    moves: list[DataFrame] = []
    while left.count() > FINISH:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to"), "turn").unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("to"), "turn"))
        nearest = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("to", "turn").alias("h"), F.col("to").alias("root"))).alias("m"), F.first("turn").alias("turn"))
        own = F.struct(F.xxhash64("node", "turn").alias("h"), F.col("node").alias("root"))
        move = cut(nearest.select("node", F.least(own, F.col("m"))["root"].alias("root")))
        moves.append(move)
        to_a, to_b = move.select(F.col("node").alias("a"), F.col("root").alias("ra")), move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = cut(left.join(to_a, "a").join(to_b, "b").select(*tidy(F.col("ra"), F.col("rb")), (F.col("turn") + 1).alias("turn")).filter("a < b").distinct())
    kind = left.schema["a"].dataType.simpleString()
    found = cut(left.select("a", "b").repartition(1).mapInArrow(_finish, f"node {kind}, root {kind}"))
    for move in reversed(moves):
        later = found.select(F.col("node").alias("_via"), F.col("root").alias("_root"))
        found = cut(move.join(later, move["root"] == later["_via"], "left").select("node", F.coalesce("_root", "root").alias("root")))
    return found


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest member seen so far) after uniting a[i] with b[i], inside a task."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := label[label], label):
            label = up
