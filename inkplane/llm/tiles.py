"""Tiles for searches of a stated query set against all vectors.

A tile is one block of queries against one block of vectors. Both sides are copied
to the tiles they belong to by row numbers of block tables, so a task holds one
tile at a time and a tile's size is fixed, whatever the size of the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import crowded, cut, valid_vector

#: Rows of a tile's sides, and queries that are worked on at a time inside a tile.
QUERY_BLOCK, VECTOR_BLOCK, AT_ONCE = 2048, 2048, 256


def vectors(df: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """(rid, id, v array<double>, dim, asked): rows without key or valid vector take no part.

    ``rid`` tells rows apart, those that repeat a key too; the result has to be kept (``cut``) before it is used twice.
    """
    rows = df.filter(valid_vector(vector) & F.col(key).isNotNull())
    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), asked)
    return rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v", F.size("v").alias("dim"), "asked")


def blocks(rows: DataFrame, group: list[str], size: int, name: str) -> DataFrame:
    """``rows`` dealt into blocks of about ``size`` within each group, by hash: column ``name``.

    The groups are norm classes and lengths of vectors, both few by construction
    (norm classes are steps of a tenth over the range of a double).
    """
    counts = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("_n"))
    dealt = rows.join(F.broadcast(counts), group)
    return dealt.withColumn(name, F.pmod(F.xxhash64("rid"), F.col("_n")).cast("int")).drop("_n")


def tile_rows(queries: DataFrame, vecs: DataFrame, group: list[str], query_block: int, vector_block: int) -> DataFrame:
    """Rows of all tiles: (dim, qb, *group, vb, role 0 vector / 1 query, rid, id, v, bound).

    ``queries`` has ``bound`` and, with ``vecs`` that have ``length``, ``need``: a vector
    goes to a block of queries only if it is as long as one of them needs.
    """
    q = blocks(queries, ["dim"], query_block, "qb")
    v = blocks(vecs, ["dim", *group], vector_block, "vb")
    by_length = "need" in queries.columns
    q_blocks = q.groupBy("dim", "qb").agg((F.min("need") if by_length else F.lit(0.0)).alias("least")).groupBy("dim").agg(F.collect_list(F.struct("qb", "least")).alias("blocks"))
    v_blocks = v.groupBy("dim", *group).agg(F.max("vb").alias("last"))
    to_vectors = v_blocks.select("dim", *group, F.explode(F.sequence(F.lit(0), "last")).alias("vb"))
    # a stated query set against all rows, block by block
    q_rows = q.join(to_vectors, "dim").withColumn("role", F.lit(1))
    targets = F.col("blocks")
    if by_length:
        targets = F.filter(targets, lambda b: b["least"] <= F.col("length") * (1 + 1e-9))
    v_rows = v.join(F.broadcast(q_blocks), "dim").withColumn("qb", F.explode(F.transform(targets, lambda b: b["qb"]))).withColumn("role", F.lit(0))
    columns = ["dim", "qb", *group, "vb", "role", "rid", "id", "v"]
    return q_rows.select(*columns, "bound").unionByName(v_rows.select(*columns, F.lit(None).cast("double").alias("bound")))


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def split_tile(part: pa.Table) -> tuple[Side, Side]:
    """((rids, ids, matrix, bounds) of the queries, the same of the vectors) of a tile."""
    role, rid, ids, bound = (part.column(c).to_numpy() for c in ("role", "rid", "id", "bound"))
    flat = part.column("v").combine_chunks()
    flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(ids), -1)
    return tuple(tuple(x[role == r] for x in (rid, ids, matrix, bound)) for r in (1, 0))


FOUND = "query_rid bigint, query_id bigint, vec_id bigint, score"


def found_table(rows: list[tuple[np.ndarray, ...]], kind: type) -> pa.Table:
    """The best of each query of a tile."""
    kinds = (np.int64, np.int64, np.int64, kind)
    columns = [np.concatenate(c).astype(k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [np.empty(0, k) for k in kinds]
    return pa.table(dict(zip(("query_rid", "query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))


def _merge(batches: Iterator[pa.RecordBatch], k: int, largest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by query: a heap of k entries for the query at hand, the worst entry on top."""
    sign, kind = (1, pa.int64()) if largest else (-1, pa.float64())
    names = ["query_rid", "query_id", "rank", "vec_id", "score"]
    heap: list = []
    rows: list[tuple] = []
    query = None

    def close() -> None:
        rows.extend((*query, n, -e[1], e[2]) for n, e in enumerate(sorted(heap, reverse=True), 1))
        heap.clear()

    def taken() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), kind), strict=True)], names)

    for batch in batches:
        for rid, q, v, s in zip(*(batch.column(n).to_pylist() for n in ("query_rid", "query_id", "vec_id", "score")), strict=True):
            if query != (rid, q):
                if query is not None:
                    close()
                query = (rid, q)
            entry = (sign * s, -v, s)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if rows:
            yield taken()
    if query is not None:
        close()
    yield taken()


def merged(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best of each query row among the tiles' best, ties to the smaller vec_id."""
    kind = "bigint" if largest else "double"
    spread = found.repartition(crowded(found.sparkSession), "query_rid").sortWithinPartitions("query_rid")
    return spread.mapInArrow(lambda it: _merge(it, k, largest), f"query_rid bigint, query_id bigint, rank int, vec_id bigint, score {kind}")


__all__ = ["AT_ONCE", "FOUND", "QUERY_BLOCK", "VECTOR_BLOCK", "blocks", "cut", "found_table", "merged", "split_tile", "tile_rows", "vectors"]
