"""Mixing sources to target weights by Pfair scheduling (operator 2, DataFrame functions only).

Rows of a source are taken in the order of the md5 of their key and cut into blocks.
Slots are numbered from 0 and hold one block each. Block k of a source of weight w
(a share of 1) is released at slot floor(k / w) and has to run before slot
ceil((k + 1) / w). Earliest deadline first, over the blocks that are released, gives
every slot one block, ties to the smaller source. So after any number of slots each
source is less than one block away from its exact weight, however long the run.

Weights count in whole units, UNITS for the largest, so a run would have to be 10^12
slots long for that rounding to reach one block; all else is whole-number arithmetic. What a source is owed, its weight times the slots so far less what it has
had, says whether its next block is released and when that is due, and stays below
one block either way: the fold over slots carries one such number a source.

Every row is kept, no slot stays empty. When a source runs out, the others go on in
proportion to their weights, and the bound holds for them from there on; ``exact``
tells whether a row lies before that happened first.

A null source is a source like any other. Rows that repeat a key stay apart and
follow each other. Null keys are ordered first. An empty table gives no rows. All
other columns come along, whatever their names, under the operator's own columns.

How it scales: the window that numbers the rows runs within a source and one of
4096 hash ranges, so no source meets in one task, and a second, small one adds up
the ranges before. Slots follow from each other, so they are worked out one after the
other, ``STRETCH`` times ``STRETCH`` in a job that hands its state to the next by a
checkpoint; that takes time in proportion to blocks times sources, and memory for one
such piece. More rows to a block make fewer slots. Blocks meet their slots by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import cut

#: Units of the largest weight; slots of a stretch; hash ranges of a source are the first three hex digits of the md5 (4096).
UNITS, STRETCH, RANGE_DIGITS = 10**12, 512, 3
BLOCK_ROWS = 16


def tempered(counts: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights from (source, n): shares of n ** power."""
    w = F.pow(F.col("n").cast("double"), F.lit(power))
    return counts.select("source", w.alias("weight"))


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once: an array of one element names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _serve(state: Column, slot: Column) -> Column:
    """The state after one more slot. Each of ``s`` is owed its units; the block released that is due first runs."""

    def due(s: Column, i: Column) -> Column:
        left = F.call_function("div", state["units"] - s["owed"] + s["units"] - 1, s["units"])
        return F.when((s["units"] > 0) & (s["owed"] > 0), F.struct(left.alias("due"), i.alias("i")))

    def given(x: Column) -> Column:
        own = F.get(x["s"], x["i"])
        last = F.coalesce(own["done"] + 1 == own["blocks"], F.lit(False))

        def each(s: Column, i: Column) -> Column:
            runs = F.coalesce(i == x["i"], F.lit(False))
            return F.struct(
                F.when(runs & last, 0).otherwise(s["units"]).alias("units"),
                F.when(last, 0).otherwise(s["owed"] - F.when(runs, state["units"]).otherwise(0)).alias("owed"),
                (s["done"] + runs.cast("long")).alias("done"),
                s["blocks"].alias("blocks"),
            )

        return F.struct(
            F.transform(x["s"], each).alias("s"),
            (state["units"] - F.when(last, own["units"]).otherwise(0)).alias("units"),
            F.coalesce(state["first_out"], F.when(last, slot)).alias("first_out"),
            F.concat(state["order"], F.array(F.struct(slot.alias("slot"), x["i"].alias("i"), own["done"].alias("block")))).alias("order"),
        )

    grown = F.transform(state["s"], lambda s: F.struct(s["units"].alias("units"), (s["owed"] + s["units"]).alias("owed"), s["done"].alias("done"), s["blocks"].alias("blocks")))
    return _once(_once(grown, lambda s: F.struct(s.alias("s"), F.array_min(F.transform(s, due))["i"].alias("i"))), given)


_ORDER = "array<struct<slot:bigint,i:int,block:bigint>>"
_KEPT = ("s", "units", "first_out")


def _stretches(first: int, slots: int) -> Column:
    """The state after ``slots`` more slots, with their order in stretches: an array that grows slot by slot is copied each time."""

    def stretch(state: Column, at: Column) -> Column:
        start = F.struct(*[state[k].alias(k) for k in _KEPT], F.array().cast(_ORDER).alias("order"))
        run = F.aggregate(F.sequence(at, at + (STRETCH - 1)), start, _serve)
        return _once(run, lambda r: F.struct(*[r[k].alias(k) for k in _KEPT], F.concat(state["orders"], F.array(r["order"])).alias("orders")))

    start = F.struct(*[F.col(k) for k in _KEPT], F.array().cast(f"array<{_ORDER}>").alias("orders"))
    return F.aggregate(F.sequence(F.lit(first).cast("long"), F.lit(first + slots - 1).cast("long"), F.lit(STRETCH).cast("long")), start, stretch)


def schedule(weights: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, block, slot) of every block, and the one row (first_out) with the slot of the first source's last block.

    ``weights`` has (source, weight), ``ends`` (source, blocks). Sources without positive weight are left out.
    """
    w = weights.filter(F.col("weight") > 0).join(ends, "source")
    units = F.greatest(F.floor(F.col("weight") / F.max("weight").over(Window.partitionBy()) * F.lit(float(UNITS)) + 0.5).cast("long"), F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    w = w.select("source", units.alias("units"), F.col("blocks").cast("long").alias("blocks"))
    both = F.struct("source", F.struct("units", zero.alias("owed"), zero.alias("done"), "blocks").alias("s"))
    state = w.agg(F.array_sort(F.collect_list(both)).alias("all"), F.sum("units").alias("units"), F.sum("blocks").alias("slots"))
    state = cut(state.select(F.col("all.source").alias("names"), F.col("all.s").alias("s"), "units", F.lit(None).cast("long").alias("first_out"), "slots"))
    total, piece, pieces = state.first()["slots"] or 0, STRETCH * STRETCH, []
    for first in range(0, max(total, 1), piece):
        run = cut(state.select("names", _stretches(first, max(min(piece, total - first), 1)).alias("r")))
        pieces.append(run.select("names", F.explode(F.flatten("r.orders")).alias("o")).filter("o.i IS NOT NULL"))
        state = run.select("names", *[F.col(f"r.{k}") for k in _KEPT])
    placed = reduce(DataFrame.unionByName, pieces)
    return placed.select(F.get("names", F.col("o.i")).alias("source"), F.col("o.block").alias("block"), F.col("o.slot").alias("slot")), state.select("first_out")


def _spelled(source: Column) -> Column:
    """A source as a string that is never null, so that joins on it use the shuffle at hand."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """(_row, _source, _n) from (_row, _key, _source): ``_n`` is the row's number, from 0, within its source by the key's md5."""
    rows = rows.withColumn("_digest", F.md5(F.coalesce("_key", F.lit(""))))
    rows = rows.withColumn("_range", F.substring("_digest", 1, RANGE_DIGITS))
    sizes = rows.groupBy("_source", "_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_source", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_digest", F.col("_key").asc_nulls_first()))
    joined = rows.withColumn("_own", own).join(starts, ["_source", "_range"])
    return joined.select("_row", "_source", (F.col("_before") + F.col("_own") - 1).alias("_n"))


MADE = ("mix_block", "mix_slot", "mix_place", "mix_exact")


def mix(df: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``mix_block`` (number within the source), ``mix_slot``, ``mix_place`` (row of the block) and ``mix_exact``.

    Reading in order of (mix_slot, mix_place) gives the mixture. ``weights`` has
    (source, weight); by default they are tempered from the counts. Rows of sources
    without positive weight are not part of the mixture and go.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in MADE]).alias("_row")
    rows = df.select(whole, F.col(key).cast("string").alias("_key"), _spelled(F.col(source)).alias("_source"))
    counts = rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        weights = weights.select(_spelled(F.col("source")).alias("source"), "weight").join(counts.select("source"), "source")
    sizes = counts.select("source", F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"))
    placed, horizon = schedule(tempered(counts) if weights is None else weights, sizes)
    places = placed.select(F.col("source").alias("_source"), F.col("block").alias("mix_block"), F.col("slot").alias("mix_slot"))
    rows = numbered(rows).withColumn("mix_block", F.floor(F.col("_n") / F.lit(block_rows)).cast("long"))
    rows = rows.join(places, ["_source", "mix_block"]).withColumn("mix_place", F.pmod("_n", F.lit(block_rows)).cast("int"))
    rows = rows.crossJoin(F.broadcast(horizon))  # one row
    return rows.select("_row.*", "mix_block", "mix_slot", "mix_place", (F.col("mix_slot") <= F.col("first_out")).alias("mix_exact"))


def in_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """Rows of a mixture in reading order: ranges of slots, none of them cut, sorted within."""
    return mixed.repartitionByRange(partitions, "mix_slot").sortWithinPartitions("mix_slot", "mix_place")


def read_back(rows: DataFrame, file: str, row: str, source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``mix_slot`` and ``mix_place`` of rows that stand in files in the order of ``in_order``, as columns ``file`` and ``row`` tell.

    Nothing is scheduled: a block begins where another source does, and after ``block_rows``
    rows, as only the last block of a source is shorter. Rows in any other order are numbered
    the same way and keep it. A window runs within a file.
    """
    within = Window.partitionBy(file).orderBy(row)
    until = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.row_number().over(within) - 1)
    other = (F.col("_n") == 0) | ~F.lag(source).over(within).eqNullSafe(F.col(source))
    rows = rows.withColumn("_run", F.max(F.when(other, F.col("_n"))).over(until))
    rows = rows.withColumn("mix_place", F.pmod(F.col("_n") - F.col("_run"), F.lit(block_rows)).cast("int"))
    rows = rows.withColumn("_slot", F.sum((F.col("mix_place") == 0).cast("long")).over(until) - 1)
    ends = rows.groupBy(file).agg((F.max("_slot") + 1).alias("_slots"))
    before = F.sum("_slots").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    starts = ends.select(file, F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.join(starts, file).withColumn("mix_slot", F.col("_before") + F.col("_slot"))
    return placed.drop(file, row, "_n", "_run", "_slot", "_before")
