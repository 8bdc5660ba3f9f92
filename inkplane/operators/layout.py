"""Text blocks: sizes, fit, and the cell of every character, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERTICAL, HORIZONTAL = "vertical", "horizontal"


def block_size(direction: Column, columns: Column, chars: Column, cell_w: Column, cell_h: Column, char_gap: Column, column_gap: Column) -> Column:
    tall = direction == VERTICAL
    width = F.when(tall, columns * (cell_w + column_gap)).otherwise(chars * (cell_w + char_gap))
    height = F.when(tall, chars * (cell_h + char_gap)).otherwise(columns * (cell_h + column_gap))
    return F.struct(width.cast("int").alias("bw"), height.cast("int").alias("bh"))


def fits(bw: Column, bh: Column, side: int) -> Column:
    """Room to spare on both sides: an exact fit is none."""
    return (F.lit(side) - bw > 0) & (F.lit(side) - bh > 0)


def cells(blocks: DataFrame) -> DataFrame:
    """A row for each character of each block, with its place (cell_x, cell_y).

    ``blocks`` has start_x, start_y, direction, columns, chars, cell_w, cell_h, char_gap and column_gap.
    """
    rows = blocks.withColumn("column_no", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    rows = rows.withColumn("char_no", F.explode(F.sequence(F.lit(0), F.col("chars") - 1)))
    tall = F.col("direction") == VERTICAL
    along_x = F.when(tall, F.col("column_no") * (F.col("cell_w") + F.col("column_gap"))).otherwise(F.col("char_no") * (F.col("cell_w") + F.col("char_gap")))
    along_y = F.when(tall, F.col("char_no") * (F.col("cell_h") + F.col("char_gap"))).otherwise(F.col("column_no") * (F.col("cell_h") + F.col("column_gap")))
    return rows.withColumn("cell_x", (F.col("start_x") + along_x).cast("int")).withColumn("cell_y", (F.col("start_y") + along_y).cast("int"))
