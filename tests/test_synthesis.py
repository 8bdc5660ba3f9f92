"""Cells and boxes of synthesis: what moves, and in which order boxes come."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from inkplane.functions import boxes
from inkplane.params import Settings
from inkplane.plans import catalog, synthesis

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
S = Settings()


@needs_tables
def test_cells_are_never_shuffled(spark, capsys):
    """A cell exists many times for each attempt, so a shuffle of cells would outgrow the tables."""
    catalog.QUERIES["synthesis_boxes"](spark, SF).explain("formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert any("attempt#" in columns for columns in moved)
    assert not [columns for columns in moved if "block_no#" in columns or "char_no#" in columns]


@needs_tables
def test_more_glyphs_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(synthesis, "GLYPHS", 0)
    con = duckdb.connect()
    for t in ("customer", "part", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = catalog.QUERIES["synthesis_boxes"](spark, SF).collect()
    theirs = con.sql(catalog.ORACLE_SQL["synthesis_boxes"]).project("attempt, pos, x, y, w, h").fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs)


def test_boxes_in_order_without_empty_ones(spark):
    """Rows and lists of boxes are those of the single steps; blanks and boxes off the page leave no gap."""
    cells = [(a, b, c, n, 40 * n - 30, 300 * c - 5, 0 if n == 2 else 13 + n, 21) for a in range(4) for b in (1, 2) for c in range(2) for n in range(4)]
    cells = spark.createDataFrame(cells, "attempt long, block_no int, column_no int, char_no int, x int, y int, width int, height int")
    places = "array<struct<block_no: int, x: int, y: int>>"
    pages = spark.createDataFrame([(a, None if a == 0 else a - 1.7, [(1, 17 * a, 9), (2, 560 + a, 340)]) for a in range(4)], f"attempt long, angle double, placed {places}")
    rows = pages.select("attempt", "angle", F.explode("placed").alias("p")).select("attempt", "angle", "p.block_no", F.col("p.x").alias("px"), F.col("p.y").alias("py")).join(cells, ["attempt", "block_no"])
    box = boxes.box(F.col("px") + F.col("x"), F.col("py") + F.col("y"), F.col("width"), F.col("height"))
    steps = rows.withColumn("b", boxes.clamp(boxes.expand(box, S.crop_size, S.box_margin), S.crop_size, S.crop_size)).filter(boxes.has_area(F.col("b")))
    steps = steps.withColumn("b", F.when(F.col("angle").isNull(), F.col("b")).otherwise(boxes.rotate_hull(F.col("b"), F.col("angle"), S.crop_size, S.crop_size))).filter(boxes.has_area(F.col("b")))
    want: dict[int, list] = {}
    for r in steps.orderBy("attempt", "block_no", "column_no", "char_no").select("attempt", boxes.truncate(F.col("b")).alias("b")).collect():
        want.setdefault(r.attempt, []).append(tuple(float(v) for v in r.b))
    assert 0 < sum(map(len, want.values())) < cells.count() - 16
    assert {r.attempt: [tuple(b) for b in r.boxes] for r in synthesis.boxed(pages, cells, S).collect()} == want
    got = sorted(map(tuple, synthesis.numbered_boxes(rows, S).collect()))
    assert got == [(a, n, *b) for a in sorted(want) for n, b in enumerate(want[a])]
