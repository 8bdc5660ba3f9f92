"""Label lines: parsing, pairing with pages, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplane.functions import boxes
from inkplane.functions.text import tokens


def parse(lines: DataFrame) -> DataFrame:
    """(name, line_no, class, cx, cy, w, h) from (name, line_no, value). Lines without five parts go; numbers that don't parse raise."""
    rows = lines.withColumn("p", tokens(F.col("value"))).filter(F.size("p") == 5)
    part = lambda i: F.element_at("p", i).cast("double")
    return rows.select("name", "line_no", F.lit(0).alias("class"), part(2).alias("cx"), part(3).alias("cy"), part(4).alias("w"), part(5).alias("h"))


def to_corners(labels: DataFrame, width: int, height: int) -> DataFrame:
    c = boxes.corners(*[F.col(n) for n in ("cx", "cy", "w", "h")], F.lit(float(width)), F.lit(float(height)))
    return labels.withColumn("c", c).select("name", "line_no", "c.x0", "c.y0", "c.x1", "c.y1")


def lines_of(rows: DataFrame, side: float) -> DataFrame:
    """(page, block_no, box_no, line) from boxes; one pass through Python, for the rounding of the text."""
    n = boxes.normalise(F.col("box"), side)
    made = rows.withColumn("n", n)
    return made.withColumn("line", boxes.label_text("n.cx", "n.cy", "n.w", "n.h")).drop("n")


def page_texts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, n_boxes, text) for every page, the empty text for pages without boxes. ``lines`` has (page, block_no, box_no, line)."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "box_no", "line")))
    text = F.concat(F.array_join(F.transform("o", lambda x: x["line"]), "\n"), F.lit("\n"))
    grouped = lines.groupBy("page").agg(ordered.alias("o"), F.count("*").alias("n"))
    found = pages.select("page").distinct().join(grouped, "page", "left")
    return found.select("page", F.coalesce("n", F.lit(0)).cast("long").alias("n_boxes"), F.coalesce(text, F.lit("")).alias("text"))


def pair_audit(images: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, has_image, has_label) over both sides."""
    a, b = images.select("name").distinct().withColumn("i", F.lit(True)), texts.select("name").distinct().withColumn("t", F.lit(True))
    return a.join(b, "name", "full").select("name", F.coalesce("i", F.lit(False)).alias("has_image"), F.coalesce("t", F.lit(False)).alias("has_label"))


def inventory(files: DataFrame) -> DataFrame:
    """(split, kind, n) of (split, kind) rows, all four combinations, zero where nothing is."""
    spark = files.sparkSession
    every = spark.createDataFrame([(s, k) for s in ("train", "val") for k in ("images", "labels")], "split string, kind string")
    counted = files.groupBy("split", "kind").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, ["split", "kind"], "left").select("split", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
