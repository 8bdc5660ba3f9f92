"""Glyph rasters from outlines: coverage of every pixel, and a stroke around.

Shapes are rows (font, codepoint, units, ascent, contours); measures of glyphs at a size
are column expressions, rasters are made once for each (font, codepoint, size) that is
wanted, in Arrow batches, and joined to the cells that show them.

Assumptions about the usual text renderer: no hinting; the pen stands at the upper left,
the base line ``ascent`` below it, rounded up; a box is the smallest one of whole
pixels around the ink, without the stroke.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The character whose box is the cell of all, and the stroke's width.
CELL, STROKE = 0x5B57, 2
SHAPE = "font string, codepoint int, units int, ascent int, advance int, contours array<array<struct<x: double, y: double>>>"
RASTER = "font string, codepoint int, size int, left int, top int, width int, height int, fill binary, stroke binary"


def squares(spark: SparkSession, fonts: int, chars: int, first: int = 0x4E00) -> DataFrame:
    """Shapes of made-up fonts in which every character is a square of 0.8 em, for runs without a font file."""
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    line = F.array(corner(100, 0), corner(900, 0), corner(900, 800), corner(100, 800))
    codes = spark.range(chars).select((F.col("id") + first).cast("int").alias("codepoint")).unionByName(spark.createDataFrame([(CELL,)], "codepoint int")).distinct()
    names = spark.range(fonts).select(F.format_string("square-%d", "id").alias("font"))
    return codes.crossJoin(names).select("font", "codepoint", F.lit(1000).alias("units"), F.lit(880).alias("ascent"), F.lit(1000).alias("advance"), F.array(line).alias("contours"))


def measured(shapes: DataFrame) -> DataFrame:
    """``shapes`` with the bounds of their ink (x0, y0, x1, y1), in the font's units; all null for blanks."""
    along = lambda axis: F.flatten(F.transform("contours", lambda line: line[axis]))
    return shapes.withColumns({f"{axis}{k}": pick(along(axis)) for axis in "xy" for k, pick in enumerate((F.array_min, F.array_max))})


def box(size: Column) -> Column:
    """(left, top, width, height), in whole pixels from the pen, of a measured shape at a size; empty for blanks."""
    scale = size.cast("double") / F.col("units")
    up = F.ceil(F.col("ascent") * scale)
    left, right, top, low = F.floor(F.col("x0") * scale), F.ceil(F.col("x1") * scale), up - F.ceil(F.col("y1") * scale), up - F.floor(F.col("y0") * scale)
    parts = {"left": left, "top": top, "width": right - left, "height": low - top}
    return F.struct(*[F.coalesce(c, F.lit(0)).cast("int").alias(n) for n, c in parts.items()])


def cell_sizes(shapes: DataFrame, sizes: Column) -> DataFrame:
    """(font, size, cell_w, cell_h) of every font, for each of an array of sizes; a font without the cell's character, or with a blank for it, has square cells."""
    fonts = shapes.select("font").distinct().withColumn("size", F.explode(sizes))
    found = measured(shapes.filter(F.col("codepoint") == CELL)).withColumn("size", F.explode(sizes)).withColumn("b", box(F.col("size")))
    joined = fonts.join(found.select("font", "size", "b"), ["font", "size"], "left")
    side = lambda part: F.when(F.col(part) > 0, F.col(part)).otherwise(F.col("size"))
    return joined.select("font", "size", side("b.width").alias("cell_w"), side("b.height").alias("cell_h"))


def coverage(edges: np.ndarray, height: int, width: int) -> np.ndarray:
    """Share of each pixel inside polygons with edges (x0, y0, x1, y1), y downwards: winding numbers integrated exactly, 1 at most."""
    x0, y0, x1, y1 = (edges[:, k, None] for k in range(4))
    rows = np.arange(height)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(y1 == y0, 0.0, (x1 - x0) / (y1 - y0))
    a, b = np.clip(y0, rows, rows + 1), np.clip(y1, rows, rows + 1)  # the part of the edge in each row
    e, r = np.nonzero(a != b)
    xa, xb, dy = (x0 + (a - y0) * slope)[e, r], (x0 + (b - y0) * slope)[e, r], (b - a)[e, r]
    out = np.zeros((height, width))
    low, high = np.minimum(xa, xb)[:, None], np.maximum(xa, xb)[:, None]
    # mean of min(max(right - x, 0), 1) while x goes from low to high
    right = np.arange(1, width + 1)[None, :]
    gone = lambda t: np.where(t <= 0, 0.0, np.where(t >= 1, t - 0.5, t * t / 2))
    span = high - low
    mean = np.where(span > 1e-9, (gone(right - low) - gone(right - high)) / np.where(span > 1e-9, span, 1.0), np.clip(right - (low + high) / 2, 0, 1))
    np.add.at(out, r, mean * dy[:, None])
    return np.minimum(np.abs(out), 1.0)


def distance(edges: np.ndarray, height: int, width: int) -> np.ndarray:
    """Distance of each pixel's centre from the nearest edge."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    best = np.full((height, width), np.inf)
    for x0, y0, x1, y1 in edges.tolist():
        dx, dy = x1 - x0, y1 - y0
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy or 1.0), 0, 1)
        np.minimum(best, (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2, out=best)
    return np.sqrt(best)


def around(edges: np.ndarray, fill: np.ndarray, reach: float) -> np.ndarray:
    """Coverage of what is within ``reach`` of the shape, soft over one pixel."""
    return np.maximum(fill, np.clip(reach + 0.5 - distance(edges, *fill.shape), 0, 1))


def edges_of(lines: list[np.ndarray]) -> np.ndarray:
    """(x0, y0, x1, y1) of closed lines of corners."""
    return np.concatenate([np.hstack([p, np.roll(p, -1, axis=0)]) for p in lines]) if lines else np.zeros((0, 4))


def covered(df: DataFrame, height: int, width: int, reach: float | None = None) -> DataFrame:
    """``df`` with ``cover``, the coverage of each pixel by the lines in ``contours`` (pixels, y downwards), row by row; with what is within ``reach`` of them, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines in batch.column("contours").to_pylist():
                edges = edges_of([np.array([(p["x"], p["y"]) for p in line]) for line in lines])
                fill = coverage(edges, height, width)
                out.append((fill if reach is None else around(edges, fill, reach)).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "cover"])

    kind = T.StructType([*df.drop("contours").schema.fields, T.StructField("cover", T.ArrayType(T.DoubleType()))])
    return df.select(*[c for c in df.columns if c != "contours"], "contours").mapInArrow(run, kind)


def _rasters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fills, strokes = [], []
        for r in batch.select(["size", "left", "top", "width", "height", "units", "ascent", "contours"]).to_pylist():
            if not r["width"] or not r["height"]:
                fills.append(b"")
                strokes.append(b"")
                continue
            scale, up = r["size"] / r["units"], np.ceil(r["ascent"] * (r["size"] / r["units"]))
            lines = [np.array([(p["x"] * scale - r["left"] + STROKE, up - p["y"] * scale - r["top"] + STROKE) for p in line]) for line in r["contours"]]
            edges = edges_of(lines)
            fill = coverage(edges, r["height"] + 2 * STROKE, r["width"] + 2 * STROKE)
            fills.append(np.rint(255 * fill).astype(np.uint8).tobytes())
            strokes.append(np.rint(255 * around(edges, fill, STROKE)).astype(np.uint8).tobytes())
        kept = ["font", "codepoint", "size", "left", "top", "width", "height"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fills, pa.binary()), pa.array(strokes, pa.binary())], [*kept, "fill", "stroke"])


def rasters(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each (font, codepoint, size) wanted: box from the pen, and coverage of fill and stroke on the box widened by the stroke."""
    each = wanted.select("font", "codepoint", "size").distinct()
    rows = measured(shapes).join(each, ["font", "codepoint"]).withColumn("b", box(F.col("size")))
    return rows.select("font", "codepoint", "size", "b.*", "units", "ascent", "contours").mapInArrow(_rasters, RASTER)


def stamp(image: np.ndarray, x: int, y: int, cover: np.ndarray, grey: int) -> None:
    """Blends ``grey`` over an RGB image, where ``cover`` (0 to 255) says how much; what lies outside is cut off."""
    h, w = cover.shape
    top, left = max(0, -y), max(0, -x)
    part = image[max(0, y) : y + h, max(0, x) : x + w]
    if part.size:
        c = cover[top : top + part.shape[0], left : left + part.shape[1], None].astype(np.int32)
        part[:] = (part * (255 - c) + grey * c + 127) // 255
