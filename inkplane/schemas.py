"""Schemas of the tables that operators take and return."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "w", "h")])
DICTIONARY = T.StructType([T.StructField("kanji", T.StringType()), T.StructField("jlpt_new", T.IntegerType())])
FONT_GLYPH = T.StructType([T.StructField("font", T.StringType()), T.StructField("codepoint", T.IntegerType())])
LABEL = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("class", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("cx", "cy", "w", "h")]
)
REGION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("top", "left", "width", "height")])
RASTER = T.StructType([T.StructField(n, T.IntegerType()) for n in ("height", "width", "channels")] + [T.StructField("data", T.BinaryType())])
