"""Boxes (x, y, w, h), in pixels from the upper left: structs of doubles, null where a part is null.

Every step works its input out once, however often it uses it: steps follow each
other inside one expression, where a plain reference would repeat all steps before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _parts(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, w, h), "xywh", strict=True)])


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), _parts(x, y, w, h))


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value worked out once; null stays null."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), make(v))), F.lit(0))


def expand(b: Column, side: float, margin: float) -> Column:
    """Wider by a share of its size on every side. The left and upper clamp don't shrink it; beyond the right edge sizes turn negative."""

    def along(at: Column, size: Column) -> tuple[Column, Column]:
        pad = size * F.lit(float(margin))
        start = F.greatest(F.lit(0.0), at - pad)
        return start, F.least(F.lit(float(side)) - start, size + 2 * pad)

    def made(v: Column) -> Column:
        (x, w), (y, h) = along(v["x"], v["w"]), along(v["y"], v["h"])
        return _parts(x, y, w, h)

    return once(b, made)


def clamp(b: Column, width: float, height: float) -> Column:
    """Within the image. What lies wholly to the right or below keeps one pixel, to the left or above none."""

    def along(at: Column, size: Column, most: float) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0.0), F.least(F.lit(float(most) - 1), at))
        return start, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), at + size)) - start

    def made(v: Column) -> Column:
        (x, w), (y, h) = along(v["x"], v["w"], width), along(v["y"], v["h"], height)
        return _parts(x, y, w, h)

    return once(b, made)


def has_area(b: Column) -> Column:
    return once(b, lambda v: (v["w"] > 0) & (v["h"] > 0))


def truncate(b: Column) -> Column:
    """Whole numbers, toward zero."""
    return once(b, lambda v: F.struct(*[v[n].cast("int").alias(n) for n in "xywh"]))


def normalise(b: Column, side: float) -> Column:
    """Centre and size as shares of the side, each clamped to [0, 1] on its own."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.lit(float(side))))
    return once(b, lambda v: F.struct(unit(v["x"] + v["w"] / 2).alias("cx"), unit(v["y"] + v["h"] / 2).alias("cy"), unit(v["w"]).alias("w"), unit(v["h"]).alias("h")))


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners (x0, y0, x1, y1), in pixels, of a normalised label."""
    px, py, pw, ph = cx * width, cy * height, w * width, h * height
    return F.struct((px - pw / 2).alias("x0"), (py - ph / 2).alias("y0"), (px + pw / 2).alias("x1"), (py + ph / 2).alias("y1"))


@pandas_udf(T.StringType())
def label_text(cx: pd.Series, cy: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """A label line with six decimals each. Only this needs Python: JVM formatting rounds ties another way."""
    return pd.Series([None if any(pd.isna(v) for v in r) else "0 %.6f %.6f %.6f %.6f" % r for r in zip(cx, cy, w, h, strict=True)])


def rotate_hull(b: Column, degrees: Column, width: float, height: float) -> Column:
    """Upright hull of the box turned about the image's centre, clipped to the image.

    Assumption: hull of the four corners, as augmentation libraries do.
    """
    mx, my = F.lit(width / 2.0), F.lit(height / 2.0)
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))

    def ends(v: Column) -> Column:
        xs, ys = [], []
        for x in (v["b"]["x"] - mx, v["b"]["x"] + v["b"]["w"] - mx):
            for y in (v["b"]["y"] - my, v["b"]["y"] + v["b"]["h"] - my):
                xs.append(mx + x * v["cos"] + y * v["sin"])
                ys.append(my - x * v["sin"] + y * v["cos"])
        parts = {"x0": F.least(*xs), "x1": F.greatest(*xs), "y0": F.least(*ys), "y1": F.greatest(*ys)}
        return F.struct(*[inside(c, width if n[0] == "x" else height).alias(n) for n, c in parts.items()])

    turned = F.struct(b.alias("b"), F.cos(F.radians(degrees)).alias("cos"), F.sin(F.radians(degrees)).alias("sin"))
    return once(once(F.when(b.isNotNull(), turned), ends), lambda e: _parts(e["x0"], e["y0"], e["x1"] - e["x0"], e["y1"] - e["y0"]))


# --- the same steps on whole tables -------------------------------------------------------
#
# Tables keep a box in four plain columns: x, y, w, h. A step is one projection, so each
# value is worked out once, by generated code; null parts stay null as far as they reach.

SIDES = (("x", "w"), ("y", "h"))


def _stepped(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def expanded(df: DataFrame, side: float, margin: float) -> DataFrame:
    """``expand``, in two projections: starts, then sizes."""
    starts = {at: F.greatest(F.lit(0.0), F.col(at) - F.col(size) * F.lit(float(margin))) for at, size in SIDES}
    rows = _stepped(df, starts)
    return _stepped(rows, {size: F.least(F.lit(float(side)) - F.col(at), F.col(size) + 2 * (F.col(size) * F.lit(float(margin)))) for at, size in SIDES})


def within(df: DataFrame, width: float, height: float) -> DataFrame:
    """``clamp``."""
    made = {}
    for (at, size), most in zip(SIDES, (width, height), strict=True):
        start = F.greatest(F.lit(0.0), F.least(F.lit(float(most) - 1), F.col(at)))
        made |= {at: start, size: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col(at) + F.col(size))) - start}
    return _stepped(df, made)


def clamped(df: DataFrame, width: float, height: float) -> DataFrame:
    """``clamp``, and boxes without area go."""
    return within(df, width, height).filter((F.col("w") > 0) & (F.col("h") > 0))


def normalised(df: DataFrame, side: float) -> DataFrame:
    """``normalise``: columns cx, cy, w, h instead."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.lit(float(side))))
    others = [c for c in df.columns if c not in "xywh"]
    return df.select(*others, *[unit(F.col(at) + F.col(size) / 2).alias(f"c{at}") for at, size in SIDES], *[unit(F.col(size)).alias(size) for _, size in SIDES])


def hulled(df: DataFrame, degrees: Column, width: float, height: float) -> DataFrame:
    """``rotate_hull``."""
    others = [c for c in df.columns if c not in "xywh"]
    rows = df.select("*", F.cos(F.radians(degrees)).alias("_cos"), F.sin(F.radians(degrees)).alias("_sin"))
    cos, sin = F.col("_cos"), F.col("_sin")
    a, b = ([F.col(at) + size - F.lit(most / 2.0) for size in (F.lit(0.0), F.col(size))] for (at, size), most in zip(SIDES, (width, height), strict=True))
    # rounded sums rise with their parts, so the least sum is that of the least parts, to the last bit
    along = lambda pick, ends, by: pick(*[v * by for v in ends])
    far = {F.least: F.greatest, F.greatest: F.least}
    across = lambda pick: F.lit(width / 2.0) + along(pick, a, cos) + along(pick, b, sin)
    down = lambda pick: F.lit(height / 2.0) - along(far[pick], a, sin) + along(pick, b, cos)
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    ends = {"_x0": inside(across(F.least), width), "_x1": inside(across(F.greatest), width), "_y0": inside(down(F.least), height), "_y1": inside(down(F.greatest), height)}
    ends = rows.select(*others, *[F.when(whole, v).alias(n) for n, v in ends.items()])
    return ends.select(*others, F.col("_x0").alias("x"), F.col("_y0").alias("y"), (F.col("_x1") - F.col("_x0")).alias("w"), (F.col("_y1") - F.col("_y0")).alias("h"))


def turned_corner(x: float, y: float, degrees: float, width: float, height: float) -> tuple[float, float]:
    """One corner, for tests."""
    a = math.radians(degrees)
    dx, dy = x - width / 2, y - height / 2
    return width / 2 + dx * math.cos(a) + dy * math.sin(a), height / 2 - dx * math.sin(a) + dy * math.cos(a)
