"""Capture regions on a monitor, ink and grey values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the keys, and the smallest side.
MOVE, GROW, SHIFT, LEAST = 20, 50, 25, 100


def _between(v: Column, low: Column | int, high: Column) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    return F.greatest(low, F.least(v, high))


def region(top: Column, left: Column, width: Column, height: Column) -> Column:
    return F.struct(top.cast("int").alias("top"), left.cast("int").alias("left"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def clip(r: Column, monitor: Column) -> Column:
    """Size first, then the corner, so that the region lies within the monitor (left, top, width, height)."""
    width = _between(r["width"], LEAST, monitor["width"])
    height = _between(r["height"], LEAST, monitor["height"])
    left = _between(r["left"], monitor["left"], monitor["left"] + monitor["width"] - width)
    top = _between(r["top"], monitor["top"], monitor["top"] + monitor["height"] - height)
    return region(top, left, width, height)


def initial(monitor: Column, width: int = 1920, height: int = 1080) -> Column:
    """Centred, of the size given or the monitor's."""
    w, h = F.least(F.lit(width), monitor["width"]), F.least(F.lit(height), monitor["height"])
    half = lambda v: F.floor(v / 2)
    return clip(region(monitor["top"] + half(monitor["height"] - h), monitor["left"] + half(monitor["width"] - w), w, h), monitor)


def press(r: Column, key: Column, monitor: Column) -> Column:
    """The region after a key; keys without meaning change nothing."""
    step = lambda plus, minus, n: F.when(key == plus, n).when(key == minus, -n).otherwise(0)
    top = r["top"] + step("s", "w", MOVE) + step("f", "r", SHIFT)
    left = r["left"] + step("d", "a", MOVE) + step("f", "r", SHIFT)
    grown = step("r", "f", GROW)
    moved = clip(region(top, left, r["width"] + grown, r["height"] + grown), monitor)
    return F.when(key.isin("w", "s", "a", "d", "r", "f"), moved).otherwise(r)


def ink(mean: Column, u_side: Column, u_dark: Column, u_light: Column) -> Column:
    """Grey of the ink: dark on bright ground, light on dark ground, either between."""
    dark, light = F.floor(u_dark * 41).cast("int"), (F.lit(215) + F.floor(u_light * 41)).cast("int")
    return F.when(mean > 180, dark).when(mean < 80, light).when(u_side < 0.5, dark).otherwise(light)


def stroke(grey: Column) -> Column:
    return F.when(grey < 128, 255).otherwise(0)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey of a colour. Assumption: the usual weights 299, 587 and 114 per mille in 16-bit fixed point."""
    return F.shiftright(r.cast("int") * 19595 + g.cast("int") * 38470 + b.cast("int") * 7471 + 0x8000, 16)
