"""Synthetic pages: crops of source pages with text blocks, degraded, with their boxes.

Everything that is drawn is a hash of seed and key, so it is known before anything is
painted: attempts draw a page and a place in it, blocks their font, size and layout,
cells their characters. All these are plain rows, joined on what was drawn. Rasters move
twice at most: pages are cropped where they are decoded, and only pages that were drawn
are; crops then meet the glyphs of their blocks and are painted in one Arrow stage,
block after block, since a block looks at what earlier ones left on the page. Boxes are
columns again, from the places that painting chose. Attempts are made in waves, kept in
the shared folder, until enough succeed or the cap of attempts is reached; the result
does not depend on the size of the waves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.functions import boxes, draws
from inkplane.functions.text import page_name
from inkplane.operators import charset, glyphs, labels, layout, numbering, raster
from inkplane.params import Settings
from inkplane.sources import pages as sources

#: Sizes of letters, gaps between them and between columns, greys of dark and light ink.
SIZES, CHAR_GAPS, COLUMN_GAPS, DARK, LIGHT = (24, 48), (2, 6), (4, 10), (0, 40), (215, 255)
#: Attempts of a wave that are sent to the pages, not the pages to them: some 60 bytes each.
SENT = 1 << 17
#: Glyphs of all fonts together whose measures are sent to the cells, not the cells to them: some 150 bytes each.
GLYPHS = 1 << 20
#: Attempts of one part: some 160 cells each, sorted in memory.
PART = 1 << 12

BOXES = "array<struct<x: double, y: double, w: double, h: double>>"
PAINTED = "attempt long, negative boolean, height int, width int, data binary, placed array<struct<block_no: int, x: int, y: int>>"


def _u(seed: int, purpose: str, *key: Column | str) -> Column:
    return draws.uniform(seed, purpose, *key)


def attempts_of(rows: DataFrame, population: numbering.Population, s: Settings, seed: int) -> DataFrame:
    """(attempt, negative, path, crop_x, crop_y, n_blocks) of attempts (attempt)."""
    rows = rows.select("attempt").withColumn("negative", draws.happens(_u(seed, "negative", "attempt"), s.negative_probability))
    rows = population.draw(rows, seed, "attempt")
    place = lambda purpose, side: draws.whole(_u(seed, purpose, "attempt"), 0, F.col(side) - s.crop_size)
    n_blocks = F.when(F.col("negative"), 0).otherwise(draws.whole(_u(seed, "blocks", "attempt"), s.blocks_min, s.blocks_max))
    return rows.select("attempt", "negative", "path", place("crop_x", "width").alias("crop_x"), place("crop_y", "height").alias("crop_y"), n_blocks.alias("n_blocks"))


def dealt(attempts: DataFrame, n: int) -> DataFrame:
    """``n`` attempts in parts of about ``PART``, so that what is made of an attempt, many times as large, lies together and needs no shuffle to meet."""
    return attempts.repartition(max(attempts.sparkSession.sparkContext.defaultParallelism, -(-n // PART)), "attempt")


def place(t: Column, s: Settings, seed: int) -> Column:
    """The place (x, y) that try ``t`` gives to a block."""
    at = lambda axis, size: draws.whole(_u(seed, axis, "attempt", "block_no", t), 0, F.lit(s.crop_size) - F.col(size))
    return F.struct(at("x", "bw").alias("x"), at("y", "bh").alias("y"))


def blocks_of(attempts: DataFrame, shapes: DataFrame, s: Settings, seed: int) -> DataFrame:
    """The blocks of attempts that fit into a crop, with the places to try and their inks."""
    fonts = sorted(r.font for r in shapes.select("font").distinct().collect())  # font files, few
    rows = attempts.filter("n_blocks > 0").select("attempt", F.explode(F.sequence(F.lit(1), F.col("n_blocks"))).alias("block_no"))
    u = lambda purpose: _u(seed, purpose, "attempt", "block_no")
    rows = rows.select(
        "attempt", "block_no", F.element_at(F.array(*[F.lit(f) for f in fonts]), (F.floor(u("font") * len(fonts)) + 1).cast("int")).alias("font"), draws.whole(u("size"), *SIZES).alias("size"),
        draws.whole(u("columns"), s.columns_min, s.columns_max).alias("columns"), draws.whole(u("chars"), s.chars_min, s.chars_max).alias("chars"),
        draws.whole(u("char_gap"), *CHAR_GAPS).alias("char_gap"), draws.whole(u("column_gap"), *COLUMN_GAPS).alias("column_gap"),
        F.when(draws.happens(u("direction"), 0.5), layout.VERTICAL).otherwise(layout.HORIZONTAL).alias("direction"),
    )
    rows = rows.join(F.broadcast(glyphs.cell_sizes(shapes, F.sequence(F.lit(SIZES[0]), F.lit(SIZES[1])))), ["font", "size"])
    rows = rows.withColumn("b", layout.block_size(*[F.col(c) for c in ("direction", "columns", "chars", "cell_w", "cell_h", "char_gap", "column_gap")]))
    rows = rows.select("*", "b.bw", "b.bh").drop("b").filter(layout.fits(F.col("bw"), F.col("bh"), s.crop_size))
    tries = F.transform(F.sequence(F.lit(1), F.lit(s.position_tries)), lambda t: place(t, s, seed))
    inks = [draws.whole(u("dark"), *DARK).alias("dark"), draws.whole(u("light"), *LIGHT).alias("light"), draws.happens(u("side"), 0.5).alias("prefers_dark")]
    return rows.select("*", tries.alias("tries"), *inks)


def letters_of(shapes: DataFrame, characters: DataFrame) -> numbering.Population:
    """Numbered characters (codepoint) with the measures of their glyph in every font. Up to ``GLYPHS`` glyphs go to the cells, more are joined with them."""
    numbered = numbering.Population.of(characters, "codepoint")
    known = glyphs.measured(shapes).select("font", "codepoint", "units", "ascent", "x0", "y0", "x1", "y1")
    rows = known.join(numbered.rows, "codepoint")
    return numbering.Population(F.broadcast(rows) if rows.count() <= GLYPHS else rows, numbered.size)


def cells_of(blocks: DataFrame, letters: numbering.Population, seed: int, *kept: str) -> DataFrame:
    """(attempt, block_no, column_no, char_no, font, codepoint, size, x, y, width, height) of every cell: its glyph's box from the block's corner; and the columns of the block that are ``kept``."""
    rows = layout.cells(blocks.drop("tries").withColumns({"start_x": F.lit(0), "start_y": F.lit(0)}))
    rows = rows.withColumn("key", F.concat_ws("-", "attempt", "block_no", "column_no", "char_no"))
    rows = letters.draw(rows, seed, "key", "font").withColumn("b", glyphs.box(F.col("size")))
    return rows.select("attempt", "block_no", "column_no", "char_no", "font", "codepoint", "size", (F.col("cell_x") + F.col("b.left")).alias("x"), (F.col("cell_y") + F.col("b.top")).alias("y"), "b.width", "b.height", *kept)


def _crops(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            page = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
            crop = page[r["crop_y"] : r["crop_y"] + side, r["crop_x"] : r["crop_x"] + side].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([r["attempt"]]), pa.array([r["negative"]]), pa.array([crop], pa.binary())], ["attempt", "negative", "data"])


def crops_of(attempts: DataFrame, source: sources.Decoded | sources.Scans, n: int, side: int) -> DataFrame:
    """(attempt, negative, data): what each attempt cuts out of its page. Up to ``SENT`` attempts go to the pages, more are joined with them."""
    drawn = attempts.select("attempt", "negative", "path", "crop_x", "crop_y")
    decoded = source.decode(drawn.select("path").distinct()).select("path", "height", "width", "data")
    joined = decoded.join(F.broadcast(drawn) if n <= SENT else drawn, "path")
    return joined.mapInArrow(lambda it: _crops(it, side), "attempt long, negative boolean, data binary")


def paint(image: np.ndarray, blocks: list[dict], limit: float) -> list[dict]:
    """Paints the blocks on an RGB image, each on the first of its places that is even enough, and returns the places."""
    placed, sums = [], None
    for b in sorted(blocks, key=lambda b: b["block_no"]):
        sums = sums or raster.Sums(raster.grey(image))
        for t in b["tries"]:
            deviation, mean = sums.statistics(t["x"], t["y"], b["bw"], b["bh"])
            if deviation <= limit:
                break
        else:
            continue
        ink = b["dark"] if mean > 180 or (mean >= 80 and b["prefers_dark"]) else b["light"]
        for c in sorted(b["cells"], key=lambda c: (c["column_no"], c["char_no"])):
            if c["fill"]:
                shape = (c["height"] + 2 * glyphs.STROKE, c["width"] + 2 * glyphs.STROKE)
                for cover, grey in ((c["stroke"], 255 if ink < 128 else 0), (c["fill"], ink)):
                    glyphs.stamp(image, t["x"] + c["x"] - glyphs.STROKE, t["y"] + c["y"] - glyphs.STROKE, np.frombuffer(cover, np.uint8).reshape(shape), grey)
        placed.append({"block_no": b["block_no"], "x": t["x"], "y": t["y"]})
        sums = None
    return placed


def _paint(batches: Iterator[pa.RecordBatch], side: int, limit: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("block_no", pa.int32()), ("x", pa.int32()), ("y", pa.int32())]))
    for batch in batches:
        for i in range(batch.num_rows):
            (r,) = batch.slice(i, 1).to_pylist()
            image = np.frombuffer(r["data"], np.uint8).reshape(side, side, 3).copy()
            placed = paint(image, r["blocks"] or [], limit)
            columns = [pa.array([r["attempt"]]), pa.array([r["negative"]]), *(pa.array([side], pa.int32()),) * 2, pa.array([image.tobytes()], pa.binary()), pa.array([placed], kind)]
            yield pa.RecordBatch.from_arrays(columns, ["attempt", "negative", "height", "width", "data", "placed"])


def painted(crops: DataFrame, blocks: DataFrame, cells: DataFrame, shapes: DataFrame, s: Settings) -> DataFrame:
    """Crops with their blocks painted, and where each block was placed; each glyph is made once."""
    made = cells.join(glyphs.rasters(shapes, cells).select("font", "codepoint", "size", "fill", "stroke"), ["font", "codepoint", "size"])
    listed = made.groupBy("attempt", "block_no").agg(F.collect_list(F.struct("column_no", "char_no", "x", "y", "width", "height", "fill", "stroke")).alias("cells"))
    full = blocks.select("attempt", "block_no", "bw", "bh", "tries", "dark", "light", "prefers_dark").join(listed, ["attempt", "block_no"])
    by_page = full.groupBy("attempt").agg(F.collect_list(F.struct(*[c for c in full.columns if c != "attempt"])).alias("blocks"))
    return crops.join(by_page, "attempt", "left").select("attempt", "negative", "data", "blocks").mapInArrow(lambda it: _paint(it, s.crop_size, s.region_deviation_limit), PAINTED)


def boxes_of(cells: DataFrame, s: Settings) -> DataFrame:
    """(attempt, block_no, column_no, char_no, ok, x, y, w, h): boxes of cells whose block stands on (px, py), on pages turned by ``angle``: grown, clamped, turned with the page, in whole pixels.

    Only those that are ``ok`` have an area after each step. They are left here: a filter would be pushed below the steps, and work them all out once more.
    """
    side, sides = s.crop_size, {"x": F.col("px") + F.col("x"), "y": F.col("py") + F.col("y"), "w": F.col("width"), "h": F.col("height")}
    names, area = ("attempt", "block_no", "column_no", "char_no"), (F.col("w") > 0) & (F.col("h") > 0)
    rows = cells.select(*names, "angle", *[c.cast("double").alias(n) for n, c in sides.items()])
    rows = boxes.within(boxes.expanded(rows, side, s.box_margin), side, side)
    rows = boxes.hulled(rows.withColumns({f"_{n}": F.col(n) for n in "xywh"} | {"ok": area}), F.col("angle"), side, side)
    rows = rows.select(*names, "ok", *[F.when(F.col("angle").isNull(), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in "xywh"])
    return rows.select(*names, (F.col("ok") & area).alias("ok"), *[F.col(n).cast("int").cast("double").alias(n) for n in "xywh"])


def boxed(planned: DataFrame, cells: DataFrame, s: Settings) -> DataFrame:
    """(attempt, boxes) of painted pages with their degradation's ``angle``."""
    placed = planned.select("attempt", "angle", F.explode("placed").alias("p")).select("attempt", "angle", "p.block_no", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    listed = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("block_no", "column_no", "char_no", F.struct("x", "y", "w", "h").alias("box")))))
    return boxes_of(placed.join(cells, ["attempt", "block_no"]), s).groupBy("attempt").agg(F.transform(listed, lambda x: x["box"]).cast(BOXES).alias("boxes"))


def numbered_boxes(cells: DataFrame, s: Settings) -> DataFrame:
    """(attempt, pos, x, y, w, h): the boxes of ``boxed`` as rows. What is dealt by attempt stays where it is."""
    order = Window.partitionBy("attempt").orderBy("block_no", "column_no", "char_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = boxes_of(cells, s).withColumn("pos", F.sum(F.col("ok").cast("int")).over(order).cast("int") - 1)
    return rows.filter("ok").select("attempt", "pos", "x", "y", "w", "h")


def synthesise(
    images: DataFrame | sources.Scans, amount: int, start: int = 0, settings: Settings | None = None, shapes: DataFrame | None = None,
    characters: DataFrame | None = None, fonts: int = 1, chars: int = 1, seed: int = 0,
) -> DataFrame:
    """(idx, name, negative, height, width, data, boxes) for ``amount`` pages, fewer if the cap of attempts is reached.

    ``images`` are decoded rows (path, height, width, data) in RGB or files that ``sources.Scans``
    names; pages smaller than a crop are passed over, and none left is an error. ``shapes``
    are glyphs (``typefaces.outlines``), by default squares; ``characters`` (codepoint)
    those to draw from, by default all that every font has. Waves are checkpointed: set spark.checkpoint.dir.
    """
    s = settings or Settings()
    source = sources.Decoded(images) if isinstance(images, DataFrame) else images
    spark = source.spark
    shapes = glyphs.squares(spark, fonts, chars) if shapes is None else shapes
    characters = charset.common(shapes.select("font", "codepoint")) if characters is None else characters
    made: list[DataFrame] = []
    done = good = 0
    if amount > 0:
        large = source.sizes().filter((F.col("width") >= s.crop_size) & (F.col("height") >= s.crop_size))
        population = numbering.Population.of(large.select(F.xxhash64("path").alias("_key"), "path", "height", "width"), "_key")
        letters = letters_of(shapes, characters.select("codepoint").distinct())
    while good < amount and done < amount * numbering.TRIES_PER_PAGE:
        wave = min(max(8, int(1.3 * (amount - good))), amount * numbering.TRIES_PER_PAGE - done)
        numbers = spark.range(done + 1, done + wave + 1).select(F.col("id").alias("attempt"))
        attempts = attempts_of(numbers, population, s, seed).checkpoint(eager=True)
        blocks = blocks_of(attempts, shapes, s, seed).checkpoint(eager=True)
        cells = cells_of(blocks, letters, seed).checkpoint(eager=True)
        pages = painted(crops_of(attempts, source, wave, s.crop_size), blocks, cells, shapes, s)
        pages = pages.filter(F.col("negative") | (F.size("placed") > 0)).checkpoint(eager=True)
        plan = raster.degradation_plan(pages, "attempt", s, seed)
        steps = ("angle", "sigma", "kernel", "rounds", "grow", "std")
        plan = plan.withColumns({c: F.when(~F.col("negative"), F.col(c)) for c in steps}).withColumn("channels", F.lit(3))
        good, done = good + pages.count(), done + wave
        made.append(plan.join(boxed(plan, cells, s), "attempt", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(BOXES))))
    if not made:
        return spark.createDataFrame([], f"idx long, name string, negative boolean, height int, width int, data binary, boxes {BOXES}")
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    kept = numbering.successes(every.withColumn("ok", F.lit(True)).drop("placed"), F.lit(amount), start)
    return raster.degrade(kept).select("idx", page_name(F.col("idx")).alias("name"), "negative", "height", "width", "data", "boxes")


def with_label_text(pages: DataFrame, side: float) -> DataFrame:
    """``pages`` with ``text``, the content of the label file, empty for pages without boxes."""
    rows = pages.select(F.col("name").alias("page"), F.posexplode("boxes").alias("box_no", "box")).withColumn("block_no", F.lit(0))
    texts = labels.page_texts(pages.select(F.col("name").alias("page")), labels.lines_of(rows, side).select("page", "block_no", "box_no", "line"))
    return pages.join(texts.select(F.col("page").alias("name"), "text"), "name")


def dataset(images: DataFrame | sources.Scans, settings: Settings | None = None, seed: int = 0, **more) -> DataFrame:
    """Training pages and validation pages, whose numbers begin where the training's would end."""
    s = settings or Settings()
    n_val = max(1, int(s.pages_amount * s.val_ratio))
    n_train = s.pages_amount - n_val
    train = synthesise(images, n_train, 0, s, seed=seed, **more).withColumn("split", F.lit("train"))
    val = synthesise(images, n_val, n_train, s, seed=seed + 1, **more).withColumn("split", F.lit("val"))
    return train.unionByName(val)


def overlays(pages: DataFrame, parsed: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """(sample_no, name, height, width, data): up to ``n`` pages with the boxes of their labels drawn, pages without labels as they are."""
    chosen = numbering.sample(pages.select("name", "height", "width", "data"), n, seed, "name")
    lists = parsed.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("line_no", "cx", "cy", "w", "h"))).alias("labels"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            drawn = []
            for r in frame.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                for x in r.labels if r.labels is not None else ():
                    cx, cy, w, h = x["cx"] * r.width, x["cy"] * r.height, x["w"] * r.width, x["h"] * r.height
                    image = raster.outline(image, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)
                drawn.append(image.tobytes())
            frame["data"] = drawn
            yield frame.drop(columns=["labels"])

    joined = chosen.join(lists, "name", "left").select("sample_no", "name", "height", "width", "data", "labels")
    return joined.mapInPandas(run, "sample_no int, name string, height int, width int, data binary")
