"""Characters and outlines of font files, and their rasters against sampled brute force."""

import numpy as np
import pytest
from fontfile import collection, composite, font, outline
from pyspark.sql import functions as F

from inkplane.operators import glyphs
from inkplane.sources import fonts, typefaces

SQUARE = [(100, 0, True), (100, 800, True), (900, 800, True), (900, 0, True)]
HOLE = [(300, 200, True), (700, 200, True), (700, 600, True), (300, 600, True)]
DISC = [(500, 0, False), (0, 0, False), (0, 1000, False), (500, 1000, False), (1000, 1000, False), (1000, 0, False)]
ARCH = [(0, 0, True), (0, 900, False), (500, 900, True), (1000, 900, False), (1000, 0, True)]


def read(spark, *named):
    return spark.createDataFrame([(f"file:/x/{n}.ttf", bytearray(b)) for n, b in named], "path string, content binary")


@pytest.mark.parametrize("fmt, pairs", [(0, {65: 1, 97: 2, 250: 3}), (4, {65: 1, 0x3042: 9, 0x4E00: 4, 0x4E01: 5, 0xFFEE: 7}), (6, {0x3041: 1, 0x3043: 2}), (10, {0x1F600: 1, 0x1F602: 3}), (12, {65: 1, 0x20000: 2}), (13, {66: 5, 0x10FFFF: 5})])
def test_formats_of_unicode_maps(spark, fmt, pairs):
    got = fonts.glyphs(read(spark, ("a", font([(3, 10, fmt, pairs)])))).collect()
    assert sorted(map(tuple, got)) == [("a", c) for c in sorted(pairs)]


def test_high_byte_map_in_an_older_code(spark):
    text = "A一丁あ"
    pairs = {int.from_bytes(c.encode("cp932"), "big"): k + 1 for k, c in enumerate(text)}
    data = font([(3, 2, 2, pairs)])
    assert typefaces.character_map(data, typefaces.faces(data)[0]) == {ord(c): k + 1 for k, c in enumerate(text)}


def test_the_best_map_wins(spark):
    data = font([(1, 0, 0, {65: 1}), (3, 1, 4, {66: 2}), (3, 10, 12, {67: 3, 68: 0}), (3, 10, 12, {69: 3})])
    assert typefaces.character_map(data, typefaces.faces(data)[0]) == {67: 3}
    data = font([(1, 0, 0, {0x8E: 1}), (3, 2, 2, {65: 4})])
    assert typefaces.character_map(data, typefaces.faces(data)[0]) == {65: 4}
    data = font([(1, 0, 0, {0x8E: 1})])
    assert typefaces.character_map(data, typefaces.faces(data)[0]) == {ord("é"): 1}


def test_collections_and_odd_files(spark):
    both = collection([[(3, 10, 12, {65: 1})]], [[(3, 1, 4, {66: 1})]])
    odd = b"\x00\x01\x00\x00" + b"\x00" * 8
    rows = fonts.glyphs(read(spark, ("both", both), ("none", odd), ("one", font([(3, 10, 12, {0x4E00: 1})]))))
    assert sorted(map(tuple, rows.collect())) == [("both", 65), ("both", 66), ("one", 0x4E00)]
    assert "LateralJoin" in rows._jdf.queryExecution().analyzed().toString()


def shapes(spark):
    drawn = [outline([SQUARE]), outline([]), outline([SQUARE, HOLE]), outline([DISC]), composite([(0, 0, 0, None), (3, 50, 100, 0.5)]), outline([ARCH])]
    file = font([(3, 10, 12, {32: 1, 0x5B57: 2, 0x4E00: 3, 0x4E01: 4, 0x4E02: 5})], drawn)
    wanted = spark.createDataFrame([(c,) for c in (32, 0x5B57, 0x4E00, 0x4E01, 0x4E02, 0x9999)], "codepoint int")
    return typefaces.outlines(fonts.named(read(spark, ("f", file))), wanted)


def test_outlines(spark):
    got = {r.codepoint: r for r in shapes(spark).collect()}
    lines = lambda c: [[(p.x, p.y) for p in line] for line in got[c].contours]
    assert lines(32) == [] and lines(0x9999) == [[p[:2] for p in SQUARE]]  # no sign of its own
    assert lines(0x5B57) == [[p[:2] for p in SQUARE], [p[:2] for p in HOLE]]
    (disc,) = lines(0x4E00)
    assert min(np.hypot(x - 500, y - 500) for x, y in disc) > 450 and max(x for x, _ in disc) <= 1000
    assert len(lines(0x4E01)) == 2 and min(x for x, _ in lines(0x4E01)[1]) >= 50
    assert all(r.units == 1000 and r.ascent == 880 and r.advance == 1000 for r in got.values())


def sampled(lines, height, width, n=24):
    """Coverage by the winding numbers of many points of each pixel."""
    y, x = (np.mgrid[0 : height * n, 0 : width * n] + 0.5) / n
    winding = np.zeros(y.shape)
    for line in lines:
        for (x0, y0), (x1, y1) in zip(line, line[1:] + line[:1], strict=True):
            if y0 != y1:
                crosses = (np.minimum(y0, y1) <= y) & (y < np.maximum(y0, y1)) & (x0 + (y - y0) * (x1 - x0) / (y1 - y0) < x)
                winding += np.where(crosses, np.sign(y1 - y0), 0)
    return (winding != 0).reshape(height, n, width, n).mean(axis=(1, 3))


@pytest.mark.parametrize("size", [7, 24, 48])
def test_rasters(spark, size):
    made = shapes(spark)
    wanted = made.select("font", "codepoint", F.lit(size).alias("size"))
    outlines = {r.codepoint: r.contours for r in made.collect()}
    for r in glyphs.rasters(made, wanted).collect():
        if r.codepoint == 32:
            assert (r.width, r.height, r.fill) == (0, 0, b"")
            continue
        shape = (r.height + 4, r.width + 4)
        fill, stroke = (np.frombuffer(x, np.uint8).reshape(shape) / 255 for x in (r.fill, r.stroke))
        up = np.ceil(0.88 * size)
        lines = [[(p.x * size / 1000 - r.left + 2, up - p.y * size / 1000 - r.top + 2) for p in line] for line in outlines[r.codepoint]]
        if r.codepoint != 0x4E01:  # overlapping parts count once at most, which only full pixels tell
            assert np.abs(fill - sampled(lines, *shape)).max() < 0.03
        assert (stroke >= fill).all() and fill[:2].max() == fill[-2:].max() == fill[:, :2].max() == 0
        y, x = np.nonzero(stroke > 0)
        inside = np.argwhere(fill > 0)
        assert all(np.hypot(*(inside - (a, b)).T).min() < 4 for a, b in zip(y, x, strict=True))
        assert stroke.sum() > fill.sum()


def test_cells(spark):
    made = shapes(spark)
    got = glyphs.cell_sizes(made, F.array(F.lit(25), F.lit(50)))
    assert sorted(map(tuple, got.collect())) == [("f", 25, 21, 20), ("f", 50, 40, 40)]
    blank = glyphs.cell_sizes(made.filter("codepoint = 32"), F.array(F.lit(25)))
    assert [tuple(r) for r in blank.collect()] == [("f", 25, 25, 25)]


def test_stamp():
    image = np.full((6, 6, 3), 100, np.uint8)
    cover = np.array([[255, 0], [51, 255]], np.uint8)
    glyphs.stamp(image, 4, 4, cover, 200)
    glyphs.stamp(image, -1, 5, cover, 0)
    glyphs.stamp(image, 9, 9, cover, 0)
    assert image[4, 4, 0] == 200 and image[4, 5, 0] == 100 and image[5, 4, 0] == 120 and image[5, 5, 0] == 200 and image[5, 0, 0] == 100
