"""Exact vectors of boxes, labels, settings, regions, characters and numbers."""

import bisect

import pytest
from pyspark.sql import functions as F

from inkplane import params
from inkplane.functions import boxes, regions, text
from inkplane.operators import charset, labels, layout, numbering

BOX = "x double, y double, w double, h double"


def made(spark, rows, f):
    df = spark.createDataFrame(rows, BOX).select(f(boxes.box(*[F.col(c) for c in "xywh"])).alias("b")).select("b.*")
    return [tuple(r) for r in df.collect()]


def test_expand(spark):
    rows = [(10, 10, 40, 40), (2, 2, 40, 40), (620, 0, 20, 20), (700, 0, 20, 20)]
    want = [(6, 6, 48, 48), (0, 0, 48, 48), (618, 0, 22, 24), (698, 0, -58, 24)]
    assert made(spark, [tuple(map(float, r)) for r in rows], lambda b: boxes.expand(b, 640, 0.1)) == want


def test_clamp_and_area(spark):
    rows = [(-10, 5, 30, 30), (630, 630, 40, 40), (650, 0, 10, 10), (-30, 0, 10, 10), (10, 10, 0, 5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], BOX).select(boxes.clamp(boxes.box(*[F.col(c) for c in "xywh"]), 640, 640).alias("b"))
    assert [tuple(r) for r in df.filter(boxes.has_area(F.col("b"))).select("b.*").collect()] == [(0, 5, 20, 30), (630, 630, 10, 10), (639, 0, 1, 10)]


def test_null_box_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, 3.0)], BOX).select(boxes.normalise(boxes.clamp(boxes.expand(boxes.box(*[F.col(c) for c in "xywh"]), 640, 0.1), 640, 640), 640).alias("n"))
    assert df.first().n is None


def test_label_text(spark):
    rows = [(0, 0, 640, 640), (10, 20, 30, 40), (3, 5, 7, 9), (-50, 0, 20, 10), (630, 630, 40, 40)]
    df = spark.createDataFrame([(i, 0, 0, dict(zip("xywh", map(float, r), strict=True))) for i, r in enumerate(rows)], f"page int, block_no int, box_no int, box struct<{BOX.replace(' double', ': double')}>")
    assert [r.line for r in labels.lines_of(df, 640).orderBy("page").collect()] == [
        "0 0.500000 0.500000 1.000000 1.000000",
        "0 0.039062 0.062500 0.046875 0.062500",
        "0 0.010156 0.014844 0.010937 0.014063",
        "0 0.000000 0.007812 0.031250 0.015625",
        "0 1.000000 1.000000 0.062500 0.062500",
    ]


def test_label_parse(spark):
    lines = ["0 0.5 0.5 0.25 0.5", "0 0.5 0.5 0.25", "0 1 2 3 4 5", "", " \t0\t0.5  0.5 0.25 0.5\n"]
    got = labels.to_corners(labels.parse(spark.createDataFrame([("a", i, v) for i, v in enumerate(lines)], "name string, line_no int, value string")), 640, 640)
    assert [tuple(r)[1:] for r in got.orderBy("line_no").collect()] == [(0, 240, 160, 400, 480), (4, 240, 160, 400, 480)]
    bad = spark.createDataFrame([("a", 0, "0 a 0.5 0.5 0.5")], "name string, line_no int, value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labels.parse(bad).collect()


def test_page_texts_keep_empty_pages(spark):
    lines = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a")], "page int, block_no int, box_no int, line string")
    got = labels.page_texts(spark.createDataFrame([(1,), (2,)], "page int"), lines)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "a\nb\n"), (2, 0, "")]


def test_levels(spark):
    d = spark.createDataFrame([("一", 5), ("丁", 1), ("丂", None), ("七", None)], "kanji string, jlpt_new int")
    of = lambda level: sorted(r.kanji for r in charset.of_level(d, level).collect())
    assert (of("n5"), of("n1"), of("n2"), of("zz"), len(of(""))) == (["一"], ["丁"], [], sorted("丂七"), 4)


def test_intersection_and_coverage(spark):
    fonts = {"A": [0x41, 0x4E00, 0x3042], "B": [0x4E00, 0x3042, 0x30A2], "C": [0x4E00, 0x3042, 0x41, 0x41]}
    rows = spark.createDataFrame([(f, c) for f, cs in fonts.items() for c in cs], "font string, codepoint int")
    assert sorted(r.codepoint for r in charset.common(rows).collect()) == [0x3042, 0x4E00]
    assert {r.ch for r in charset.supported(rows).collect()} == {"一", "あ"}
    assert charset.common(rows, spark.createDataFrame([("A",), ("Z",)], "font string")).count() == 0
    with pytest.raises(ValueError, match="no fonts"):
        charset.common(rows.limit(0)).collect()
    wanted = spark.createDataFrame([(ord(c), c, i) for i, c in enumerate("一丁七")], "codepoint int, ch string, pos int")
    have = spark.createDataFrame([("A", ord("一")), *[("B", ord(c)) for c in "一丁七"]], "font string, codepoint int")
    got = charset.coverage(have.select("font").distinct(), wanted, have)
    assert sorted(map(tuple, got.collect())) == [("A", 2, "丁七"), ("B", 0, "")]


def test_script_ranges(spark):
    points = {0x3005: 0, 0x3040: 0, 0x3041: 1, 0x3096: 1, 0x3097: 0, 0x30A0: 0, 0x30A1: 1, 0x30F6: 1, 0x30F7: 0, 0x30FC: 0, 0x4DFF: 0, 0x4E00: 1, 0x9FFF: 1, 0xA000: 0}
    df = spark.createDataFrame([(c,) for c in points], "c int").select("c", text.is_japanese(F.col("c")).alias("j"), text.char(F.col("c")).alias("s"))
    assert all(r.j == bool(points[r.c]) and ord(r.s) == r.c for r in df.collect())


def test_names_and_sizes(spark):
    df = spark.createDataFrame([(42,), (1234567,), (-1,)], "i long")
    assert [r[0] for r in df.select(text.page_name(F.col("i"))).collect()] == ["page_000042", "page_1234567", "page_-00001"]
    for n, ratio, want in ((20, 0.15, (17, 3)), (5000, 0.15, (4250, 750)), (0, 0.15, (-1, 1)), (1, 0.15, (0, 1)), (100, 0.29, (72, 28))):
        assert tuple(spark.range(1).select(numbering.split_sizes(F.lit(n), ratio).alias("s")).first().s) == want
    size = lambda d: tuple(spark.range(1).select(layout.block_size(F.lit(d), *[F.lit(v) for v in (3, 8, 30, 32, 4, 8)]).alias("s")).first().s)
    assert size("vertical") == (114, 288) and size("horizontal") == (272, 120)


def test_successes(spark):
    rows = spark.createDataFrame([(i + 1, ok) for i, ok in enumerate([False, True, True, False, True, True])], "attempt long, ok boolean")
    assert sorted((r.attempt, r.idx) for r in numbering.successes(rows, F.lit(3), 10).collect()) == [(2, 10), (3, 11), (5, 12)]
    none = spark.createDataFrame([(i, False) for i in range(1, 21)], "attempt long, ok boolean")
    assert numbering.successes(none, F.lit(1)).count() == 0 and numbering.successes(rows, F.lit(0)).count() == 0


def test_dense_over_chunks(spark):
    df = spark.range(0, 1000, 7)
    got = sorted((r.idx, r.id) for r in numbering.dense(df, "id", chunk=50).collect())
    assert got == list(enumerate(range(0, 1000, 7)))


WALK = [
    ((0, 0, 2560, 1440), (180, 320, 1920, 1080), "wrrdfsa", [(160, 320, 1920, 1080), (135, 295, 1970, 1130), (110, 270, 2020, 1180), (110, 290, 2020, 1180), (135, 315, 1970, 1130), (155, 315, 1970, 1130), (155, 295, 1970, 1130)]),
    ((0, 0, 1366, 768), (0, 0, 1366, 768), "wrrdfsa", [(0, 0, 1366, 768)] * 4 + [(25, 25, 1316, 718), (45, 25, 1316, 718), (45, 5, 1316, 718)]),
    ((-1920, 100, 1921, 1081), (100, -1920, 1920, 1080), "wrrdfsa", [(100, -1920, 1920, 1080)] + [(100, -1920, 1921, 1081)] * 3 + [(125, -1895, 1871, 1031), (145, -1895, 1871, 1031), (145, -1915, 1871, 1031)]),
]


@pytest.mark.parametrize("monitor,start,keys,want", WALK)
def test_region_walk(spark, monitor, start, keys, want):
    from inkplane.streaming import live

    m = dict(zip(("left", "top", "width", "height"), monitor, strict=True))
    column = F.struct(*[F.lit(v).alias(k) for k, v in m.items()])
    r = regions.initial(column)
    assert tuple(spark.range(1).select(r.alias("r")).first().r) == start == live.initial(m)
    plain = start
    for key, expected in zip(keys, want, strict=True):
        now = regions.region(*[F.lit(v) for v in plain])
        assert tuple(spark.range(1).select(regions.press(now, F.lit(key), column).alias("r")).first().r) == expected
        plain = live.press(plain, key, m)
        assert plain == expected


def test_settings():
    assert params.load({}) == params.Settings() and len(params.ENVIRONMENT) == 36
    changed = params.load({"KD_VAL_RATIO": "0.3", "KD_CROP_SIZE": "320", "KD_YOLO_MODEL": "", "OTHER": "1"})
    assert (changed.val_ratio, changed.crop_size, changed.model_file) == (0.3, 320, "")
    assert params.load(params.overrides(changed)) == changed
    with pytest.raises(ValueError):
        params.load({"KD_BATCH": "many"})
    assert [params.parse(v, True) for v in ("1", "TRUE", "yes", "0", "on")] == [True, True, True, False, False]


def test_hosted(tmp_path):
    assert params.hosted(str(tmp_path), ()) and params.hosted("/not/there", ("A", "B"), {"B": ""}) and not params.hosted("/not/there", ("A",), {})


@pytest.mark.parametrize("far", [[], [10**12], [10**12, 1 << 62], [-(1 << 62), *(3**k for k in range(10, 39))]])
def test_numbers_without_gaps_wherever_the_keys_lie(spark, far):
    keys = [*range(5000, 9000), *far]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, idx string").drop("idx")
    got = {r.k: r.idx for r in numbering.dense(df, "k", 7, chunk=100).collect()}
    assert got == {k: i + 7 for i, k in enumerate(sorted(keys))}
    cuts = numbering.quantiles(df, "k", 40)
    sizes = df.groupBy(numbering.part_of(F.col("k"), cuts)).count().collect()
    assert len(sizes) >= 38 and max(r["count"] for r in sizes) <= 2 * len(keys) / 40


def test_parts_by_a_tree(spark):
    cuts = sorted({k * k for k in range(-30, 400)})
    values = [*range(-5, 2000, 7), 10**9, -(10**9)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", numbering.part_of(F.col("v"), cuts).alias("p")).collect()
    assert all(r.p == bisect.bisect_right(cuts, r.v) for r in got)
    assert numbering.quantiles(spark.range(0), "id", 8) == [] and numbering.dense(spark.range(0), "id").count() == 0
