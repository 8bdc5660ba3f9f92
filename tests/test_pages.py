"""Sources, sinks, rasters, synthesis and streams, on files made here."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplane.operators import labels, raster
from inkplane.params import Settings
from inkplane.plans import live_queries, synthesis
from inkplane.sources import dictionary, fonts, pages
from inkplane.streaming import live

SMALL = Settings(crop_size=96, pages_amount=6, blocks_min=1, blocks_max=2, columns_min=1, columns_max=1, chars_min=1, chars_max=2, region_deviation_limit=200)


def ground(spark, n=3, side=120):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", side, side + i, 3, bytearray(np.clip(rng.normal(200, 5, (side, side + i, 3)), 0, 255).astype(np.uint8).tobytes())) for i in range(n)]
    rows.append(("small", 50, 300, 3, bytearray(50 * 300 * 3)))
    return spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")


def test_dictionary(spark, tmp_path):
    path, asked = str(tmp_path / "a" / "kanji.json"), []
    body = {"一": {"jlpt_new": 5, "strokes": 1}, "丁": {"jlpt_new": 1}, "丂": {"jlpt_new": None}, "七": {}}

    def fetcher(url):
        asked.append(url)
        return json.dumps(body).encode()

    for _ in range(2):
        assert dictionary.ensure(path, "http://x", fetcher) == path
    assert asked == ["http://x"]
    assert sorted(r.kanji for r in dictionary.kanji(spark, path, "other").collect()) == sorted("丂七")
    assert [r.kanji for r in dictionary.kanji(spark, path, "n5").collect()] == ["一"]


def font_file(points):
    """A file with nothing but a character map of format 12."""
    groups = b"".join(struct.pack(">III", p, p, i + 1) for i, p in enumerate(sorted(points)))
    table = struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(points)) + groups
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + table
    return b"\x00\x01\x00\x00" + struct.pack(">HHHH", 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


def test_fonts(spark, tmp_path):
    folder = str(tmp_path / "fonts")
    (tmp_path / "fonts").mkdir()
    (tmp_path / "fonts" / "old.ttf").write_bytes(font_file({0x41}))
    listed = fonts.catalogue(spark, {"old": "u1", "new": "u2", "gone": "u3"})

    def fetcher(url):
        if url == "u3":
            raise OSError("not there")
        return b"\x00\x01\x00\x00" + b"\x00" * 8

    status = {r.font: r.status for r in fonts.download(listed, folder, fetcher).collect()}
    assert status == {"old": "skipped", "new": "downloaded", "gone": "error"}
    (tmp_path / "fonts" / "new.ttf").write_bytes(font_file({0x3042, 0x4E00, 0x1F600}))
    got = sorted(map(tuple, fonts.glyphs(fonts.files(spark, folder)).collect()))
    assert got == [("new", 0x3042), ("new", 0x4E00), ("new", 0x1F600), ("old", 0x41)]


def test_dataset_round_trip(spark, tmp_path):
    made = synthesis.dataset(ground(spark), SMALL, seed=3, fonts=2, chars=50)
    rows = synthesis.with_label_text(made, SMALL.crop_size).cache()
    found = sorted((r.split, r.idx, r.negative, len(r.boxes), r.text) for r in rows.collect())
    assert [f[:2] for f in found] == [("train", i) for i in range(5)] + [("val", 5)]
    for _, _, negative, n, text in found:
        assert len(text.splitlines()) == n and (not negative or n == 0)
        assert all(0 <= float(v) <= 1 for line in text.splitlines() for v in line.split()[1:]) and all(line.startswith("0 ") for line in text.splitlines())
    root = str(tmp_path / "data")
    counts = sorted(map(tuple, pages.write_dataset(rows, root).collect()))
    assert counts == [("train", "images", 5), ("train", "labels", 5), ("val", "images", 1), ("val", "labels", 1)]
    assert sorted(map(tuple, labels.inventory(pages.split_files(spark, root)).collect())) == counts
    back = pages.images(spark, f"{root}/images/train").select(F.regexp_extract("path", r"(page_\d+)", 1).alias("name"), "data")
    same = rows.select("name", F.col("data").alias("first")).join(back, "name")
    assert same.count() == 5 and same.filter("data <> first").count() == 0
    parsed = labels.parse(pages.label_lines(spark, f"{root}/labels/train"))
    assert parsed.count() == sum(f[3] for f in found if f[0] == "train")
    drawn = synthesis.overlays(rows.filter("split = 'train'"), parsed, n=3)
    assert pages.write_samples(drawn, root) == ["amostra_1.png", "amostra_2.png", "amostra_3.png"]
    assert pages.write_samples(drawn.filter("sample_no < 3"), root) == sorted(f.name for f in (tmp_path / "data" / "samples").iterdir()) == ["amostra_1.png", "amostra_2.png"]
    assert pages.write_samples(drawn.filter("sample_no > 3"), root) == []
    shown = pages.images(spark, f"{root}/samples").select(F.regexp_extract("path", r"_(\d)\.png", 1).cast("int").alias("sample_no"), "data")
    assert shown.join(drawn.select("sample_no", F.col("data").alias("first")), "sample_no").filter("data = first").count() == 2
    assert pages.manifest(root, str(tmp_path / "m" / "d.yaml"))["names"] == {0: "kanji"}
    assert pages.scan(spark, f"{root}/images/train", "*.png").count() == 5
    smaller = sorted(map(tuple, pages.write_dataset(rows.filter("idx < 2"), root).collect()))
    assert smaller == [("train", "images", 2), ("train", "labels", 2)] and pages.split_files(spark, root).count() == 4
    assert pages.read_manifest(str(tmp_path / "m" / "d.yaml"))["val"] == "images/val"
    again = synthesis.with_label_text(synthesis.dataset(ground(spark).repartition(3), SMALL, seed=3, fonts=2, chars=50), SMALL.crop_size)
    assert sorted((r.split, r.idx, r.text) for r in again.collect()) == sorted((f[0], f[1], f[4]) for f in found)


def test_synthesis_limits(spark):
    never = Settings(crop_size=96, region_deviation_limit=-1, negative_probability=0.0)
    assert synthesis.synthesise(ground(spark), 1, settings=never).count() == 0
    assert synthesis.synthesise(ground(spark), 0, settings=SMALL).count() == 0
    with pytest.raises(Exception, match="nothing to draw from"):
        synthesis.synthesise(ground(spark), 1, settings=Settings(crop_size=5000)).count()


def jpeg(width, height, padding=0):
    """The head of a JPEG file, after so many bytes of comments."""
    comments = b"".join(b"\xff\xfe" + struct.pack(">H", min(60000, padding - k) + 2) + b"x" * min(60000, padding - k) for k in range(0, padding, 60000))
    return b"\xff\xd8" + comments + b"\xff\xff\xc4" + struct.pack(">H", 5) + b"abc" + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 9 + b"\xff\xda" + b"\0" * 50


def test_sizes_from_headers(spark, tmp_path):
    files = {"a.jpg": jpeg(1234, 77), "b.jpg": jpeg(5, 6, 200_000), "c.png": pages.png(np.zeros((9, 11, 3), np.uint8)), "d.gif": b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 9}
    files |= {"e.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 21, -22) + b"\0" * 9, "f.txt": b"no image", "g.jpg": b"\xff\xd8\xff\xda" + b"\0" * 30, "h.jpg": b"\xff\xd8"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in pages.sizes(spark, str(tmp_path)).collect()}
    none = (None, None)
    assert got == {"a.jpg": (1234, 77), "b.jpg": (5, 6), "c.png": (11, 9), "d.gif": (3, 4), "e.bmp": (21, 22), "f.txt": none, "g.jpg": none, "h.jpg": none}


def test_only_drawn_pages_are_decoded(spark, tmp_path):
    rng = np.random.default_rng(3)
    for k in range(30):
        (tmp_path / f"p{k:02}.png").write_bytes(pages.png(rng.integers(180, 220, (100 + k, 110, 3)).astype(np.uint8)))
    for k in range(20):  # large by its header, but nothing that can be decoded: it would be missing if it were drawn and decoded
        (tmp_path / f"s{k:02}.jpg").write_bytes(jpeg(50, 50))
    scans = pages.Scans(spark, str(tmp_path))
    made = synthesis.synthesise(scans, 3, settings=SMALL, seed=4)
    rows = sorted(map(tuple, made.select("idx", "name", F.size("boxes")).collect()))
    assert [r[0] for r in rows] == [0, 1, 2]
    drawn = spark.createDataFrame([(f"file:{tmp_path}/p05.png",), (f"file:{tmp_path}/p07.png",)], "path string")
    decoded = scans.decode(drawn)
    assert sorted(r.height for r in decoded.collect()) == [105, 107]
    files = [f.rsplit("/", 1)[1] for f in decoded.inputFiles()]
    assert sorted(files) == ["p05.png", "p07.png"]


def test_a_failed_write_leaves_the_dataset(spark, tmp_path):
    root, image = str(tmp_path / "data"), bytearray(np.zeros((4, 5, 3), np.uint8).tobytes())
    rows = lambda n: spark.createDataFrame([("train" if k % 3 else "val", f"page_{k:06}", 4, 5, image, f"label {k}") for k in range(n)], "split string, name string, height int, width int, data binary, text string").repartition(3)
    listed = lambda: sorted(str(f.relative_to(root)) for f in (tmp_path / "data").rglob("*") if f.is_file())
    assert sorted(map(tuple, pages.write_dataset(rows(9), root).collect())) == [("train", "images", 6), ("train", "labels", 6), ("val", "images", 3), ("val", "labels", 3)]
    before = listed()
    broken = rows(12).withColumn("height", F.when(F.col("name") == "page_000011", 7).otherwise(F.col("height")))
    with pytest.raises(Exception, match="cannot reshape"):
        pages.write_dataset(broken, root)
    assert listed() == before and len(before) == 18
    pages.write_dataset(rows(2), root)
    assert listed() == ["images/train/page_000001.png", "images/val/page_000000.png", "labels/train/page_000001.txt", "labels/val/page_000000.txt"]
    other = str(tmp_path / "other")
    assert pages.write_dataset(rows(2), other, "{split}/{kind}").count() == 4 and (tmp_path / "other" / "train" / "labels" / "page_000001.txt").read_text() == "label 1"
    with pytest.raises(Exception, match="overwrite"):
        rows(2).write.format("page_dataset").option("path", root).mode("append").save()


def test_a_commit_cut_off_is_ended(spark, tmp_path):
    root = tmp_path / "data"
    for split in pages.SPLITS:
        for kind in pages.KINDS:
            (root / ".staged-x" / kind / split).mkdir(parents=True)
            (root / kind / split).mkdir(parents=True)
            (root / kind / split / "old").write_text("old")
            (root / ".staged-x" / kind / split / "new").write_text("new")
    (root / ".staged-x" / pages.READY).write_text("")
    (root / ".staged-x" / "images" / "train" / "new").rename(root / "images" / "train" / "new")
    (root / "images" / "train" / "old").unlink()
    (root / ".staged-x" / "images" / "train").rmdir()  # the first folder had been swapped
    (root / ".staged-y").mkdir()
    pages.DatasetWriter(str(root), pages.LAYOUT).abort([])
    assert {f.name for f in root.rglob("*") if f.is_file()} == {"new"} and not (root / ".staged-x").exists()


def test_sums_equal_direct_statistics():
    rng = np.random.default_rng(8)
    grey = rng.integers(0, 256, (40, 30))
    sums = raster.Sums(grey)
    for _ in range(200):
        x, y = rng.integers(0, 29), rng.integers(0, 39)
        w, h = rng.integers(1, 31 - x), rng.integers(1, 41 - y)
        part = grey[y : y + h, x : x + w]
        assert sums.statistics(x, y, w, h) == pytest.approx((part.std(), part.mean()))


def test_image_root(tmp_path):
    assert pages.image_root(str(tmp_path), "/nowhere") == str(tmp_path)
    (tmp_path / "x" / "Manga109_v1" / "images").mkdir(parents=True)
    assert pages.image_root("/not/there", str(tmp_path)) == str(tmp_path / "x" / "Manga109_v1" / "images")
    assert pages.image_root("/not/there", "/nowhere") == "/not/there"
    assert pages.first_existing("/not/there", str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        pages.first_existing("/not/there")


def test_rasters():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    for size in (2, 3, 4):
        want = np.empty_like(image)
        for y in range(9):
            for x in range(7):
                part = image[max(0, y - size // 2) : y + size - size // 2, max(0, x - size // 2) : x + size - size // 2]
                want[y, x] = part.min(axis=(0, 1))
        assert (raster.morph_image(image, size, 1, False) == want).all()
        assert (255 - raster.morph_image(255 - image, size, 2, True) == raster.morph_image(raster.morph_image(image, size, 1, False), size, 1, False)).all()
    assert (raster.rotate_image(image, 0.0) == image).all()
    flat = np.full((5, 6, 3), 77, np.uint8)
    assert (raster.blur_image(flat, 1.5) == 77).all() and (raster.rotate_image(flat, 3.0) == 77).all()
    assert raster.noise_image(flat, 0.2, 1).std() > 10
    assert raster.drop_alpha(np.zeros((2, 2, 4), np.uint8)).shape == (2, 2, 3)
    assert (raster.outline(flat, 0, 0, 5, 4)[0, 0] == (255, 0, 0)).all()


def test_degrade(spark):
    planned = raster.degradation_plan(ground(spark).filter("path <> 'small'"), "path", SMALL, seed=5)
    out = raster.degrade(planned)
    assert out.count() == 3 and all(len(r.data) == r.height * r.width * 3 for r in out.collect())
    stats = raster.image_statistics(out.select("path", "data")).collect()
    assert all(r.deviation >= 0 and 0 <= r.brightness <= 255 for r in stats)


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    keys = live_queries.presses(spark, sf)
    source = str(tmp_path / "in")
    keys.select("session", "event_id", F.col("ts").cast("timestamp").alias("ts"), "key").repartition(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = live.sessions(stream, live_queries.MONITOR).writeStream.format("memory").queryName("walked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("walked").groupBy("session").agg(F.max_by(F.struct("top", "left", "width", "height"), "event_id").alias("r")).select("session", "r.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, live_queries.region_walk(spark, sf).collect()))
    rates = {(r.event_id): r.rate for r in spark.table("walked").collect()}
    assert rates == pytest.approx({r.event_id: r.rate for r in live_queries.frame_rate(spark, sf).collect()})


def test_the_whole_loop(spark, tmp_path):
    import pandas as pd

    rows = [(1, 1, 10, "d"), (1, 2, 20, "h"), (1, 3, 30, "q"), (1, 4, 40, "d"), (2, 5, 15, "s"), (2, 6, 25, "h")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "session long, event_id long, t long, key string").withColumn("ts", F.timestamp_seconds("t")).drop("t").repartition(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    got = []
    seen = lambda part: pd.DataFrame({"event_id": part["event_id"].tolist(), "left": part["left"].tolist(), "tapped": part["tapped"].tolist()})
    query = live.watch(stream, live_queries.MONITOR, seen, "event_id long, left int, tapped boolean", lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "c"), availableNow=True)
    query.awaitTermination(120)
    _, left, _, _ = live.initial(live_queries.MONITOR)
    assert sorted(got) == [(1, left + live.MOVE, False), (2, left + live.MOVE, True), (3, left + live.MOVE, False), (5, left, False), (6, left, True)]


def test_taps(spark):
    rows = spark.createDataFrame([(1, 2, "h", 1, 2, 3, 4, 0.0, True), (1, 3, "d", 1, 2, 3, 4, 0.0, False)], live.OUT)
    assert [tuple(r) for r in live.taps(rows).collect()] == [(1, 2, 1, 2, 3, 4)]


def test_detector(spark):
    import pandas as pd

    frames = spark.createDataFrame([(1, 10), (2, 20)], "frame long, size int")
    found = live.detect(frames, lambda part: pd.DataFrame({"frame": part["frame"], "x": part["size"] / 2}), "frame long, x double")
    assert sorted(map(tuple, found.collect())) == [(1, 5.0), (2, 10.0)]
