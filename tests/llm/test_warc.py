"""WARC round trips: records against brute force, the same bytes whatever the partitions, lost tasks."""

import base64
import hashlib
from pathlib import Path

from inkplane.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, sha string"


def pages():
    rows = [(i, f"http://a/{i} é\n", "<p>" + "x" * (i % 7) * 50 + "</p>", 1, "q") for i in range(-20, 120)]
    rows += [(500, None, None, 1, "q"), (501, "u", "", 1, "q"), (502, "u", "long " * 300_000, 1, "q"), (503, "u", "ünï\r\n\r\nWARC/1.1\r\n", 1, "q")]
    rows += [(None, "u", "nobody", 1, "q"), (None, "u", "nobody", 1, "q"), (None, "u", "", 1, "q")]
    return rows + [rows[5], (700, "u", "same", 1, "q"), (700, "u", "same", 1, "q"), (700, "v", "other", 1, "q")]


def expected(rows, min_bytes=0):
    best = {}
    count = {}
    for key, _, html, *_ in rows:
        p = (html or "").encode()
        count[p] = count.get(p, 0) + 1
        if key is not None:
            best[p] = max(key, best.get(p, key))
    out, taken = [], set()
    for key, _, html, *_ in rows:
        p = (html or "").encode()
        first = key is None or len(p) < min_bytes or count[p] == 1 or (key == best[p] and p not in taken)
        if first and key is not None:
            taken.add(p)
        out.append((key, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else best[p]))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    for least in (0, 60):
        got = sorted(map(tuple, warc.archived(df, least).collect()), key=str)
        assert got == expected(pages(), least)


def test_same_files_whatever_the_partitions(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    found = []
    for n in (1, 7):
        root = f"file://{tmp_path}/{n}"
        warc.write(df.repartition(n), root, shard_bytes=20_000, roll_bytes=2_000)
        found.append({p.name: p.read_bytes() for p in Path(tmp_path, str(n)).glob("part-*.warc.gz")})
        manifest = spark.read.parquet(f"{root}/_manifest").collect()
        assert {m.file for m in manifest} == set(found[-1]) and not list(Path(tmp_path, str(n)).glob(".*tmp"))
        assert sum(m.records for m in manifest) == len(pages())
        ranges = sorted((m.file, m.first_key, m.last_key) for m in manifest if m.first_key is not None)
        assert all(a[2] <= b[1] for a, b in zip(ranges, ranges[1:]))
    assert found[0] == found[1] and len(found[0]) > 5


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    root = f"file://{tmp_path}/x"
    warc.write(spark.createDataFrame(pages(), SCHEMA), root)
    (tmp_path / "x" / "part-9999999-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, root).count() == len(pages())
    payload = warc.read(spark, root).filter("record_id = '<urn:page:503>'").first().payload
    assert bytes(payload).decode() == "ünï\r\n\r\nWARC/1.1\r\n"


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_far_off_leave_shards_as_they_are(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "x" * 400, 1, "q") for i in range(1, 2001)]
    far = [1 << 62, 10**12, -(1 << 63), (1 << 63) - 1, 10**17, 10**9]
    for n in (0, 1, 2, len(far)):
        root = f"file://{tmp_path}/{n}"
        warc.write(spark.createDataFrame(rows + [(k, "u", "far", 1, "q") for k in far[:n]], SCHEMA), root, shard_bytes=200_000)
        made = spark.read.parquet(f"{root}/_manifest").groupBy("shard").sum("records").collect()
        assert len(made) >= 9 and max(m[1] for m in made) < 400
        assert warc.read(spark, root).count() == 2000 + n
        ranges = sorted((m.file, m.first_key, m.last_key) for m in spark.read.parquet(f"{root}/_manifest").collect())
        assert all(a[2] <= b[1] for a, b in zip(ranges, ranges[1:]))
