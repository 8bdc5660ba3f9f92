"""Streams of frames and keys: replay, restart, ends, idle sessions, models loaded once."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkplane.plans import live_queries
from inkplane.streaming import live, sources

MONITOR = live_queries.MONITOR
T0 = 1_700_000_000_000_000


def grab(folder, micros, session, event, key, shape=(4, 6)):
    rng = np.random.default_rng(event)
    name, body = sources.frame_file(T0 + micros, session, event, key, rng.integers(0, 256, (*shape, 4)))
    (folder / "part").write_bytes(body)
    os.replace(folder / "part", folder / name)


def drain(stream, checkpoint, name, options=None):
    query = stream.writeStream.format("parquet").option("path", str(checkpoint.parent / name)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None


def test_frames_are_replayed_exactly_once(spark, tmp_path):
    sources.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(70):
        grab(folder, k * 1000, 1, k, "" if k % 3 else "d")
    stream = lambda: spark.readStream.format("screen_frames").option("files", 50).load(str(folder))
    drain(stream(), tmp_path / "c", "out")
    for k in range(70, 80):
        grab(folder, k * 1000, 2, k, "w", (2, 3))
    drain(stream(), tmp_path / "c", "out")  # the same query, begun again
    drain(stream(), tmp_path / "c", "out")  # nothing new
    rows = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.event_id)
    assert [r.event_id for r in rows] == list(range(80))
    assert {(r.session, r.height, r.width) for r in rows} == {(1, 4, 6), (2, 2, 3)} and rows[3].key == "d" and rows[4].key == "-"
    want = np.random.default_rng(75).integers(0, 256, (2, 3, 4))[..., 2::-1].astype(np.uint8)
    assert bytes(rows[75].data) == want.tobytes()
    micros = spark.read.parquet(str(tmp_path / "out")).select("event_id", F.unix_micros("ts").alias("t")).collect()
    assert all(r.t == T0 + r.event_id * 1000 for r in micros)


def test_a_damaged_frame_ends_the_query(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "in").mkdir()
    grab(tmp_path / "in", 0, 1, 1, "")
    (tmp_path / "in" / f"{T0 + 5:020d}-1-2-.bgra").write_bytes(b"short")
    frames = spark.readStream.format("screen_frames").load(str(tmp_path / "in"))
    query = live.watch(frames, MONITOR, lambda p: p[["event_id"]], "event_id long", lambda df, n: df.collect(), str(tmp_path / "c"))
    with pytest.raises(Exception, match="capture failed"):
        query.awaitTermination(120)
    assert not query.isActive


def test_keys_walk_like_the_batch_query(spark, tmp_path):
    """The whole of the events as key files, in two runs with a restart between, against the batch query."""
    sources.register(spark)
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    (tmp_path / "in").mkdir()
    keys = sorted(live_queries.presses(spark, sf).select("session", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "key").collect(), key=lambda r: (r.t, r.event_id))
    parts = [keys[k : k + 97] for k in range(0, len(keys), 97)]
    half = len(parts) // 2
    for run in (parts[:half], parts[half:]):
        for part in run:
            (tmp_path / "in" / f"{part[0].t:020d}-{part[0].event_id:012d}.keys").write_text("".join(f"{r.session} {r.event_id} {r.t} {r.key}\n" for r in part))
        stream = spark.readStream.format("key_events").load(str(tmp_path / "in"))
        drain(live.sessions(stream, MONITOR), tmp_path / "c", "out")
    walked = spark.read.parquet(str(tmp_path / "out"))
    assert walked.count() == len(keys)
    last = walked.groupBy("session").agg(F.max_by(F.struct("top", "left", "width", "height"), "event_id").alias("r")).select("session", "r.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, live_queries.region_walk(spark, sf).collect()))
    rates = {r.event_id: r.rate for r in walked.collect()}
    assert rates == pytest.approx({r.event_id: r.rate for r in live_queries.frame_rate(spark, sf).collect()})


def test_idle_sessions_lose_their_state(spark, tmp_path):
    sources.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    _, left, _, _ = live.initial(MONITOR)

    def run(*rows):
        for micros, session, event, key in rows:
            grab(folder, micros, session, event, key)
        stream = spark.readStream.format("screen_frames").load(str(folder))
        drain(live.sessions(stream, MONITOR, idle=60_000, delay="1 second"), tmp_path / "c", "out")

    run((0, 1, 1, "d"), (10, 2, 2, "d"))
    run((400_000_000, 2, 3, "d"))  # moves the watermark beyond the idle time of session 1
    run((401_000_000, 2, 4, "d"))
    state = spark.read.format("statestore").option("stateVarName", "region").load(str(tmp_path / "c"))
    assert [r.s for r in state.select("key.session", F.col("key.session").alias("s")).collect()] == [2]
    run((402_000_000, 1, 5, "d"), (403_000_000, 2, 6, "d"))
    got = {r.event_id: r.left for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    step = live.MOVE
    assert got[1] == got[5] == left + step  # session 1 began anew
    assert got[2] == left + step and got[3] in (left + step, left + 2 * step) and got[6] == got[3] + 2 * step


def test_the_query_ends_when_all_have_stopped(spark, tmp_path):
    sources.register(spark)
    folder, got = tmp_path / "in", []
    folder.mkdir()

    def start():
        frames = spark.readStream.format("screen_frames").load(str(folder))
        return live.watch(frames, MONITOR, lambda p: p[["event_id"]], "event_id long", lambda df, n: got.extend(r.event_id for r in df.collect()), str(tmp_path / "c"), processingTime="200 milliseconds")

    grab(folder, 1, 1, 1, "d")
    grab(folder, 2, 2, 2, "q")
    first = start()
    assert not first.awaitTermination(15)  # session 1 goes on
    first.stop()
    grab(folder, 3, 2, 3, "d")  # after its stop
    grab(folder, 4, 1, 4, "q")
    assert start().awaitTermination(120)
    assert sorted(got) == [1, 2, 4]


def test_a_worker_loads_its_model_once(spark, tmp_path):
    (tmp_path / "second.bin").write_bytes(b"7")
    log = str(tmp_path / "log")

    def load(path):
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {os.path.basename(path)}\n")
        with open(path) as f:
            add = int(f.read())
        return lambda frames: pd.DataFrame({"x": frames["id"] + add})

    model = live.Model(load, (str(tmp_path / "first.bin"), str(tmp_path / "second.bin")))
    for _ in range(3):
        found = live.detect(spark.range(0, 1000, 1, 16), model, "x long")
        assert sorted(r.x for r in found.collect()) == list(range(7, 1007))
    lines = open(log).read().split("\n")[:-1]
    assert len(lines) == len(set(lines)) < 48 and all(x.endswith(" second.bin") for x in lines)
    with pytest.raises(Exception, match="none of these exists"):
        live.detect(spark.range(1), live.Model(load, (str(tmp_path / "x"),)), "x long").collect()
