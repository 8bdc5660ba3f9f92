"""Live sessions: the region that keys move, the frame rate, and detections, as streams.

State is kept by session: the region and the time of the last frame. Frames of a
micro-batch are put in order of (ts, event_id) first. The stop key ends a session's
output; later frames of it give no rows. ``sources`` has streams of captured frames and keys.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from inkplane.functions.regions import GROW, LEAST, MOVE, SHIFT
from inkplane.sources.pages import first_existing

STOP, TAP = "q", "h"
#: What keys add to (top, left, width, height).
STEPS = {
    "w": (-MOVE, 0, 0, 0),
    "s": (MOVE, 0, 0, 0),
    "a": (0, -MOVE, 0, 0),
    "d": (0, MOVE, 0, 0),
    "r": (-SHIFT, -SHIFT, GROW, GROW),
    "f": (SHIFT, SHIFT, -GROW, -GROW),
}

OUT = "session long, event_id long, key string, top int, left int, width int, height int, rate double, tapped boolean"
STATE = "top int, left int, width int, height int, last double, stopped boolean"


def clip(region: tuple[int, int, int, int], monitor: dict) -> tuple[int, int, int, int]:
    top, left, width, height = region
    width, height = max(LEAST, min(width, monitor["width"])), max(LEAST, min(height, monitor["height"]))
    left = max(monitor["left"], min(left, monitor["left"] + monitor["width"] - width))
    top = max(monitor["top"], min(top, monitor["top"] + monitor["height"] - height))
    return top, left, width, height


def initial(monitor: dict) -> tuple[int, int, int, int]:
    w, h = min(1920, monitor["width"]), min(1080, monitor["height"])
    return clip((monitor["top"] + (monitor["height"] - h) // 2, monitor["left"] + (monitor["width"] - w) // 2, w, h), monitor)


def press(region: tuple[int, int, int, int], key: str, monitor: dict) -> tuple[int, int, int, int]:
    step = STEPS.get(key)
    return clip(tuple(a + b for a, b in zip(region, step, strict=True)), monitor) if step else region


class Walk(StatefulProcessor):
    """The region of one session: a typed value of state, dropped by a timer when no frame came for ``idle`` milliseconds of event time."""

    def __init__(self, monitor: dict, idle: int | None) -> None:
        self.monitor, self.idle = monitor, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.region = handle, handle.getValueState("region", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        *region, last, stopped = self.region.get() if self.region.exists() else (*initial(self.monitor), None, False)
        region, out = tuple(int(v) for v in region), []
        batch = pd.concat([part[["ts", "event_id", "key"]] for part in rows]).sort_values(["ts", "event_id"])  # keys only, no frames
        for ts, event, pressed in zip(batch["ts"], batch["event_id"], batch["key"], strict=True):
            if stopped:
                break
            now = pd.Timestamp(ts).value / 1000
            rate = 1e6 / (now - last) if last is not None and now > last else 0.0
            last, stopped = now, pressed == STOP
            region = press(region, pressed, self.monitor)
            out.append((key[0], event, pressed, *region, rate, pressed == TAP))
        self.region.update((*region, last, stopped))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(batch["ts"].max()).value // 1_000_000) + self.idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.region.clear()
        return iter(())

    def close(self) -> None:
        pass


def sessions(frames: DataFrame, monitor: dict, idle: int | None = None, delay: str = "10 seconds") -> DataFrame:
    """A row for each frame of a stream (session, event_id, ts, key): region after the key, frames per second, whether the region was asked for.

    With ``idle`` (milliseconds of event time) a session's state goes when it has sent
    nothing for so long, and begins anew afterwards; frames that come more than ``delay``
    behind the latest are dropped then. State lies in RocksDB, which this sets for the session.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = frames.select("session", "event_id", "ts", "key")
    if idle is not None:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("session").transformWithStateInPandas(Walk(monitor, idle), OUT, "append", "None" if idle is None else "EventTime")


Detector = Callable[[pd.DataFrame], pd.DataFrame]
_loaded: dict[tuple, Detector] = {}


@dataclass(frozen=True)
class Model:
    """A detector that every Python worker loads when it first needs it, and keeps: ``load`` of the first of ``paths`` that exists."""

    load: Callable[[str], Detector]
    paths: tuple[str, ...]

    def __call__(self, frames: pd.DataFrame) -> pd.DataFrame:
        if self.paths not in _loaded:
            _loaded[self.paths] = self.load(first_existing(*self.paths))
        return _loaded[self.paths](frames)


def detect(frames: DataFrame, detector: Detector, schema: str) -> DataFrame:
    """Rows that a detector (a ``Model``, or any function) makes of frames, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield detector(part)

    return frames.mapInPandas(run, schema)


def taps(walked: DataFrame) -> DataFrame:
    """The frames at which the region was asked for, with the region."""
    return walked.filter("tapped").select("session", "event_id", "top", "left", "width", "height")


class OpenSessions:
    """Sessions that have sent frames and no stop key yet, kept beside a query's checkpoint."""

    def __init__(self, checkpoint: str) -> None:
        self.system, path = fs.FileSystem.from_uri(checkpoint)
        self.file = f"{path}/open-sessions.json"
        self.ids: set[int] = set()
        self.any = False
        if self.system.get_file_info(self.file).type == fs.FileType.File:
            with self.system.open_input_stream(self.file) as f:
                self.ids, self.any = set(json.loads(f.read())), True

    def update(self, walked: DataFrame) -> bool:
        """Takes a batch in; True once all sessions have stopped."""
        for r in walked.groupBy("session").agg(F.max(F.col("key") == STOP).alias("stopped")).collect():  # sessions of one batch
            self.any = True
            (self.ids.discard if r.stopped else self.ids.add)(r.session)
        self.system.create_dir(self.file.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(self.file + ".part") as f:
            f.write(json.dumps(sorted(self.ids)).encode())
        self.system.move(self.file + ".part", self.file)
        return self.any and not self.ids


def watch(frames: DataFrame, monitor: dict, detector: Detector, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, idle: int | None = None, **trigger) -> StreamingQuery:
    """The whole loop: frames and keys of a stream move the regions, the detector looks at each frame's region, the sink gets what it finds, batch by batch.

    Rows of the detector are made from those of ``sessions``. After the stop key a session's
    frames reach neither; once every session has stopped, the query ends. A source that fails ends it with its error.
    """
    seen, over = OpenSessions(checkpoint), threading.Event()

    def batch(walked: DataFrame, number: int) -> None:
        walked = walked.persist()
        try:
            sink(detect(walked, detector, schema), number)
            if seen.update(walked):
                over.set()
        finally:
            walked.unpersist()

    writer = sessions(frames, monitor, idle).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(**trigger) if trigger else writer).start()

    def end() -> None:
        while query.isActive and not over.wait(0.2):
            pass
        if query.isActive:
            query.stop()

    threading.Thread(target=end, daemon=True).start()
    return query


def caption(rate: str = "rate") -> Column:
    return F.format_string("FPS: %.1f", F.col(rate))
