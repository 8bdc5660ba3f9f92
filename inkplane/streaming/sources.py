"""Folders that fill up with captured frames or key presses, as streams.

A folder's file names rise with time, so the name of the last file read is the whole
offset: a query that starts again goes on with the next file, and a batch that is
repeated reads the same files. Only names pass through the driver; tasks open the files.
Writers give a file its name when it is complete.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Files of a task.
TOGETHER = 32
#: Bytes of a pixel as screens give them: blue, green, red, alpha.
CHANNELS = 4
FRAME = re.compile(r"(?P<micros>\d{17,})-(?P<session>\d+)-(?P<event>\d+)-(?P<key>.?)\.bgra")


@dataclass
class Files(InputPartition):
    names: list[str]


class FolderReader(DataSourceStreamReader):
    """Files of a folder in order of their names; what a file holds is up to ``rows``."""

    suffix = ""

    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit, self.seen = path, limit, ""

    def names(self) -> list[str]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(path))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        """The last file of the next batch: of ``limit`` files at most, counted from where the batch before ended."""
        new = [n for n in self.names() if n > self.seen]
        self.seen = new[: self.limit][-1] if new else self.seen
        return {"last": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.seen = max(self.seen, end["last"])
        names = [n for n in self.names() if start["last"] < n <= end["last"]]
        return [Files(names[k : k + TOGETHER]) for k in range(0, len(names), TOGETHER)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{path}/{name}") as f:
                yield self.rows(name, f.read())

    def rows(self, name: str, body: bytes) -> pa.RecordBatch:
        raise NotImplementedError


def moment(micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def frame_file(micros: int, session: int, event: int, key: str, frame: np.ndarray) -> tuple[str, bytes]:
    """Name and content of a captured frame (height, width, CHANNELS), with the key that was pressed at it."""
    return f"{micros:020d}-{session}-{event}-{key}.bgra", struct.pack(">II", *frame.shape[:2]) + np.ascontiguousarray(frame, np.uint8).tobytes()


class FrameReader(FolderReader):
    suffix = ".bgra"

    def rows(self, name: str, body: bytes) -> pa.RecordBatch:
        """One frame, its alpha dropped and its colours in RGB order; a damaged file is an error, which ends the query."""
        m = FRAME.fullmatch(name)
        if m is None:
            raise ValueError(f"{name}: no name of a frame")
        h, w = struct.unpack(">II", body[:8]) if len(body) >= 8 else (0, 0)
        if not h * w or len(body) != 8 + h * w * CHANNELS:
            raise ValueError(f"{name}: capture failed")
        pixels = np.frombuffer(body, np.uint8, offset=8).reshape(h, w, CHANNELS)[..., 2::-1]
        values = [int(m["session"]), int(m["event"]), moment(int(m["micros"])), m["key"] or "-", h, w, pixels.tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["session", "event_id", "ts", "key", "height", "width", "data"])


class KeyReader(FolderReader):
    suffix = ".keys"

    def rows(self, name: str, body: bytes) -> pa.RecordBatch:
        """Lines of session, event, microseconds and key, separated by blanks; other lines are an error."""
        rows = [line.split(" ") for line in body.decode().splitlines() if line]
        columns = [pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([moment(int(r[2])) for r in rows], pa.timestamp("us", "UTC")), pa.array([r[3] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["session", "event_id", "ts", "key"])


class ScreenFrames(DataSource):
    """``readStream.format("screen_frames").load(folder)``; option ``files`` for the files of a batch at most (a run with ``availableNow`` is one batch)."""

    reader_class: type[FolderReader] = FrameReader

    @classmethod
    def name(cls) -> str:
        return "screen_frames"

    def schema(self) -> str:
        return "session long, event_id long, ts timestamp, key string, height int, width int, data binary"

    def streamReader(self, schema: StructType) -> FolderReader:
        return self.reader_class(self.options["path"], int(self.options.get("files", 1 << 30)))


class KeyEvents(ScreenFrames):
    """``readStream.format("key_events").load(folder)``, without frames."""

    reader_class = KeyReader

    @classmethod
    def name(cls) -> str:
        return "key_events"

    def schema(self) -> str:
        return "session long, event_id long, ts timestamp, key string"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    for source in (ScreenFrames, KeyEvents):
        spark.dataSource.register(source)
