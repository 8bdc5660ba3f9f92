"""Page images, label files, manifests: readers and writers.

Spark's file readers pass over names that begin with an underscore or a dot.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SPLITS, KINDS = ("train", "val"), ("images", "labels")
#: Where a dataset keeps the files of a split and kind.
LAYOUT = "{kind}/{split}"
#: Bytes of an image file that are read for its size; more where the size comes later.
HEAD = 1 << 16
#: Paths that one reader takes as a list; beyond that all files are decoded and the others dropped.
LISTED = 20_000


def scan(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, length) of the files below ``root``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select("path", "length")


def images(spark: SparkSession, root: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, height, width, channels, data) in RGB order; Spark decodes to BGR, which is turned round in an Arrow stage."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("dropInvalid", True).load(root)
    rows = rows.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rgb = np.repeat(image, 3, axis=2) if r.channels == 1 else image[..., 2::-1]
                made.append(np.ascontiguousarray(rgb).tobytes())
            frame["data"], frame["channels"] = made, np.int32(3)
            yield frame

    return rows.mapInPandas(turn, rows.schema)


# --- sizes without decoding ---------------------------------------------------------------


def size_in(head: bytes) -> tuple[int, int] | int | None:
    """(width, height) of a JPEG, PNG, GIF or BMP file from its first bytes; the place to read on from, if they end before it; None for other files."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8":
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM":
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        mark = head[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # fill bytes, and marks without a body
            at += 1 if mark == 0xFF else 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame begins
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        elif mark in (0xD9, 0xDA):
            return None
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return at


def _open(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(name)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with _open(path) as f:
                head = f.read(HEAD)
                size = size_in(head)
                while isinstance(size, int):  # a marker further on: read from there, behind the two bytes that a JPEG begins with
                    f.seek(size)
                    more = f.read(HEAD)
                    again = size_in(b"\xff\xd8" + more) if len(more) > 9 else None
                    size = size + again - 2 if isinstance(again, int) else again
            found.append(size or (None, None))
        columns = [pa.array([x[k] for x in found], pa.int32()) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "height", "width"])


def sizes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, height, width) of the image files below ``root``, from their first bytes; null for what is no image."""
    return scan(spark, root, pattern).select("path").mapInArrow(_sizes, "path string, height int, width int")


def plain(path: Column) -> Column:
    """Paths of local files as the file scan names them, however a reader does."""
    return F.regexp_replace(path, "^file:/+", "file:/")


@dataclass(frozen=True)
class Scans:
    """Pages in files below a folder: sizes come from headers, and only pages asked for are decoded."""

    spark: SparkSession
    root: str
    pattern: str = "*"

    def sizes(self) -> DataFrame:
        return sizes(self.spark, self.root, self.pattern).filter("width IS NOT NULL")

    def decode(self, wanted: DataFrame) -> DataFrame:
        """(path, height, width, channels, data) of the pages ``wanted`` (path)."""
        few = wanted.limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            rows = images(self.spark, sorted(r.path for r in few)) if few else images(self.spark, self.root, self.pattern).limit(0)
            return rows.withColumn("path", plain(F.col("path")))
        return images(self.spark, self.root, self.pattern).withColumn("path", plain(F.col("path"))).join(wanted, "path", "left_semi")


@dataclass(frozen=True)
class Decoded:
    """Pages that are rows already (path, height, width, data)."""

    rows: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def sizes(self) -> DataFrame:
        return self.rows.select("path", "height", "width")

    def decode(self, wanted: DataFrame) -> DataFrame:
        return self.rows.join(wanted, "path", "left_semi")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _exists(path: str) -> bool:
    system, place = _located(path)
    return system.get_file_info(place).type != fs.FileType.NotFound


def image_root(local: str, mounts: str, marker: str = "manga109", child: str = "images") -> str:
    """The local folder if it exists; else the first one below ``mounts`` whose path has the marker and that holds the child; else the local one.

    Folders are visited from the top down, in order of their names; both are paths or URIs of any store.
    """
    if _exists(local):
        return local
    system, top = _located(mounts)
    waiting = [top]
    while waiting:
        folder = waiting.pop()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        below = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        if child in below and marker in folder.lower():
            return f"{mounts.rstrip('/').removesuffix(top)}{folder}/{child}" if "://" in mounts else f"{folder}/{child}"
        waiting += [f"{folder}/{name}" for name in reversed(below)]
    return local


def first_existing(*paths: str) -> str:
    """The first path or URI that exists; none is an error."""
    for path in paths:
        if _exists(path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def label_lines(spark: SparkSession, root: str) -> DataFrame:
    """(name, line_no, value) of label files."""
    rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(root, wholetext=True)
    named = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return named.select("name", "line_no", "value")


def split_files(spark: SparkSession, root: str, layout: str = LAYOUT) -> DataFrame:
    """(split, kind, name) of the files in a dataset's four folders; absent folders have none.

    A task lists a folder: Spark's own readers pass over empty files, which labels of negatives are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, kind in zip(batch.column("split").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(f"{root}/{layout.format(split=split, kind=kind)}")
                found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
                names = [f.base_name for f in found if f.type == fs.FileType.File]
                columns = [pa.array(x, pa.string()) for x in ([split] * len(names), [kind] * len(names), names)]
                yield pa.RecordBatch.from_arrays(columns, ["split", "kind", "name"])

    folders = spark.createDataFrame([(s, k) for s in SPLITS for k in KINDS], "split string, kind string").repartition(4)
    return folders.mapInArrow(run, "split string, kind string, name string")


def png(image: np.ndarray) -> bytes:
    """A PNG file of an RGB image."""
    h, w = image.shape[:2]
    raw = b"".join(b"\x00" + image[y].tobytes() for y in range(h))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def recreate(root: str, *folders: str) -> None:
    """Empties ``folders`` below ``root``, or makes them, so that nothing of an earlier, larger run stays."""
    system, path = fs.FileSystem.from_uri(root)
    for folder in folders:
        system.create_dir(f"{path}/{folder}", recursive=True)
        system.delete_dir_contents(f"{path}/{folder}")


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A whole file or none: it goes under a temporary name first."""
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, path)


# --- the dataset as a sink ----------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Files of one task."""

    pages: int


class DatasetWriter(DataSourceWriter):
    """Tasks stage files; the driver swaps the staged folders in when all have ended, so a failed run leaves the dataset as it was."""

    def __init__(self, root: str, layout: str) -> None:
        self.root, self.layout = root.rstrip("/"), layout
        self.staged = f"{self.root}/.staged-{uuid.uuid4().hex}"
        self.folders = [layout.format(split=s, kind=k) for s in SPLITS for k in KINDS]
        self._mend()
        system, path = fs.FileSystem.from_uri(self.staged)
        for folder in self.folders:
            system.create_dir(f"{path}/{folder}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = fs.FileSystem.from_uri(self.staged)
        n = 0
        for r in iterator:
            image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
            for kind, name, body in (("images", f"{r['name']}.png", png(image)), ("labels", f"{r['name']}.txt", r["text"].encode())):
                _put(system, f"{path}/{self.layout.format(split=r['split'], kind=kind)}/{name}", body)
            n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = fs.FileSystem.from_uri(self.root)
        old = f"{path}/.old-{uuid.uuid4().hex}"
        staged = f"{path}/{self.staged.rsplit('/', 1)[1]}"
        for folder in self.folders:  # leftovers of attempts that were cut off
            for f in system.get_file_info(fs.FileSelector(f"{staged}/{folder}")):
                if f.base_name.endswith(".part"):
                    system.delete_file(f.path)
        with system.open_output_stream(f"{staged}/{READY}") as f:
            f.write(b"")  # from here on the new dataset counts
        self._swap(system, path, staged, old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = fs.FileSystem.from_uri(self.staged)
        system.delete_dir(path)

    def _swap(self, system: fs.FileSystem, path: str, staged: str, old: str) -> None:
        for folder in self.folders:
            if system.get_file_info(f"{staged}/{folder}").type == fs.FileType.NotFound:
                continue  # swapped before
            system.create_dir(f"{old}/{folder}".rsplit("/", 1)[0], recursive=True)
            system.create_dir(f"{path}/{folder}".rsplit("/", 1)[0], recursive=True)
            if system.get_file_info(f"{path}/{folder}").type != fs.FileType.NotFound:
                system.move(f"{path}/{folder}", f"{old}/{folder}")
            system.move(f"{staged}/{folder}", f"{path}/{folder}")
        for folder in (old, staged):
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                system.delete_dir(folder)

    def _mend(self) -> None:
        """Ends what a driver that died in ``commit`` has begun."""
        system, path = fs.FileSystem.from_uri(self.root)
        for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(".staged-") and system.get_file_info(f"{f.path}/{READY}").type == fs.FileType.File:
                self._swap(system, path, f.path, f"{path}/.old-{uuid.uuid4().hex}")


READY = "READY"


class DatasetSource(DataSource):
    """``df.write.format("page_dataset").option("path", root).mode("overwrite")``: (split, name, height, width, data, text) as image and label files; option ``layout`` as ``LAYOUT``."""

    @classmethod
    def name(cls) -> str:
        return "page_dataset"

    def writer(self, schema: StructType, overwrite: bool) -> DatasetWriter:
        if not overwrite:
            raise ValueError("a dataset is written whole: use mode('overwrite')")
        lacking = {"split", "name", "height", "width", "data", "text"} - set(schema.names)
        if lacking:
            raise ValueError(f"pages lack {sorted(lacking)}")
        return DatasetWriter(self.options["path"], self.options.get("layout", LAYOUT))


def write_dataset(pages: DataFrame, root: str, layout: str = LAYOUT) -> DataFrame:
    """Writes image and label file of every page (split, name, height, width, data, text) and returns (split, kind, n).

    All or nothing: files of an earlier run stay until all new ones are there, and go then.
    The label file is always there, empty for pages without boxes. ``root`` is a URI, or a
    folder that all executors share.
    """
    spark = pages.sparkSession
    spark.dataSource.register(DatasetSource)
    rows = pages.select("split", "name", "height", "width", "data", "text")
    rows.write.format("page_dataset").option("path", root).option("layout", layout).mode("overwrite").save()
    written = split_files(spark, root, layout).groupBy("split", "kind").agg(F.count("*").alias("n"))
    return spark.createDataFrame(written.collect(), "split string, kind string, n long")  # four rows at most


SAMPLES, SAMPLE_NAME = "samples", "amostra_{}.png"


def write_samples(drawn: DataFrame, root: str) -> list[str]:
    """Writes pages with their boxes drawn (sample_no, height, width, data) as numbered files into the samples' folder, emptied first, and returns their names.

    Without rows nothing is touched.
    """
    numbers = sorted(r.sample_no for r in drawn.select("sample_no").collect())  # a sample's numbers, few by its definition
    if not numbers:
        return []
    recreate(root, SAMPLES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(root)
        for frame in frames:
            for r in frame.itertuples():
                _put(system, f"{path}/{SAMPLES}/{SAMPLE_NAME.format(r.sample_no)}", png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)))
            yield pd.DataFrame({"sample_no": np.array(frame["sample_no"].tolist(), np.int32)})

    written = drawn.select("sample_no", "height", "width", "data").mapInPandas(run, "sample_no int").collect()
    return [SAMPLE_NAME.format(n) for n in sorted(r.sample_no for r in written)]


def manifest(root: str, path: str, names: dict[int, str] | None = None, layout: str = LAYOUT) -> dict:
    """Writes the training manifest of a dataset, as YAML."""
    names = {0: "kanji"} if names is None else names
    folders = {split: layout.format(split=split, kind="images") for split in SPLITS}
    body = {"path": root, **folders, "nc": len(names), "names": names}
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    _put(system, place, yaml.safe_dump(body, allow_unicode=True, default_flow_style=False, sort_keys=False).encode())
    return body


def read_manifest(path: str) -> dict:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as f:
        return yaml.safe_load(f.read())
