"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes inside a task, which bounds
#: the work arrays whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets one of its own; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Like ``cut``, as a Parquet table: smaller, and read by column."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more: its cleaner waits for a collection in the driver, which may be long in coming."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crowded(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive (start, length) runs of rows holding about ``limit`` bytes each; one row at least."""
    values = batch.column(column)
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size) - start


def valid_vector(column: str):
    """Not null, not empty, and every component present and finite."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(fine, F.lit(False))


def _pack(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Texts compressed before a shuffle, which moves them whole."""
    press = zstandard.ZstdCompressor(level=level)
    for batch in batches:
        texts = [None if t is None else press.compress(t.encode()) for t in batch.column("t").to_pylist()]
        at = batch.schema.get_field_index("t")
        yield batch.set_column(at, "t", pa.array(texts, pa.binary()))


def packed(docs: DataFrame, *names: str, level: int = 3) -> DataFrame:
    rows = docs.select(*names, "t")
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    return rows.mapInArrow(lambda it: _pack(it, level), ", ".join([*kinds, "t binary"]))


def unpacked(texts: pa.Array) -> Iterator[bytes | None]:
    """The bytes of packed texts."""
    press = zstandard.ZstdDecompressor()
    for t in texts:
        yield press.decompress(t.as_py()) if t.is_valid else None
