"""Queries that write files and read them back: a dataset of small pages, and a stream of key presses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.operators import labels
from inkplane.plans import live_queries
from inkplane.plans.raster_queries import grey_images
from inkplane.plans.tables import read, shared_folder
from inkplane.sources import pages
from inkplane.streaming import live, sources

W = 8


def _small_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images as RGB pages, with up to three label lines each; every sixth is for validation."""
    k = F.col("vec_id")
    data = F.unhex(F.array_join(F.transform("a", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), ""))
    line = lambda i: F.format_string("0 0.%03d 0.%03d 0.250 0.125", (k * 7 + i * 31) % 1000, (k * 11 + i * 17) % 1000)
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= k % 4, F.concat(line(i), F.lit("\n")))))
    rows = grey_images(spark, sf_dir).withColumn("split", F.when(k % 6 == 0, "val").otherwise("train"))
    return rows.select("split", F.format_string("page_%06d", k).alias("name"), F.lit(W).alias("height"), F.lit(W).alias("width"), data.alias("data"), text.alias("text"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    root = shared_folder(spark, "dataset")
    pages.write_dataset(_small_pages(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), root)
    pages.manifest(root, f"{root}/dataset.yaml")
    return root


def dataset_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written and decoded again, found through the manifest: their sizes by header, and a digest of their pixels."""
    root = _written(spark, sf_dir)
    made = pages.read_manifest(f"{root}/dataset.yaml")
    out: DataFrame | None = None
    for split in pages.SPLITS:
        folder = f"{made['path']}/{made[split]}"
        sizes = pages.sizes(spark, folder).withColumnsRenamed({"height": "head_h", "width": "head_w"})
        found = pages.images(spark, folder).withColumn("path", pages.plain(F.col("path"))).join(sizes.withColumn("path", pages.plain(F.col("path"))), "path")
        name = F.regexp_extract("path", r"(page_\d+)\.png$", 1)
        found = found.select(F.lit(split).alias("split"), name.alias("name"), "height", "width", "head_h", "head_w", F.sha2("data", 256).alias("pixels"))
        out = found if out is None else out.unionByName(found)
    return out


def dataset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files written and parsed again."""
    root = _written(spark, sf_dir)
    return labels.parse(pages.label_lines(spark, f"{root}/labels/train"))


def dataset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind in each split's folder."""
    return labels.inventory(pages.split_files(spark, _written(spark, sf_dir)))


def _key_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Each batch of sorted presses as a file, named by its first."""
    system, path = fs.FileSystem.from_uri(folder)
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            text = "".join(f"{r['session']} {r['event_id']} {r['t']} {r['key']}\n" for r in rows)
            temporary = f"{path}/{uuid.uuid4().hex}.part"
            with system.open_output_stream(temporary) as f:
                f.write(text.encode())
            system.move(temporary, f"{path}/{rows[0]['t']:020d}-{rows[0]['event_id']:012d}.keys")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each session after all its keys, which come from files as a stream and move typed state."""
    root = shared_folder(spark, "keys")
    system, path = fs.FileSystem.from_uri(root)
    system.create_dir(f"{path}/in", recursive=True)
    rows = live_queries.presses(spark, sf_dir).select("session", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "t", "event_id").sortWithinPartitions("t", "event_id").mapInArrow(lambda it: _key_files(it, f"{root}/in"), "n long").write.format("noop").mode("overwrite").save()
    sources.register(spark)
    walked = live.sessions(spark.readStream.format("key_events").load(f"{root}/in"), live_queries.MONITOR)
    query = walked.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{root}/out").join(read(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return last.groupBy("session").agg(F.max_by(F.struct("top", "left", "width", "height"), F.struct("ts", "event_id")).alias("r")).select("session", "r.*")


QUERIES = {f.__name__: f for f in (dataset_images, dataset_labels, dataset_inventory, session_stream)}

_PIXELS = """px AS (
  SELECT vec_id, pos - 1 AS pos, greatest(0, least(255, CAST(floor((CAST(e AS DOUBLE) + 0.6::DOUBLE) * 200) AS INTEGER))) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""

ORACLE_SQL = {
    "dataset_images": f"""WITH {_PIXELS}
SELECT CASE WHEN vec_id % 6 = 0 THEN 'val' ELSE 'train' END AS split, printf('page_%06d', vec_id) AS name, 8 AS height, 8 AS width, 8 AS head_h, 8 AS head_w,
  sha256(unhex(string_agg(repeat(printf('%02x', v), 3), '' ORDER BY pos))) AS pixels FROM px GROUP BY vec_id""",
    "dataset_labels": """SELECT printf('page_%06d', vec_id) AS name, CAST(i - 1 AS INTEGER) AS line_no, 0 AS class, ((vec_id * 7 + i * 31) % 1000) / 1000.0::DOUBLE AS cx, ((vec_id * 11 + i * 17) % 1000) / 1000.0::DOUBLE AS cy,
  0.25::DOUBLE AS w, 0.125::DOUBLE AS h FROM (SELECT vec_id, unnest(range(1, vec_id % 4 + 1)) AS i FROM embeddings WHERE vec_id % 6 <> 0)""",
    "dataset_inventory": """SELECT split, kind, count(vec_id) AS n FROM (SELECT unnest(['train', 'val']) AS split), (SELECT unnest(['images', 'labels']) AS kind)
LEFT JOIN embeddings ON (split = 'val') = (vec_id % 6 = 0) GROUP BY split, kind""",
    "session_stream": live_queries.ORACLE_SQL["region_walk"],
}
