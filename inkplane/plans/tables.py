"""Relations that the queries derive from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.functions import boxes

SIDE = 640


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share; a local session without one configured gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        configured = spark.sparkContext.getCheckpointDir()
    return f"{configured.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: What names a box.
BOX_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def box_columns(spark: SparkSession, sf_dir: str, kept: Column | None = None) -> DataFrame:
    """(page, block_no, x, y, w, h): boxes that lie in, across and beyond a 640-pixel page; those ``kept`` only."""
    li = read(spark, sf_dir, "lineitem")
    li = li if kept is None else li.filter(kept)
    parts = {"x": (F.col("l_partkey") * 7) % 700 - 30, "y": (F.col("l_suppkey") * 53) % 700 - 30, "w": F.col("l_quantity").cast("int"), "h": F.col("l_linenumber") * 8}
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_no"), *[c.cast("double").alias(n) for n, c in parts.items()])


def box_table(spark: SparkSession, sf_dir: str, kept: Column | None = None) -> DataFrame:
    """(page, block_no, box): the same with boxes as structs."""
    return box_columns(spark, sf_dir, kept).select("page", "block_no", boxes.box(*[F.col(n) for n in "xywh"]).alias("box"))


def box_sql(kept: str = "true") -> str:
    """CTE ``box`` of the line items that are ``kept``."""
    return f"""box AS (
  SELECT l_orderkey AS page, l_linenumber AS block_no, CAST((l_partkey * 7) % 700 - 30 AS DOUBLE) AS x, CAST((l_suppkey * 53) % 700 - 30 AS DOUBLE) AS y,
    CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS w, CAST(l_linenumber * 8 AS DOUBLE) AS h
  FROM lineitem WHERE {kept})"""


BOX_SQL = box_sql()


def font_glyphs(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """(font, codepoint): the characters of the documents of a language or source, which stands for a font."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col(by).alias("font"), F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch <> ''").distinct()
    return rows.select("font", F.ascii("ch").alias("codepoint"))


def glyph_sql(by: str) -> str:
    return f"""glyph AS (
  SELECT DISTINCT {by} AS font, unicode(ch) AS codepoint FROM (SELECT {by}, unnest(list_distinct(string_split(text, ''))) AS ch FROM documents) WHERE ch <> '')"""


def u_sql(seed: int, purpose: str, *key: str) -> str:
    """The SQL of ``draws.uniform``."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {parts}, '{purpose}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
