"""A corpus from documents: language, repeated lines, near-duplicates, mixture, tokens.

Every stage takes the documents that the one before kept and returns their columns;
the last returns token counts and digests with places in the mixture, which order
the rows of ``run``; it reads them off the order in which the mixture stage left its
files and rows. ``run`` writes each stage as Parquet in
the shared folder and reads it again, so a lost executor never costs more than the
stage at hand.

Null columns, empty and very long texts, repeated rows and clashing names go through every
stage as the operators' docstrings tell; an empty table gives no rows. Rows that repeat
id and text are one document to the line and near-copy stages: the first keeps its lines,
as do the others, and one of them stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.llm import bpe, langid, lines, mixing, simhash
from inkplane.llm.common import crowded, cut, fresh_path, stored, table
from inkplane.llm.registry import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, as no language can be found; the others carry the language found.

    Learned from all documents that have a language; where none has, languages stay as they are.
    """
    found = langid.identify(docs, langid.fit(docs)).filter(langid.has_letter(F.col("text")))
    lang = F.when(F.col("lang_pred") == langid.UNKNOWN, F.col("lang")).otherwise(F.col("lang_pred"))
    return found.withColumn("lang", lang).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; a document that loses all its lines goes."""
    clean = lines.dedup(docs).filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash, five-word shingles) the document of the smallest (doc_id, text hash) stays.

    Documents without doc_id stand behind all others, by a number made of their text.
    """
    digest = F.xxhash64("text")
    spare = F.lit(1 << 62) + digest.bitwiseAND((1 << 61) - 1)
    id_ = F.struct(F.coalesce(F.col("doc_id"), spare).alias("d"), digest.alias("h"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), id_.alias("_id"))
    found = simhash.near_copies(rows.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")))
    first = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(first, "_id").dropDuplicates(["_id"]).select("_row.*").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: read file by file, row by row, they follow the target weights.

    That order is the stage's result: the next one takes its places from it and schedules nothing.
    """
    return mixing.in_order(mixing.mix(docs), crowded(spark)).select(docs.columns)


def standing(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``_at``: file (partition, path) and row where each stands; None if they stand in no files."""
    try:
        at = docs.metadataColumn("_metadata")
        part = F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).try_cast("long")
        file = F.struct(part.alias("part"), at["file_path"].alias("path"))
        return docs.withColumn("_at", F.struct(file.alias("file"), at["row_index"].alias("row")))
    except AnalysisException:
        return None


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left, with the place in the mixture (mix_slot, mix_place) that it stands at.

    Documents that stand in no files have no order: they are mixed and written first.
    """
    rows = standing(docs)
    if rows is None:
        rows = standing(stored(mix_sources(spark, docs, sf_dir), "mixture"))
    rows = rows.select(F.struct("doc_id", "source", "_at").alias("doc_id"), "text")
    # the places are counted in two passes: rows are encoded once, and small
    made = cut(bpe.tokens(rows, tokenizer_path()))
    made = made.select("*", F.col("doc_id._at.file").alias("_file"), F.col("doc_id._at.row").alias("_at"), F.col("doc_id.source").alias("source"))
    return mixing.read_back(made.withColumn("doc_id", F.col("doc_id.doc_id")), "_file", "_at").drop("source")


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

#: Language ID, fuzzy lines and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; rows come in the order of the mixture."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy("mix_slot", "mix_place").drop("mix_slot", "mix_place")
