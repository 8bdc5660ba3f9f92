"""Character-set algebra over (font, codepoint) and (kanji, jlpt_new) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.functions.text import char, is_japanese

#: Level names.
LEVELS = {"n1": 1, "n2": 2, "n3": 3, "n4": 4, "n5": 5}


def level_of(name: Column) -> Column:
    """The number of a level; null for names that aren't levels."""
    made = F.lit(None).cast("int")
    for level, number in LEVELS.items():
        made = F.when(name == level, F.lit(number)).otherwise(made)
    return made


def of_level(dictionary: DataFrame, level: str) -> DataFrame:
    """Entries of a level. The empty name keeps all; an unknown one matches the entries that have no level."""
    return dictionary if level == "" else dictionary.filter(F.col("jlpt_new").eqNullSafe(level_of(F.lit(level))))


def glyphs(rows: DataFrame) -> DataFrame:
    return rows.select("font", "codepoint").distinct()


def common(rows: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """Code points that every font has; no font at all is an error.

    One aggregation by code point against the number of fonts, which is one row.
    """
    listed = (rows if fonts is None else fonts).select("font").distinct()
    if listed.isEmpty():
        raise ValueError("no fonts")
    have = glyphs(rows).join(listed, "font", "left_semi").groupBy("codepoint").agg(F.count("*").alias("have"))
    total = listed.agg(F.count("*").alias("fonts"))
    return have.join(F.broadcast(total), F.col("have") == F.col("fonts")).select("codepoint")


def supported(rows: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """(codepoint, ch): common code points of Japanese scripts."""
    return common(rows, fonts).filter(is_japanese(F.col("codepoint"))).withColumn("ch", char(F.col("codepoint")))


def missing(fonts: DataFrame, characters: DataFrame, rows: DataFrame) -> DataFrame:
    """(font, codepoint, ...): wanted characters that a font lacks.

    Fonts are few; the wanted characters are copied to each of them before the anti join.
    """
    wanted = characters.join(F.broadcast(fonts.select("font").distinct()))
    return wanted.join(glyphs(rows), ["font", "codepoint"], "left_anti")


def coverage(fonts: DataFrame, characters: DataFrame, rows: DataFrame) -> DataFrame:
    """(font, n_missing, missing) for every font; ``characters`` has (codepoint, ch, pos), missing ones come in order of pos."""
    lost = missing(fonts, characters, rows).groupBy("font").agg(
        F.count("*").alias("n_missing"), F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("lost")
    )
    text = F.array_join(F.transform("lost", lambda x: x["ch"]), "")
    found = fonts.select("font").distinct().join(lost, "font", "left")
    return found.select("font", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), F.coalesce(text, F.lit("")).alias("missing"))
