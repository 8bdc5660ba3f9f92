"""Queries on character sets and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.functions.text import basename, char, is_japanese, swap_suffix
from inkplane.operators import charset
from inkplane.plans.tables import font_glyphs, glyph_sql, read


def charset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = charset.common(font_glyphs(spark, sf_dir, "lang"))
    return common.select("codepoint", char(F.col("codepoint")).alias("ch"))


def charset_script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script test on every code point of the parts' keys, shifted to where the ranges end."""
    at = F.lit(0x3030) + F.col("p_partkey") % 0x7000
    return read(spark, sf_dir, "part").select("p_partkey", at.cast("int").alias("codepoint"), is_japanese(at).alias("japanese"), char(at).alias("ch"))


def charset_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Japanese characters that three fonts have in common: the parts' code points, of which one font lacks every fifth and another every seventh."""
    points = read(spark, sf_dir, "part").select((F.lit(0x3030) + F.col("p_partkey") % 0x300).cast("int").alias("codepoint"))
    fonts = F.array(F.lit("a"), F.when(F.col("codepoint") % 5 != 0, "b"), F.when(F.col("codepoint") % 7 != 0, "c"))
    return charset.supported(points.select(F.explode(F.array_compact(fonts)).alias("font"), "codepoint"))


def charset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return font_glyphs(spark, sf_dir, "lang").groupBy("font").agg(F.count("*").alias("n"))


def _coverage_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    glyphs = font_glyphs(spark, sf_dir, "source")
    wanted = glyphs.select("codepoint").distinct().select("codepoint", char(F.col("codepoint")).alias("ch"), F.col("codepoint").alias("pos"))
    return glyphs.select("font").distinct(), wanted, glyphs


def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.missing(*_coverage_inputs(spark, sf_dir)).select("font", "codepoint", "ch")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.coverage(*_coverage_inputs(spark, sf_dir))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries; their label is the level, which most of them lack."""
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    level = marks.select("doc_id", (F.col("quality") + F.col("toxic") * 2 + 1).alias("jlpt_new"))
    return docs.select("doc_id", "lang").join(level, "doc_id", "left")


def level_filter_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.of_level(_dictionary(spark, sf_dir), "n2").select("doc_id", "lang", "jlpt_new")


def level_filter_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.of_level(_dictionary(spark, sf_dir), "no level").select("doc_id", "lang")


def level_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.of_level(_dictionary(spark, sf_dir), "").select("doc_id", F.coalesce("jlpt_new", F.lit(-1)).alias("jlpt_new"))


def level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("n"), (F.col("p_partkey") % 8).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", code.alias("level"), F.coalesce(charset.level_of(code), F.lit(-1)).alias("number"))


def limit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten entries, in order."""
    return read(spark, sf_dir, "documents").orderBy("doc_id").limit(10).select("doc_id", "lang")


def json_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of JSON objects."""
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string, int>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


def dictionary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string, int>"))).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"))


def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").filter(F.col("url").endswith("#top")).select("page_id", "url")


def stem_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", basename(F.col("url")).alias("name"), swap_suffix(F.col("url"), ".example", ".txt").alias("swapped"))


def path_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.lit("dataset"), F.when(F.col("page_id") % 2 == 0, "train").otherwise("val"), basename(F.col("url"))).alias("path"))


QUERIES = {
    f.__name__: f
    for f in (
        charset_intersection, charset_script_filter, charset_supported, charset_size, coverage_missing, coverage_report, level_filter_known,
        level_filter_unknown, level_all, level_lookup, limit_head, json_dictionary, dictionary_keys, suffix_filter, stem_swap, path_build,
    )
}

_JAPANESE = "(codepoint BETWEEN 12353 AND 12438 OR codepoint BETWEEN 12449 AND 12534 OR codepoint BETWEEN 19968 AND 40959)"
_DICTIONARY = "dictionary AS (SELECT d.doc_id, lang, CAST(quality + toxic * 2 + 1 AS INTEGER) AS jlpt_new FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_LOST = f"""WITH {glyph_sql('source')}, fonts AS (SELECT DISTINCT font FROM glyph), wanted AS (SELECT DISTINCT codepoint FROM glyph),
lost AS (SELECT font, codepoint, chr(codepoint) AS ch FROM fonts, wanted WHERE NOT EXISTS (SELECT 1 FROM glyph g WHERE g.font = fonts.font AND g.codepoint = wanted.codepoint))"""

ORACLE_SQL = {
    "charset_intersection": f"""WITH {glyph_sql('lang')} SELECT codepoint, chr(codepoint) AS ch FROM glyph
GROUP BY codepoint HAVING count(DISTINCT font) = (SELECT count(DISTINCT font) FROM glyph)""",
    "charset_script_filter": f"""WITH points AS (SELECT p_partkey, CAST(12336 + p_partkey % 28672 AS INTEGER) AS codepoint FROM part)
SELECT p_partkey, codepoint, {_JAPANESE} AS japanese, chr(codepoint) AS ch FROM points""",
    "charset_supported": f"""WITH points AS (SELECT DISTINCT CAST(12336 + p_partkey % 768 AS INTEGER) AS codepoint FROM part),
glyph AS (SELECT 'a' AS font, codepoint FROM points UNION ALL SELECT 'b', codepoint FROM points WHERE codepoint % 5 <> 0 UNION ALL SELECT 'c', codepoint FROM points WHERE codepoint % 7 <> 0)
SELECT codepoint, chr(codepoint) AS ch FROM glyph WHERE {_JAPANESE} GROUP BY codepoint HAVING count(DISTINCT font) = (SELECT count(DISTINCT font) FROM glyph)""",
    "charset_size": f"WITH {glyph_sql('lang')} SELECT font, count(*) AS n FROM glyph GROUP BY font",
    "coverage_missing": f"{_LOST} SELECT font, codepoint, ch FROM lost",
    "coverage_report": f"""{_LOST} SELECT f.font, count(codepoint) AS n_missing, coalesce(string_agg(ch, '' ORDER BY codepoint), '') AS missing
FROM fonts f LEFT JOIN lost l ON f.font = l.font GROUP BY f.font""",
    "level_filter_known": f"WITH {_DICTIONARY} SELECT doc_id, lang, jlpt_new FROM dictionary WHERE jlpt_new IS NOT DISTINCT FROM 2",
    "level_filter_unknown": f"WITH {_DICTIONARY} SELECT doc_id, lang FROM dictionary WHERE jlpt_new IS NOT DISTINCT FROM NULL",
    "level_all": f"WITH {_DICTIONARY} SELECT doc_id, coalesce(jlpt_new, -1) AS jlpt_new FROM dictionary",
    "level_lookup": """SELECT p_partkey, 'n' || (p_partkey % 8) AS level, CAST(CASE WHEN p_partkey % 8 BETWEEN 1 AND 5 THEN p_partkey % 8 ELSE -1 END AS INTEGER) AS number FROM part""",
    "limit_head": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10",
    "json_dictionary": """SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS INTEGER) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
    "dictionary_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "suffix_filter": "SELECT page_id, url FROM pages WHERE suffix(url, '#top')",
    "stem_swap": "SELECT page_id, string_split(url, '/')[-1] AS name, replace(url, '.example', '.txt') AS swapped FROM pages",
    "path_build": "SELECT page_id, 'dataset/' || CASE WHEN page_id % 2 = 0 THEN 'train' ELSE 'val' END || '/' || string_split(url, '/')[-1] AS path FROM pages",
}
