"""Queries on outlines: the first 32 values of an embedding stand for a closed line of 16 corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.operators import glyphs
from inkplane.plans.tables import read

SIDE, CORNERS, REACH = 8, 16, 1.0


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in a square of ``SIDE`` pixels, as shapes of three fonts of 1000 units."""
    at = lambda i: F.round(F.greatest(F.lit(-50.0), F.least(F.lit(1050.0), (F.get("embedding", i).cast("double") + 0.3) * 1600)), 3)
    line = F.transform(F.sequence(F.lit(0), F.lit(CORNERS - 1)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("f"), F.col("vec_id") % 3).alias("font"), F.expr("cast(vec_id div 3 as int)").alias("codepoint"), F.lit(1000).alias("units"), F.lit(880).alias("ascent"), F.array(line).alias("contours"))


def _pixels(spark: SparkSession, sf_dir: str, stroked: bool) -> DataFrame:
    scaled = F.transform("contours", lambda line: F.transform(line, lambda p: F.struct((p["x"] / 125).alias("x"), (p["y"] / 125).alias("y"))))
    rows = shapes(spark, sf_dir).select("vec_id", scaled.alias("contours"))
    made = glyphs.covered(rows, SIDE, SIDE, REACH if stroked else None)
    return made.select("vec_id", F.posexplode("cover").alias("pos", "v")).withColumn("v", F.round("v", 6))


def outline_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every pixel inside the line."""
    return _pixels(spark, sf_dir, stroked=False)


def outline_stroke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a stroke around."""
    return _pixels(spark, sf_dir, stroked=True)


def glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the pen at three sizes."""
    rows = glyphs.measured(shapes(spark, sf_dir)).withColumn("size", F.explode(F.array(F.lit(24), F.lit(36), F.lit(48))))
    return rows.select("vec_id", "size", glyphs.box(F.col("size")).alias("b")).select("vec_id", "size", "b.*")


QUERIES = {f.__name__: f for f in (outline_fill, outline_stroke, glyph_boxes)}

CORNERS_SQL = """corners AS (
  SELECT vec_id, i, round(greatest(-50.0::DOUBLE, least(1050.0::DOUBLE, (CAST(embedding[2 * i + 1] AS DOUBLE) + 0.3::DOUBLE) * 1600)), 3) AS x,
    round(greatest(-50.0::DOUBLE, least(1050.0::DOUBLE, (CAST(embedding[2 * i + 2] AS DOUBLE) + 0.3::DOUBLE) * 1600)), 3) AS y
  FROM embeddings, (SELECT unnest(range(16)) AS i))"""

_COVER = f"""{CORNERS_SQL},
edges AS (SELECT a.vec_id, a.x / 125 AS x0, a.y / 125 AS y0, b.x / 125 AS x1, b.y / 125 AS y1 FROM corners a JOIN corners b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 16),
banded AS (SELECT *, greatest(r, least(r + 1, y0)) AS a, greatest(r, least(r + 1, y1)) AS b FROM edges, (SELECT CAST(unnest(range(8)) AS DOUBLE) AS r)),
cut AS (SELECT vec_id, r, b - a AS dy, least(x0 + (a - y0) * s, x0 + (b - y0) * s) AS low, greatest(x0 + (a - y0) * s, x0 + (b - y0) * s) AS high FROM (SELECT *, (x1 - x0) / (y1 - y0) AS s FROM banded WHERE a <> b)),
parts AS (SELECT vec_id, r, c, dy, low, high, c + 1 - low AS u, c + 1 - high AS w FROM cut, (SELECT CAST(unnest(range(8)) AS DOUBLE) AS c)),
means AS (SELECT vec_id, r, c, dy * CASE WHEN high - low > 1e-9 THEN
    (CASE WHEN u <= 0 THEN 0.0::DOUBLE WHEN u >= 1 THEN u - 0.5::DOUBLE ELSE u * u / 2 END - CASE WHEN w <= 0 THEN 0.0::DOUBLE WHEN w >= 1 THEN w - 0.5::DOUBLE ELSE w * w / 2 END) / (high - low)
  ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, c + 1 - (low + high) / 2)) END AS v FROM parts),
grid AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS pos FROM (SELECT DISTINCT vec_id FROM corners)),
filled AS (
  SELECT g.vec_id, g.pos, least(1.0::DOUBLE, abs(coalesce(v, 0))) AS v
  FROM grid g LEFT JOIN (SELECT vec_id, CAST(r * 8 + c AS INTEGER) AS pos, sum(v) AS v FROM means GROUP BY ALL) m ON m.vec_id = g.vec_id AND m.pos = g.pos)"""

ORACLE_SQL = {
    "outline_fill": f"WITH {_COVER} SELECT vec_id, pos, round(v, 6) AS v FROM filled",
    "outline_stroke": f"""WITH {_COVER},
near AS (
  SELECT vec_id, pos, min(sqrt(pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2))) AS d FROM (
    SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / coalesce(nullif(pow(x1 - x0, 2) + pow(y1 - y0, 2), 0), 1))) AS t
    FROM (SELECT vec_id, pos, pos % 8 + 0.5::DOUBLE AS x, pos // 8 + 0.5::DOUBLE AS y FROM grid) JOIN edges USING (vec_id)) GROUP BY vec_id, pos)
SELECT vec_id, pos, round(greatest(v, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.5::DOUBLE - d))), 6) AS v FROM filled JOIN near USING (vec_id, pos)""",
    "glyph_boxes": f"""WITH {CORNERS_SQL}, bounds AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM corners GROUP BY vec_id),
s AS (SELECT *, CAST(size AS DOUBLE) / 1000 AS k FROM bounds, (SELECT unnest([24, 36, 48]) AS size))
SELECT vec_id, size, CAST(floor(x0 * k) AS INTEGER) AS "left", CAST(ceil(880 * k) - ceil(y1 * k) AS INTEGER) AS top,
  CAST(ceil(x1 * k) - floor(x0 * k) AS INTEGER) AS width, CAST(ceil(y1 * k) - floor(y0 * k) AS INTEGER) AS height FROM s""",
}
