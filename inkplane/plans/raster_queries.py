"""Queries on rasters: embeddings stand for grey images of eight by eight pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.functions import draws, regions
from inkplane.operators import raster
from inkplane.params import Settings
from inkplane.plans.tables import read, u_sql

W = 8


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.6) * 200).cast("int"))))
    return read(spark, sf_dir, "embeddings").select("vec_id", grey.alias("a"))


def _pixels(df: DataFrame, a: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(a).alias("pos", "v"))


def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grey_images(spark, sf_dir)
    return rows.select("vec_id", F.round(raster.deviation(F.col("a")), 6).alias("deviation"), F.round(raster.mean(F.col("a")), 6).alias("brightness"))


def region_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grey_images(spark, sf_dir).filter(raster.deviation(F.col("a")) <= Settings().region_deviation_limit).select("vec_id")


def raster_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(grey_images(spark, sf_dir), raster.crop(F.col("a"), W, 2, 3, 4, 5))


def raster_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(raster.morph(grey_images(spark, sf_dir), "a", W, W, 2), F.col("a"))


def raster_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(raster.morph(grey_images(spark, sf_dir), "a", W, W, 3, grow=True), F.col("a"))


def raster_morph_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(raster.morph(grey_images(spark, sf_dir), "a", W, W, 4, rounds=2), F.col("a"))


def raster_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grey_images(spark, sf_dir).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.alias("pos"), *[F.get("a", i * 3 + k).alias(c) for k, c in enumerate("rgb")]))).alias("p"))
    return rows.select("vec_id", "p.pos", regions.luma(F.col("p.r"), F.col("p.g"), F.col("p.b")).cast("int").alias("v"))


def blur_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _pixels(grey_images(spark, sf_dir), raster.blur_rows(F.col("a"), W, 0.5))
    return made.withColumn("v", F.round("v", 6))


def noise_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal noise by position, added, clipped and truncated; compared away from whole numbers."""
    rows = _pixels(grey_images(spark, sf_dir), F.col("a"))
    noise = draws.normal(draws.uniform(21, "n1", "vec_id", "pos"), draws.uniform(21, "n2", "vec_id", "pos"), 40.0)
    return rows.select("vec_id", "pos", raster.clip_truncate(F.round(F.col("v") + noise, 6)).alias("v"))


def raster_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images turned by up to three degrees, drawn from their ids."""
    angle = draws.real(draws.uniform(31, "angle", "vec_id"), -3, 3)
    return _pixels(grey_images(spark, sf_dir), raster.rotate(F.col("a"), W, W, angle)).withColumn("v", F.round("v", 6))


def blur_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(grey_images(spark, sf_dir), raster.blur(F.col("a"), W, W, 0.5)).withColumn("v", F.round("v", 6))


def raster_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    x, y = (k % 5).cast("int"), (k % 3).cast("int")
    return _pixels(grey_images(spark, sf_dir), raster.outlined(F.col("a"), W, x, y, x + 3 + (k % 2).cast("int"), y + 4, thick=1))


def channel_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of every four values, which stand for the channels of a frame."""
    return _pixels(grey_images(spark, sf_dir), raster.first_channels(F.col("a")))


def degradation_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that synthesis runs, with every value drawn from the image's id: angle, sigma, kernel and rounds, erosion or dilation, noise."""
    byte = F.transform("a", lambda v: F.lpad(F.hex(v), 2, "0"))
    rows = grey_images(spark, sf_dir).select("vec_id", F.lit(W).alias("height"), (F.size("a") / W).cast("int").alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("data"))
    out = raster.degrade(raster.degradation_plan(rows, "vec_id", Settings(), 41))
    whole = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substr("data", i, F.lit(1))), 16, 10).cast("int"))
    return _pixels(out, whole)


def degradation_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images each step of the degradation takes, by image size class."""
    plan = raster.degradation_plan(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", Settings())
    return plan.groupBy("o_orderpriority").agg(F.count("angle").alias("turned"), F.count("sigma").alias("blurred"), F.count("kernel").alias("morphed"), F.sum(F.coalesce("rounds", F.lit(0)).cast("long")).alias("rounds"), F.count("std").alias("noisy"))


QUERIES = {f.__name__: f for f in (region_stats, region_accept, raster_crop, raster_erode, raster_dilate, raster_morph_iter, raster_grey, blur_rows, blur_image, raster_rotate, raster_outline, channel_drop, noise_clip, degradation_draws, degradation_pipeline)}

_IMAGES = """px AS (
  SELECT vec_id, pos - 1 AS pos, greatest(0, least(255, CAST(floor((CAST(e AS DOUBLE) + 0.6::DOUBLE) * 200) AS INTEGER))) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""


def _morph(size: int, pick: str, rounds: int) -> str:
    back, on, source, parts = size // 2, size - 1 - size // 2, "px", []
    for n in range(rounds):
        parts.append(f"r{n} AS (SELECT vec_id, pos, {pick}(v) OVER (PARTITION BY vec_id, pos // 8 ORDER BY pos % 8 ROWS BETWEEN {back} PRECEDING AND {on} FOLLOWING) AS v FROM {source})")
        parts.append(f"c{n} AS (SELECT vec_id, pos, {pick}(v) OVER (PARTITION BY vec_id, pos % 8 ORDER BY pos // 8 ROWS BETWEEN {back} PRECEDING AND {on} FOLLOWING) AS v FROM r{n})")
        source = f"c{n}"
    return f"WITH {_IMAGES}, {', '.join(parts)} SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(v AS INTEGER) AS v FROM {source}"


_WEIGHTS = "[exp(-0.5::DOUBLE * 16), exp(-0.5::DOUBLE * 4), 1.0::DOUBLE, exp(-0.5::DOUBLE * 4), exp(-0.5::DOUBLE * 16)]"

def _rotated(angle: str, source: str, name: str) -> str:
    """CTE ``name``: (vec_id, pos, v) of ``source`` turned."""
    inside = lambda v: f"greatest(0.0::DOUBLE, least(7.0::DOUBLE, {v}))"
    return f"""{name}_s AS (
  SELECT vec_id, pos, {inside("4.0::DOUBLE + (pos % 8 - 4.0::DOUBLE) * cos(radians(g)) - (pos // 8 - 4.0::DOUBLE) * sin(radians(g))")} AS x,
    {inside("4.0::DOUBLE + (pos % 8 - 4.0::DOUBLE) * sin(radians(g)) + (pos // 8 - 4.0::DOUBLE) * cos(radians(g))")} AS y
  FROM (SELECT vec_id, pos, {angle} AS g FROM {source})),
{name}_l AS (SELECT vec_id, list(v ORDER BY pos) AS a FROM {source} GROUP BY vec_id),
{name}_c AS (SELECT vec_id, pos, x, y, least(CAST(floor(x) AS INTEGER), 6) AS x0, least(CAST(floor(y) AS INTEGER), 6) AS y0 FROM {name}_s),
{name} AS (
  SELECT c.vec_id, pos, (a[y0 * 8 + x0 + 1] * (1 - (x - x0)) + a[y0 * 8 + x0 + 2] * (x - x0)) * (1 - (y - y0))
    + (a[y0 * 8 + x0 + 9] * (1 - (x - x0)) + a[y0 * 8 + x0 + 10] * (x - x0)) * (y - y0) AS v
  FROM {name}_c c JOIN {name}_l USING (vec_id))"""


def _blurred(source: str, name: str) -> str:
    """CTE ``name``: (vec_id, pos, v) of ``source`` blurred along both axes."""

    def along(before: str, made: str, at: str) -> str:
        return f"""{made} AS (SELECT t.vec_id, t.pos, sum({name}_w.w[t.k + 3] / {name}_w.total * q.v) AS v
  FROM (SELECT vec_id, pos, k, {at} AS at FROM {before}, (SELECT unnest([-2, -1, 0, 1, 2]) AS k)) t JOIN {before} q ON q.vec_id = t.vec_id AND q.pos = t.at, {name}_w GROUP BY t.vec_id, t.pos)"""

    weights = f"{name}_w AS (SELECT w, list_sum(w) AS total FROM (SELECT {_WEIGHTS} AS w))"
    return f"{weights}, {along(source, name + '_r', 'greatest(0, least(7, pos % 8 + k)) + 8 * (pos // 8)')}, {along(name + '_r', name, 'greatest(0, least(7, pos // 8 + k)) * 8 + pos % 8')}"


def _pipeline(seed: int) -> str:
    """What ``degradation_plan`` draws, and each step by joins of pixels with the pixels that they look at."""
    u = lambda purpose: u_sql(seed, purpose, "vec_id")

    def step(name: str, source: str, made: str, gate: str) -> str:
        return f"{name} AS (SELECT a.vec_id, a.pos, CASE WHEN {gate} THEN CAST(floor(round(b.v, 6) + 0.5::DOUBLE) AS INTEGER) ELSE a.v END AS v FROM {source} a JOIN plan p USING (vec_id) LEFT JOIN {made} b ON a.vec_id = b.vec_id AND a.pos = b.pos)"

    def soft(name: str, source: str, at: str) -> str:
        return f"{name} AS (SELECT a.vec_id, a.pos, sum(k.w * q.v) AS v FROM {source} a JOIN kernels k USING (vec_id) JOIN {source} q ON q.vec_id = a.vec_id AND q.pos = {at} GROUP BY a.vec_id, a.pos)"

    def morph(name: str, source: str, along: str, other: str, n: int) -> str:
        near = f"q.vec_id = a.vec_id AND {other.format('q')} = {other.format('a')} AND {along.format('q')} BETWEEN {along.format('a')} - kernel // 2 AND {along.format('a')} + kernel - 1 - kernel // 2"
        value = f"CASE WHEN any_value(rounds) IS NULL OR any_value(rounds) < {n} THEN any_value(a.v) WHEN any_value(grow) THEN max(q.v) ELSE min(q.v) END"
        return f"{name} AS (SELECT a.vec_id, a.pos, {value} AS v FROM {source} a JOIN plan USING (vec_id) JOIN {source} q ON q.vec_id = a.vec_id AND (rounds IS NULL AND q.pos = a.pos OR rounds IS NOT NULL AND {near}) GROUP BY a.vec_id, a.pos)"

    passes, source = [], "soft"
    for n in (1, 2, 3):
        passes.append(morph(f"r{n}", source, "{}.pos % 8", "{}.pos // 8", n))
        passes.append(morph(f"c{n}", f"r{n}", "{}.pos // 8", "{}.pos % 8", n))
        source = f"c{n}"
    x, y = "(noise_seed + pos * 2654435769) & 4294967295", "(noise_seed + pos * 2654435769 + 2246822507) & 4294967295"
    mixes = ""
    for n, (shift, times) in enumerate(((16, 2146121005), (15, 2221713035)), 1):
        mixes += f", m{n} AS (SELECT vec_id, pos, v, std, " + ", ".join(f"CAST((CAST(xor({c}, {c} >> {shift}) AS HUGEINT) * {times}) % 4294967296 AS BIGINT) AS {c}" for c in "xy") + f" FROM m{n - 1})"
    return f"""WITH {_IMAGES},
plan AS (SELECT DISTINCT vec_id, CASE WHEN {u('rotate')} < 0.4::DOUBLE THEN -3.0::DOUBLE + {u('angle')} * 6.0::DOUBLE END AS angle,
  CASE WHEN {u('blur')} < 0.5::DOUBLE THEN 0.1::DOUBLE + {u('sigma')} * (2.5::DOUBLE - 0.1::DOUBLE) END AS sigma,
  CASE WHEN {u('morph')} < 0.4::DOUBLE THEN 2 + CAST(floor({u('kernel')} * 3) AS INTEGER) END AS kernel, CASE WHEN {u('morph')} < 0.4::DOUBLE THEN 1 + CAST(floor({u('rounds')} * 3) AS INTEGER) END AS rounds,
  {u('grow')} < 0.5::DOUBLE AS grow, CASE WHEN {u('noise')} < 0.6::DOUBLE THEN 0.01::DOUBLE + {u('std')} * (0.25::DOUBLE - 0.01::DOUBLE) END AS std,
  CAST(floor({u('noise_seed')} * 4294967296.0::DOUBLE) AS BIGINT) AS noise_seed FROM px),
{_rotated("coalesce((SELECT angle FROM plan WHERE plan.vec_id = px.vec_id), 0)", 'px', 'turned')}, {step('one', 'px', 'turned', 'angle IS NOT NULL')},
raw AS (SELECT vec_id, k, exp(-0.5::DOUBLE * (k / sigma) * (k / sigma)) AS w FROM (SELECT vec_id, sigma, greatest(1, CAST(round_even(4 * sigma, 0) AS INTEGER)) AS reach FROM plan WHERE sigma IS NOT NULL), (SELECT unnest(range(-12, 13)) AS k) WHERE abs(k) <= reach),
kernels AS (SELECT vec_id, k, w / sum(w) OVER (PARTITION BY vec_id) AS w FROM raw),
{soft('across', 'one', 'greatest(0, least(7, a.pos % 8 + k.k)) + 8 * (a.pos // 8)')}, {soft('blurred', 'across', 'greatest(0, least(7, a.pos // 8 + k.k)) * 8 + a.pos % 8')},
{step('soft', 'one', 'blurred', 'sigma IS NOT NULL')}, {', '.join(passes)},
m0 AS (SELECT vec_id, pos, v, std, {x} AS x, {y} AS y FROM c3 JOIN plan USING (vec_id)){mixes},
u AS (SELECT vec_id, pos, v, std, (xor(x, x >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u1, (xor(y, y >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u2 FROM m2)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN std IS NULL THEN v ELSE trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE,
  round(v + sqrt(-2 * ln(u1)) * cos(6.283185307179586::DOUBLE * u2) * (std * 255), 6)))) END AS INTEGER) AS v FROM u"""


ORACLE_SQL = {
    "raster_rotate": f"""WITH {_IMAGES}, {_rotated("-3.0::DOUBLE + " + u_sql(31, 'angle', 'vec_id') + " * 6.0::DOUBLE", 'px', 'turned')}
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM turned""",
    "blur_image": f"WITH {_IMAGES}, {_blurred('px', 'soft')} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM soft",
    "raster_outline": f"""WITH {_IMAGES}, r AS (SELECT *, pos % 8 AS x, pos // 8 AS y, vec_id % 5 AS x0, vec_id % 3 AS y0, vec_id % 5 + 3 + vec_id % 2 AS x1, vec_id % 3 + 4 AS y1 FROM px)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (x IN (x0, x1) OR y IN (y0, y1)) THEN 255 ELSE v END AS INTEGER) AS v FROM r""",
    "channel_drop": f"WITH {_IMAGES} SELECT vec_id, CAST(pos // 4 * 3 + pos % 4 AS INTEGER) AS pos, CAST(v AS INTEGER) AS v FROM px WHERE pos % 4 < 3",
    "degradation_pipeline": _pipeline(41),
    "region_stats": f"WITH {_IMAGES} SELECT vec_id, round(stddev_pop(v), 6) AS deviation, round(avg(v), 6) AS brightness FROM px GROUP BY vec_id",
    "region_accept": f"WITH {_IMAGES} SELECT vec_id FROM px GROUP BY vec_id HAVING stddev_pop(v) <= 25",
    "raster_crop": f"""WITH {_IMAGES} SELECT vec_id, CAST((pos // 8 - 3) * 4 + pos % 8 - 2 AS INTEGER) AS pos, CAST(v AS INTEGER) AS v FROM px
WHERE pos // 8 BETWEEN 3 AND 7 AND pos % 8 BETWEEN 2 AND 5""",
    "raster_erode": _morph(2, "min", 1),
    "raster_dilate": _morph(3, "max", 1),
    "raster_morph_iter": _morph(4, "min", 2),
    "raster_grey": f"""WITH {_IMAGES} SELECT a.vec_id, CAST(a.pos // 3 AS INTEGER) AS pos, CAST((a.v * 19595 + b.v * 38470 + c.v * 7471 + 32768) >> 16 AS INTEGER) AS v
FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1 JOIN px c ON a.vec_id = c.vec_id AND c.pos = a.pos + 2 WHERE a.pos % 3 = 0 AND a.pos < 63""",
    "blur_rows": f"""WITH {_IMAGES}, w AS (SELECT {_WEIGHTS} AS w), s AS (SELECT w, list_sum(w) AS total FROM w),
k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k),
t AS (SELECT px.vec_id, px.pos, k.k, greatest(0, least(7, px.pos % 8 + k.k)) + 8 * (px.pos // 8) AS at FROM px, k)
SELECT t.vec_id, CAST(t.pos AS INTEGER) AS pos, round(sum(s.w[t.k + 3] / s.total * q.v), 6) AS v FROM t JOIN px q ON q.vec_id = t.vec_id AND q.pos = t.at, s GROUP BY t.vec_id, t.pos""",
    "noise_clip": f"""WITH {_IMAGES} SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE,
  round(v + sqrt(-2 * ln(1 - {u_sql(21, 'n1', 'vec_id', 'pos')})) * cos(6.283185307179586::DOUBLE * {u_sql(21, 'n2', 'vec_id', 'pos')}) * 40.0::DOUBLE, 6)))) AS INTEGER) AS v FROM px""",
    "degradation_draws": f"""WITH g AS (SELECT o_orderpriority, {u_sql(0, 'rotate', 'o_orderkey')} < 0.4::DOUBLE AS r, {u_sql(0, 'blur', 'o_orderkey')} < 0.5::DOUBLE AS b, {u_sql(0, 'morph', 'o_orderkey')} < 0.4::DOUBLE AS m,
  CAST(1 + floor({u_sql(0, 'rounds', 'o_orderkey')} * 3.0::DOUBLE) AS BIGINT) AS n, {u_sql(0, 'noise', 'o_orderkey')} < 0.6::DOUBLE AS z FROM orders)
SELECT o_orderpriority, count(*) FILTER (r) AS turned, count(*) FILTER (b) AS blurred, count(*) FILTER (m) AS morphed, CAST(sum(CASE WHEN m THEN n ELSE 0 END) AS BIGINT) AS rounds, count(*) FILTER (z) AS noisy FROM g GROUP BY 1""",
}
