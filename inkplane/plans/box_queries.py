"""Queries on boxes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.functions import boxes
from inkplane.operators import labels
from inkplane.plans.tables import BOX_SQL, SIDE, box_columns, box_sql, box_table, read

MARGIN = 0.10


def _flat(df: DataFrame, column: str) -> DataFrame:
    return df.select("page", f"{column}.*")


def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(box_table(spark, sf_dir).select("page", boxes.expand(F.col("box"), SIDE, MARGIN).alias("b")), "b")


def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = box_table(spark, sf_dir).select("page", boxes.clamp(F.col("box"), SIDE, SIDE).alias("b"))
    return _flat(made.filter(boxes.has_area(F.col("b"))), "b")


def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(box_table(spark, sf_dir).select("page", boxes.normalise(F.col("box"), SIDE).alias("b")), "b")


def box_int_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(box_table(spark, sf_dir).select("page", boxes.truncate(boxes.expand(F.col("box"), SIDE, MARGIN)).alias("b")), "b")


def box_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded, clamped, filtered, normalised: label rows. No shuffle, no Python."""
    rows = box_columns(spark, sf_dir).drop("block_no")
    return boxes.normalised(boxes.clamped(boxes.expanded(rows, SIDE, MARGIN), SIDE, SIDE), SIDE)


def box_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box_table(spark, sf_dir).withColumn("box_no", F.lit(0))
    return labels.lines_of(rows, SIDE).select("page", "line")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text of orders, with lines that are no labels."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    numbers = F.concat_ws(" ", F.lit("0"), *[((k * m) % 1000 / F.lit(1000.0)).cast("string") for m in (7, 11, 13, 17)])
    value = F.when(k % 5 == 0, F.concat(F.lit(" \t"), F.replace(numbers, F.lit(" "), F.lit("\t ")), F.lit("\n"))).when(k % 5 == 1, F.concat_ws(" ", numbers, F.lit("9"))).when(k % 5 == 2, F.lit("")).otherwise(numbers)
    return o.select(F.format_string("page_%06d", F.floor(k / 4).cast("long")).alias("name"), (k % 4).cast("int").alias("line_no"), value.alias("value"))


_PARSED = """parsed AS (
  SELECT printf('page_%06d', o_orderkey // 4) AS name, CAST(o_orderkey % 4 AS INTEGER) AS line_no, ((o_orderkey * 7) % 1000) / 1000.0::DOUBLE AS cx,
    ((o_orderkey * 11) % 1000) / 1000.0::DOUBLE AS cy, ((o_orderkey * 13) % 1000) / 1000.0::DOUBLE AS w, ((o_orderkey * 17) % 1000) / 1000.0::DOUBLE AS h
  FROM orders WHERE o_orderkey % 5 IN (0, 3, 4))"""


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse(_lines(spark, sf_dir))


def label_to_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.to_corners(labels.parse(_lines(spark, sf_dir)), SIDE, SIDE)


def box_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether boxes inside the page come back from text within a millionth of the side, by page."""
    rows = box_table(spark, sf_dir).withColumn("box_no", F.lit(0))
    b = F.col("box")
    inside = rows.filter((b["x"] >= 0) & (b["y"] >= 0) & (b["x"] + b["w"] <= SIDE) & (b["y"] + b["h"] <= SIDE))
    lines = labels.lines_of(inside, SIDE).select(F.col("page").cast("string").alias("name"), F.lit(0).alias("line_no"), F.col("line").alias("value"), "box")
    p = F.split("value", " ")
    part = lambda i: F.element_at(p, i).cast("double")
    c = boxes.corners(part(2), part(3), part(4), part(5), F.lit(float(SIDE)), F.lit(float(SIDE)))
    error = F.greatest(F.abs(c["x0"] - b["x"]), F.abs(c["y0"] - b["y"]), F.abs(c["x1"] - b["x"] - b["w"]), F.abs(c["y1"] - b["y"] - b["h"]))
    return lines.withColumn("e", error).groupBy(F.col("name").cast("long").alias("page")).agg(F.count("*").alias("n"), (F.max("e") <= 1e-6 * SIDE).alias("close"))


def rotate_box_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box_columns(spark, sf_dir).drop("block_no")
    turned = boxes.hulled(rows, (F.col("page") % 7 - 3).cast("double"), SIDE, SIDE)
    return turned.select("page", *[(F.round(n, 6) + 0.0).alias(n) for n in "xywh"])


def page_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkplane.functions.text import page_name as name

    return read(spark, sf_dir, "orders").select("o_orderkey", name(F.col("o_orderkey") * 97 - 300).alias("name"))


def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"))
    return labels.pair_audit(images, read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).cast("string").alias("name")))


def page_label_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text of every page, pages without boxes included."""
    rows = box_table(spark, sf_dir).withColumn("box_no", F.col("box.x").cast("int"))
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    return labels.page_texts(pages, labels.lines_of(rows, SIDE).select("page", "block_no", "box_no", "line"))


def box_union_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page as one list, block by block."""
    rows = box_table(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("block_no", F.col("box.x").cast("int").alias("x"), F.col("box.y").cast("int").alias("y"))))
    text = F.array_join(F.transform("o", lambda b: F.concat_ws(":", b["block_no"], b["x"], b["y"])), ",")
    return rows.groupBy("page").agg(ordered.alias("o")).select("page", F.size("o").cast("long").alias("n_boxes"), text.alias("boxes"))


def split_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    files = o.filter("o_orderkey % 3 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("val").alias("split"), F.lit("images").alias("kind"))
    more = o.filter("o_orderkey % 4 = 0").select(F.lit("train").alias("split"), F.lit("labels").alias("kind"))
    return labels.inventory(files.unionByName(more))


QUERIES = {
    f.__name__: f
    for f in (
        box_expand, box_clamp, box_normalize, box_int_trunc, box_pipeline, box_label_lines, label_parse, label_to_corners, box_roundtrip_error,
        rotate_box_hull, page_name, pair_audit, page_label_outer, box_union_ordered, split_inventory,
    )
}

_EXPANDED = f"""expanded AS (
  SELECT page, greatest(0.0::DOUBLE, x - w * {MARGIN}::DOUBLE) AS x, greatest(0.0::DOUBLE, y - h * {MARGIN}::DOUBLE) AS y,
    least({SIDE}::DOUBLE - greatest(0.0::DOUBLE, x - w * {MARGIN}::DOUBLE), w + 2 * (w * {MARGIN}::DOUBLE)) AS w,
    least({SIDE}::DOUBLE - greatest(0.0::DOUBLE, y - h * {MARGIN}::DOUBLE), h + 2 * (h * {MARGIN}::DOUBLE)) AS h
  FROM box)"""


def _clamped(source: str) -> str:
    a = lambda v, n: f"greatest(0.0::DOUBLE, least({SIDE - 1}.0::DOUBLE, {v}))"
    e = lambda v, n: f"greatest(0.0::DOUBLE, least({SIDE}.0::DOUBLE, {v} + {n})) - {a(v, n)}"
    return f"clamped AS (SELECT page, {a('x', 'w')} AS x, {a('y', 'h')} AS y, {e('x', 'w')} AS w, {e('y', 'h')} AS h FROM {source})"


def box_sql_inside(kept: str) -> str:
    """CTEs up to ``inside``: the boxes kept, widened and clamped, that have an area."""
    return f"{box_sql(kept)}, {_EXPANDED}, {_clamped('expanded')}, inside AS (SELECT * FROM clamped WHERE w > 0 AND h > 0)"


def _unit(v: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v} / {SIDE}.0::DOUBLE))"


_NORMAL = f"SELECT page, {_unit('(x + w / 2)')} AS cx, {_unit('(y + h / 2)')} AS cy, {_unit('w')} AS w, {_unit('h')} AS h FROM"
_LINE = f"printf('0 %.6f %.6f %.6f %.6f', {_unit('(x + w / 2)')}, {_unit('(y + h / 2)')}, {_unit('w')}, {_unit('h')})"


def _hull() -> str:
    c, s = "cos(radians(a))", "sin(radians(a))"
    xs = [f"320.0::DOUBLE + ({x} - 320.0::DOUBLE) * {c} + ({y} - 320.0::DOUBLE) * {s}" for x in ("x", "(x + w)") for y in ("y", "(y + h)")]
    ys = [f"320.0::DOUBLE - ({x} - 320.0::DOUBLE) * {s} + ({y} - 320.0::DOUBLE) * {c}" for x in ("x", "(x + w)") for y in ("y", "(y + h)")]
    inside = lambda v: f"greatest(0.0::DOUBLE, least(640.0::DOUBLE, {v}))"
    return f"""WITH {BOX_SQL}, turned AS (SELECT *, CAST(page % 7 - 3 AS DOUBLE) AS a FROM box),
ends AS (SELECT page, {inside(f"least({', '.join(xs)})")} AS x0, {inside(f"greatest({', '.join(xs)})")} AS x1,
  {inside(f"least({', '.join(ys)})")} AS y0, {inside(f"greatest({', '.join(ys)})")} AS y1 FROM turned)
SELECT page, round(x0, 6) + 0.0::DOUBLE AS x, round(y0, 6) + 0.0::DOUBLE AS y, round(x1 - x0, 6) + 0.0::DOUBLE AS w, round(y1 - y0, 6) + 0.0::DOUBLE AS h FROM ends"""


ORACLE_SQL = {
    "box_expand": f"WITH {BOX_SQL}, {_EXPANDED} SELECT * FROM expanded",
    "box_clamp": f"WITH {BOX_SQL}, {_clamped('box')} SELECT * FROM clamped WHERE w > 0 AND h > 0",
    "box_normalize": f"WITH {BOX_SQL} {_NORMAL} box",
    "box_int_trunc": f"WITH {BOX_SQL}, {_EXPANDED} SELECT page, CAST(trunc(x) AS INTEGER) AS x, CAST(trunc(y) AS INTEGER) AS y, CAST(trunc(w) AS INTEGER) AS w, CAST(trunc(h) AS INTEGER) AS h FROM expanded",
    "box_pipeline": f"WITH {BOX_SQL}, {_EXPANDED}, {_clamped('expanded')} {_NORMAL} clamped WHERE w > 0 AND h > 0",
    "box_label_lines": f"WITH {BOX_SQL} SELECT page, {_LINE} AS line FROM box",
    "label_parse": f"WITH {_PARSED} SELECT name, line_no, 0 AS class, cx, cy, w, h FROM parsed",
    "label_to_corners": f"""WITH {_PARSED} SELECT name, line_no, cx * 640 - w * 640 / 2 AS x0, cy * 640 - h * 640 / 2 AS y0,
  cx * 640 + w * 640 / 2 AS x1, cy * 640 + h * 640 / 2 AS y1 FROM parsed""",
    "box_roundtrip_error": f"WITH {BOX_SQL} SELECT page, count(*) AS n, true AS close FROM box WHERE x >= 0 AND y >= 0 AND x + w <= 640 AND y + h <= 640 GROUP BY page",
    "rotate_box_hull": _hull(),
    "page_name": "SELECT o_orderkey, printf('page_%06d', o_orderkey * 97 - 300) AS name FROM orders",
    "pair_audit": """SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS has_image, b.name IS NOT NULL AS has_label
FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS name FROM orders) a FULL JOIN (SELECT DISTINCT CAST(l_orderkey * 2 AS VARCHAR) AS name FROM lineitem) b ON a.name = b.name""",
    "page_label_outer": f"""WITH {BOX_SQL}, lines AS (SELECT page, block_no, CAST(x AS INTEGER) AS box_no, {_LINE} AS line FROM box),
grouped AS (SELECT page, count(*) AS n, string_agg(line, chr(10) ORDER BY block_no, box_no, line) || chr(10) AS t FROM lines GROUP BY page)
SELECT o_orderkey AS page, CAST(coalesce(n, 0) AS BIGINT) AS n_boxes, coalesce(t, '') AS text FROM orders LEFT JOIN grouped ON o_orderkey = page""",
    "box_union_ordered": f"""WITH {BOX_SQL} SELECT page, count(*) AS n_boxes,
  string_agg(block_no || ':' || CAST(x AS INTEGER) || ':' || CAST(y AS INTEGER), ',' ORDER BY block_no, CAST(x AS INTEGER), CAST(y AS INTEGER)) AS boxes FROM box GROUP BY page""",
    "split_inventory": """WITH files AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split, 'images' AS kind FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'train', 'labels' FROM orders WHERE o_orderkey % 4 = 0),
wanted AS (SELECT split, kind FROM (VALUES ('train'), ('val')) a(split), (VALUES ('images'), ('labels')) b(kind))
SELECT w.split, w.kind, count(f.split) AS n FROM wanted w LEFT JOIN files f ON w.split = f.split AND w.kind = f.kind GROUP BY 1, 2""",
}
