"""Queries on page planning: splits, attempts, samples, blocks, cells and ink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.functions import boxes, draws, regions
from inkplane.functions.text import page_name
from inkplane.operators import layout, numbering
from inkplane.params import Settings
from inkplane.plans.box_queries import box_sql_inside
from inkplane.plans.tables import BOX_KEY, box_table, read, u_sql

S = Settings()


def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform, whole, real and yes-or-no draws."""
    u = draws.uniform(1, "draw", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", u.alias("u"), draws.whole(u, 24, 48).alias("size"), draws.real(u, 0.1, 2.5).alias("sigma"), draws.happens(u, 0.2).alias("negative")
    )


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = numbering.split_sizes(F.col("n"), S.val_ratio)
    counted = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("set_name")).agg(F.count("*").alias("n"))
    return counted.select("set_name", "n", sizes["n_train"].alias("n_train"), sizes["n_val"].alias("n_val"))


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training indices first, then those of validation: two disjoint ranges."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt"))
    total = o.agg(F.count("*").alias("n")).select(numbering.split_sizes(F.col("n"), S.val_ratio)["n_train"].alias("n_train"))
    rows = numbering.dense(o, "attempt").join(F.broadcast(total))
    return rows.select("attempt", "idx", F.when(F.col("idx") < F.col("n_train"), "train").otherwise("val").alias("split"))


def attempt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The successful attempts that become pages, numbered without gaps from 7."""
    o = read(spark, sf_dir, "orders")
    attempts = o.select((F.col("o_orderkey") + 1).alias("attempt"), draws.happens(draws.uniform(2, "ok", "o_orderkey"), 0.7).alias("ok"))
    amount = o.agg(F.floor(F.count("*") / 25).alias("amount"))
    kept = attempts.join(F.broadcast(amount))
    return numbering.successes(kept, F.col("amount"), 7).select("attempt", "idx")


def dataset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From attempts to the pages of both splits: negatives, pages with boxes inside the page, the first of them by attempt, numbered and named.

    Orders are attempts, even ones for training; their line items are boxes, of which some are drawn.
    """
    o = read(spark, sf_dir, "orders")
    boxed = box_table(spark, sf_dir, draws.happens(draws.uniform(52, "kept", *BOX_KEY), 0.15))
    inside = boxes.has_area(boxes.clamp(boxes.expand(F.col("box"), S.crop_size, S.box_margin), S.crop_size, S.crop_size))
    found = boxed.filter(inside).groupBy("page").agg(F.count("*").alias("n"))
    sizes = o.agg(F.floor(F.count("*") / 25).alias("amount")).select(numbering.split_sizes(F.col("amount"), S.val_ratio).alias("n"))
    attempts = o.select((F.col("o_orderkey") + 1).alias("attempt"), F.col("o_orderkey").alias("page"), draws.happens(draws.uniform(51, "negative", "o_orderkey"), S.negative_probability).alias("negative"))
    attempts = attempts.join(found, "page", "left").withColumn("n_boxes", F.when(F.col("negative"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long"))
    attempts = attempts.withColumn("ok", F.col("negative") | (F.col("n_boxes") > 0)).drop("n").crossJoin(F.broadcast(sizes))
    made = []
    for split, parity, amount, start in (("train", 0, F.col("n.n_train"), F.lit(0)), ("val", 1, F.col("n.n_val"), F.col("n.n_train"))):
        kept = numbering.successes(attempts.filter(F.col("page") % 2 == parity), amount, start)
        made.append(kept.select(F.lit(split).alias("split"), "idx", page_name(F.col("idx")).alias("name"), "negative", "n_boxes"))
    return made[0].unionByName(made[1])


def yield_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages wanted and made, by set."""
    o = read(spark, sf_dir, "orders")
    made = draws.happens(draws.uniform(3, "made", "o_orderkey"), 0.9)
    return o.groupBy(F.col("o_orderstatus").alias("set_name")).agg(F.count("*").alias("wanted"), F.sum(made.cast("long")).alias("made"))


def empty_pages_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the number of their boxes; pages without any are dropped."""
    li = read(spark, sf_dir, "lineitem")
    kept = draws.happens(draws.uniform(4, "box", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 0.4)
    return li.groupBy(F.col("l_orderkey").alias("page")).agg(F.sum(kept.cast("long")).alias("n_boxes")).filter("n_boxes > 0")


def first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place whose region is even enough, among the tries allowed; blocks without one are absent."""
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("attempt"), F.col("l_quantity").alias("deviation"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")
    )
    even = F.col("deviation") <= S.region_deviation_limit
    return numbering.first_accepted(li, "block", "attempt", even, 5, ["x", "y"])


def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return counted.select("n_regionkey", F.least(F.lit(4).cast("long"), "n").alias("taken"))


def sample_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents drawn by hash, numbered from 1."""
    return numbering.sample(read(spark, sf_dir, "documents").select("doc_id"), 5, 11, "doc_id").select("doc_id", F.col("sample_no").cast("int").alias("sample_no"))


def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part for each order, drawn with replacement: a join on the number drawn."""
    o, p = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return numbering.draw_with_replacement(o, p, 12, "o_orderkey", "p_partkey").select("o_orderkey", "p_partkey", "p_name")


def page_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages at least as large as a crop."""
    w, h = (F.col("p_size") * 40).cast("int"), (F.col("p_partkey") * 37 % 1000 + 300).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height")).filter((F.col("width") >= S.crop_size) & (F.col("height") >= S.crop_size))


def eligible_page_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large enough page and a crop corner for each order."""
    picked = numbering.draw_with_replacement(read(spark, sf_dir, "orders").select("o_orderkey"), page_min_size(spark, sf_dir), 13, "o_orderkey", "p_partkey")
    left = draws.whole(draws.uniform(13, "left", "o_orderkey"), 0, F.col("width") - S.crop_size)
    top = draws.whole(draws.uniform(13, "top", "o_orderkey"), 0, F.col("height") - S.crop_size)
    return picked.select("o_orderkey", "p_partkey", left.alias("left"), top.alias("top"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 2 == 0, layout.VERTICAL).otherwise(layout.HORIZONTAL).alias("direction"), (k % 5 + 2).cast("int").alias("columns"), (k % 11 + 6).cast("int").alias("chars"),
        (F.col("p_size") % 24 + 24).cast("int").alias("cell_w"), (F.col("p_size") % 20 + 26).cast("int").alias("cell_h"), (k % 5 + 2).cast("int").alias("char_gap"), (k % 7 + 4).cast("int").alias("column_gap"),
        (k % 100).cast("int").alias("start_x"), (k % 90).cast("int").alias("start_y"),
    )
    size = layout.block_size(*[F.col(c) for c in ("direction", "columns", "chars", "cell_w", "cell_h", "char_gap", "column_gap")])
    return rows.withColumn("_size", size).select("*", "_size.bw", "_size.bh").drop("_size")


def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("p_partkey", "direction", "bw", "bh")


def block_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).filter(layout.fits(F.col("bw"), F.col("bh"), S.crop_size)).select("p_partkey", "bw", "bh")


def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cells(_blocks(spark, sf_dir)).select("p_partkey", "column_no", "char_no", "cell_x", "cell_y")


def ink_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink by the brightness of the ground, and the stroke that goes with it."""
    brightness = F.pmod(F.col("c_acctbal"), F.lit(256.0))
    u = [draws.uniform(14, p, "c_custkey") for p in ("side", "dark", "light")]
    rows = read(spark, sf_dir, "customer").select("c_custkey", regions.ink(brightness, *u).cast("int").alias("ink"))
    return rows.select("c_custkey", "ink", regions.stroke(F.col("ink")).cast("int").alias("stroke"))


QUERIES = {
    f.__name__: f
    for f in (
        uniform_draws, split_sizes, split_assign, attempt_index, dataset_plan, yield_report, empty_pages_dropped, first_position, sample_size, sample_without_replacement,
        sample_with_replacement, page_min_size, eligible_page_pick, block_layout, block_fit, cell_grid, ink_colour,
    )
}

_PAGES = "pages_large AS (SELECT * FROM (SELECT p_partkey, CAST(p_size * 40 AS INTEGER) AS width, CAST(p_partkey * 37 % 1000 + 300 AS INTEGER) AS height FROM part) WHERE width >= 640 AND height >= 640)"
_BLOCKS = """blocks AS (
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS direction, p_partkey % 5 + 2 AS columns_n, p_partkey % 11 + 6 AS chars,
    p_size % 24 + 24 AS cell_w, p_size % 20 + 26 AS cell_h, p_partkey % 5 + 2 AS char_gap, p_partkey % 7 + 4 AS column_gap, p_partkey % 100 AS sx, p_partkey % 90 AS sy FROM part),
sized AS (SELECT *, CAST(CASE WHEN direction = 'vertical' THEN columns_n * (cell_w + column_gap) ELSE chars * (cell_w + char_gap) END AS INTEGER) AS bw,
  CAST(CASE WHEN direction = 'vertical' THEN chars * (cell_h + char_gap) ELSE columns_n * (cell_h + column_gap) END AS INTEGER) AS bh FROM blocks)"""
_U = u_sql(1, "draw", "o_orderkey")


def _draw(seed: int, purpose: str, key: str, low: str, high: str) -> str:
    return f"CAST({low} + floor({u_sql(seed, purpose, key)} * CAST({high} - {low} + 1 AS DOUBLE)) AS INTEGER)"


ORACLE_SQL = {
    "uniform_draws": f"""SELECT o_orderkey, {_U} AS u, CAST(24 + floor({_U} * 25.0::DOUBLE) AS INTEGER) AS size, 0.1::DOUBLE + {_U} * (2.5::DOUBLE - 0.1::DOUBLE) AS sigma,
  {_U} < 0.2::DOUBLE AS negative FROM orders""",
    "split_sizes": """WITH c AS (SELECT o_orderpriority AS set_name, count(*) AS n FROM orders GROUP BY 1),
v AS (SELECT *, greatest(1, CAST(floor(CAST(n AS DOUBLE) * 0.15::DOUBLE) AS BIGINT)) AS n_val FROM c) SELECT set_name, n, CAST(n - n_val AS BIGINT) AS n_train, CAST(n_val AS BIGINT) AS n_val FROM v""",
    "split_assign": """WITH t AS (SELECT count(*) - greatest(1, CAST(floor(CAST(count(*) AS DOUBLE) * 0.15::DOUBLE) AS BIGINT)) AS n_train FROM orders),
r AS (SELECT o_orderkey AS attempt, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) SELECT attempt, CAST(idx AS BIGINT) AS idx, CASE WHEN idx < n_train THEN 'train' ELSE 'val' END AS split FROM r, t""",
    "attempt_index": f"""WITH a AS (SELECT CAST(floor(count(*) / 25.0) AS BIGINT) AS amount FROM orders),
fine AS (SELECT o_orderkey + 1 AS attempt, amount FROM orders, a WHERE {u_sql(2, 'ok', 'o_orderkey')} < 0.7::DOUBLE AND o_orderkey + 1 <= amount * 20),
r AS (SELECT attempt, amount, row_number() OVER (ORDER BY attempt) - 1 AS idx FROM fine) SELECT attempt, CAST(idx + 7 AS BIGINT) AS idx FROM r WHERE idx < amount""",
    "dataset_plan": f"""WITH {box_sql_inside(u_sql(52, 'kept', *BOX_KEY) + ' < 0.15::DOUBLE')}, found AS (SELECT page, count(*) AS n FROM inside GROUP BY page),
sizes AS (SELECT greatest(1, CAST(floor(amount * 0.15::DOUBLE) AS BIGINT)) AS n_val, amount - greatest(1, CAST(floor(amount * 0.15::DOUBLE) AS BIGINT)) AS n_train FROM (SELECT CAST(floor(count(*) / 25.0) AS BIGINT) AS amount FROM orders)),
tried AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split, o_orderkey + 1 AS attempt, {u_sql(51, 'negative', 'o_orderkey')} < 0.2::DOUBLE AS negative, coalesce(n, 0) AS n
  FROM orders LEFT JOIN found ON page = o_orderkey),
good AS (
  SELECT *, CASE WHEN split = 'train' THEN n_train ELSE n_val END AS amount, CASE WHEN split = 'train' THEN 0 ELSE n_train END AS start FROM tried, sizes WHERE negative OR n > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY attempt) - 1 AS k FROM good WHERE attempt <= amount * 20)
SELECT split, CAST(k + start AS BIGINT) AS idx, printf('page_%06d', k + start) AS name, negative, CAST(CASE WHEN negative THEN 0 ELSE n END AS BIGINT) AS n_boxes FROM numbered WHERE k < amount""",
    "yield_report": f"""SELECT o_orderstatus AS set_name, count(*) AS wanted, CAST(sum(CASE WHEN {u_sql(3, 'made', 'o_orderkey')} < 0.9::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS made FROM orders GROUP BY 1""",
    "empty_pages_dropped": f"""SELECT l_orderkey AS page, CAST(sum(CASE WHEN {u_sql(4, 'box', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} < 0.4::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS n_boxes
FROM lineitem GROUP BY 1 HAVING n_boxes > 0""",
    "first_position": """SELECT block, attempt, x, y FROM (
  SELECT l_orderkey AS block, l_linenumber AS attempt, l_partkey AS x, l_suppkey AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r
  FROM lineitem WHERE l_quantity <= 25 AND l_linenumber <= 5) WHERE r = 1""",
    "sample_size": "SELECT n_regionkey, least(4, count(*)) AS taken FROM nation GROUP BY 1",
    "sample_without_replacement": f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY u, doc_id) AS INTEGER) AS sample_no FROM (
  SELECT doc_id, {u_sql(11, 'sample', 'doc_id')} AS u FROM documents ORDER BY u, doc_id LIMIT 5)""",
    "sample_with_replacement": f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pick FROM part)
SELECT o_orderkey, p_partkey, p_name FROM (SELECT o_orderkey, CAST(floor({u_sql(12, 'pick', 'o_orderkey')} * (SELECT count(*) FROM part)) AS BIGINT) AS pick FROM orders) o JOIN n USING (pick)""",
    "page_min_size": f"WITH {_PAGES} SELECT p_partkey, width, height FROM pages_large",
    "eligible_page_pick": f"""WITH {_PAGES}, n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pick FROM pages_large)
SELECT o_orderkey, p_partkey, {_draw(13, 'left', 'o_orderkey', '0', '(width - 640)')} AS "left", {_draw(13, 'top', 'o_orderkey', '0', '(height - 640)')} AS top
FROM (SELECT o_orderkey, CAST(floor({u_sql(13, 'pick', 'o_orderkey')} * (SELECT count(*) FROM pages_large)) AS BIGINT) AS pick FROM orders) o JOIN n USING (pick)""",
    "block_layout": f"WITH {_BLOCKS} SELECT p_partkey, direction, bw, bh FROM sized",
    "block_fit": f"WITH {_BLOCKS} SELECT p_partkey, bw, bh FROM sized WHERE 640 - bw > 0 AND 640 - bh > 0",
    "cell_grid": f"""WITH {_BLOCKS} SELECT p_partkey, CAST(c AS INTEGER) AS column_no, CAST(k AS INTEGER) AS char_no,
  CAST(sx + CASE WHEN direction = 'vertical' THEN c * (cell_w + column_gap) ELSE k * (cell_w + char_gap) END AS INTEGER) AS cell_x,
  CAST(sy + CASE WHEN direction = 'vertical' THEN k * (cell_h + char_gap) ELSE c * (cell_h + column_gap) END AS INTEGER) AS cell_y
FROM blocks, unnest(range(columns_n)) a(c), unnest(range(chars)) b(k)""",
    "ink_colour": f"""WITH b AS (SELECT c_custkey, c_acctbal - 256.0::DOUBLE * floor(c_acctbal / 256.0::DOUBLE) AS v, CAST(floor({u_sql(14, 'dark', 'c_custkey')} * 41) AS INTEGER) AS dark,
  CAST(215 + floor({u_sql(14, 'light', 'c_custkey')} * 41) AS INTEGER) AS light, {u_sql(14, 'side', 'c_custkey')} AS u FROM customer),
i AS (SELECT c_custkey, CASE WHEN v > 180 THEN dark WHEN v < 80 THEN light WHEN u < 0.5 THEN dark ELSE light END AS ink FROM b)
SELECT c_custkey, ink, CASE WHEN ink < 128 THEN 255 ELSE 0 END AS stroke FROM i""",
}
