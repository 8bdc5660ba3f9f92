"""Queries on frames and capture regions: events are key presses, users are sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.functions import regions
from inkplane.plans.tables import read
from inkplane.streaming import live

#: Our choice of key for each type of event.
KEYS = {"signup": "w", "purchase": "r", "error": "f", "view": "d", "click": "a"}
MONITOR = {"left": -100, "top": 50, "width": 2560, "height": 1440}


def monitor() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in MONITOR.items()])


def key_of(event_type: Column) -> Column:
    made = F.lit("-")
    for name, key in KEYS.items():
        made = F.when(event_type == name, key).otherwise(made)
    return made


def presses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), "event_id", "ts", key_of(F.col("event_type")).alias("key"))


def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per second at each frame of a session; the first has no time before it."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), "ts")
    rows = rows.withColumn("prev", F.lag("ts").over(Window.partitionBy("session").orderBy("ts", "event_id")))
    passed = F.coalesce(F.expr("timestampdiff(MICROSECOND, prev, ts)"), F.lit(0))
    return rows.select("event_id", "session", F.when(passed > 0, F.lit(1e6) / passed).otherwise(0.0).alias("rate"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last region of each session, of rows (session, key) sorted by session and time; nothing but the region is held."""
    done: list[tuple] = []
    session, region = None, ()
    for batch in batches:
        for s, key in zip(batch.column("session").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if s != session or not region:
                if region:
                    done.append((session, *region))
                session, region = s, live.initial(MONITOR)
            region = live.press(region, key, MONITOR)
        yield _regions(done)
        done = []
    yield _regions([(session, *region)] if region else [])


def _regions(rows: list[tuple]) -> pa.RecordBatch:
    names = ["session", "top", "left", "width", "height"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i else pa.int64()) for i in range(5)], names)


def region_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each session after all its keys: a fold over sorted rows, as the stream does it; a session of any length is one pass, never a list."""
    rows = presses(spark, sf_dir)
    ordered = rows.repartition("session").sortWithinPartitions("session", "ts", "event_id").select(F.col("session").cast("long").alias("session"), "key")
    return ordered.mapInArrow(_folded, "session long, top int, left int, width int, height int").withColumn("session", F.col("session").cast(rows.schema["session"].dataType))


def region_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each session up to the first purchase, which stands for the stop key; all frames where none comes."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.col("event_type") == "purchase")
    rows = e.toDF("session", "event_id", "stop")
    first = F.min(F.when(F.col("stop"), F.col("event_id"))).over(Window.partitionBy("session"))
    return rows.withColumn("first", first).filter(F.col("first").isNull() | (F.col("event_id") <= F.col("first"))).groupBy("session").agg(F.count("*").alias("frames"))


def region_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred regions on monitors of many sizes."""
    k = F.col("p_partkey")
    m = F.struct((k % 50 - 30).cast("int").alias("left"), (k % 70 - 20).cast("int").alias("top"), (k * 13 % 3000 + 200).cast("int").alias("width"), (k * 7 % 2000 + 150).cast("int").alias("height"))
    rows = read(spark, sf_dir, "part").select("p_partkey", regions.initial(m).alias("r"))
    return rows.select("p_partkey", "r.top", "r.left", "r.width", "r.height")


def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    r = regions.region(k * 11 % 3000 - 500, k * 17 % 4000 - 500, k * 19 % 4000, k * 23 % 3000)
    rows = read(spark, sf_dir, "part").select("p_partkey", regions.clip(r, monitor()).alias("r"))
    return rows.select("p_partkey", "r.top", "r.left", "r.width", "r.height")


def hud_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of a frame; the rate is shown with one decimal."""
    tenths = F.floor(F.col("value") * 4).cast("long")  # quarters, so that no decimal is a tie between two tenths
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("FPS: "), F.format_string("%.1f", tenths / F.lit(5.0)), F.lit(" | "), F.col("event_type")).alias("caption"))


QUERIES = {f.__name__: f for f in (frame_rate, region_walk, region_stop, region_initial, region_clip, hud_text)}

_KEY = "CASE event_type " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in KEYS.items()) + " ELSE '-' END"


def _clip_sql(m: dict, top: str, left: str, width: str, height: str) -> str:
    w, h = f"greatest(100, least({width}, {m['width']}))", f"greatest(100, least({height}, {m['height']}))"
    return (
        f"CAST(greatest({m['top']}, least({top}, {m['top']} + {m['height']} - {h})) AS INTEGER) AS top, CAST(greatest({m['left']}, least({left}, {m['left']} + {m['width']} - {w})) AS INTEGER) AS \"left\", "
        f"CAST({w} AS INTEGER) AS width, CAST({h} AS INTEGER) AS height"
    )


_FIXED = {k: str(v) for k, v in MONITOR.items()}
_CENTRE = {"w": min(1920, MONITOR["width"]), "h": min(1080, MONITOR["height"])}
_START = f"{MONITOR['top'] + (MONITOR['height'] - _CENTRE['h']) // 2} AS top, {MONITOR['left'] + (MONITOR['width'] - _CENTRE['w']) // 2} AS \"left\", {_CENTRE['w']} AS width, {_CENTRE['h']} AS height"


def _step(plus: str, minus: str, n: int) -> str:
    return f"CASE key WHEN '{plus}' THEN {n} WHEN '{minus}' THEN {-n} ELSE 0 END"


_MOVED = _clip_sql(_FIXED, f"w.top + {_step('s', 'w', 20)} + {_step('f', 'r', 25)}", f"w.\"left\" + {_step('d', 'a', 20)} + {_step('f', 'r', 25)}", f"w.width + {_step('r', 'f', 50)}", f"w.height + {_step('r', 'f', 50)}")

ORACLE_SQL = {
    "frame_rate": """WITH p AS (SELECT event_id, user_id AS session, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS d FROM events)
SELECT event_id, session, CASE WHEN d > 0 THEN 1e6::DOUBLE / d ELSE 0.0::DOUBLE END AS rate FROM p""",
    "region_walk": f"""WITH RECURSIVE k AS (SELECT user_id AS session, {_KEY} AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
last AS (SELECT session, max(n) AS n FROM k GROUP BY session),
w AS (SELECT DISTINCT session, 0::BIGINT AS n, {_START} FROM k
  UNION ALL SELECT w.session, k.n, {_MOVED} FROM w JOIN k ON k.session = w.session AND k.n = w.n + 1)
SELECT w.session, top, "left", width, height FROM w JOIN last ON w.session = last.session AND w.n = last.n""",
    "region_stop": """WITH s AS (SELECT user_id AS session, event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events)
SELECT session, count(*) AS frames FROM s WHERE f IS NULL OR event_id <= f GROUP BY session""",
    "region_initial": f"""WITH m AS (SELECT p_partkey, p_partkey % 50 - 30 AS l, p_partkey % 70 - 20 AS t, p_partkey * 13 % 3000 + 200 AS mw, p_partkey * 7 % 2000 + 150 AS mh FROM part),
c AS (SELECT *, least(1920, mw) AS cw, least(1080, mh) AS ch FROM m)
SELECT p_partkey, {_clip_sql({'left': 'l', 'top': 't', 'width': 'mw', 'height': 'mh'}, 't + (mh - ch) // 2', 'l + (mw - cw) // 2', 'cw', 'ch')} FROM c""",
    "region_clip": f"""SELECT p_partkey, {_clip_sql(_FIXED, '(p_partkey * 11 % 3000 - 500)', '(p_partkey * 17 % 4000 - 500)', 'p_partkey * 19 % 4000', 'p_partkey * 23 % 3000')} FROM part""",
    "hud_text": "SELECT event_id, 'FPS: ' || printf('%.1f', floor(value * 4) / 5.0::DOUBLE) || ' | ' || event_type AS caption FROM events",
}
