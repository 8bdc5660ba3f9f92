"""The kanji dictionary: a JSON object of characters, read by Spark, fetched once where it is absent."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.operators import charset

TIMEOUT = 30


def fetch(url: str) -> bytes:
    with urlopen(url, timeout=TIMEOUT) as answer:
        return answer.read()


def ensure(path: str, url: str, fetcher: Callable[[str], bytes] = fetch) -> str:
    """The local path, filled from the URL if it doesn't exist. A failed fetch raises."""
    if not os.path.exists(path):
        data = json.loads(fetcher(url).decode("utf-8"))
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(data, f, ensure_ascii=False, indent=4)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(kanji, jlpt_new); the level is null where it is missing or null."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<jlpt_new: int>>")
    return whole.select(F.explode(entries).alias("kanji", "e")).select("kanji", F.col("e.jlpt_new").alias("jlpt_new"))


def kanji(spark: SparkSession, path: str, level: str = "") -> DataFrame:
    """Characters of a level, all for the empty name."""
    return charset.of_level(read(spark, path), level).select("kanji")
