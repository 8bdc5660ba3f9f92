"""Fonts: catalogue, download by tasks, and the characters of their files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.sources import typefaces
from inkplane.sources.dictionary import fetch


def catalogue(spark: SparkSession, fonts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(fonts.items()), "font string, url string")


def download(fonts: DataFrame, folder: str, fetcher: Callable[[str], bytes] = fetch) -> DataFrame:
    """(font, status, detail) for each font: ``skipped`` if its file is there, ``downloaded`` or ``error``; no error stops the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for font, url in zip(frame["font"], frame["url"], strict=True):
                path = os.path.join(folder, f"{font}.ttf")
                if os.path.exists(path):
                    rows.append((font, "skipped", path))
                    continue
                try:
                    data = fetcher(url)
                    os.makedirs(folder, exist_ok=True)
                    with open(path + ".part", "wb") as f:
                        f.write(data)
                    os.replace(path + ".part", path)
                    rows.append((font, "downloaded", path))
                except Exception as error:  # reported, as one font must not stop the rest
                    rows.append((font, "error", str(error)))
            yield pd.DataFrame(rows, columns=["font", "status", "detail"])

    return fonts.mapInPandas(run, "font string, status string, detail string")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the folder's font files, not of folders below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ttf").load(folder).select("path", "content")


def glyphs(font_files: DataFrame) -> DataFrame:
    """(font, codepoint) of font files (path, content)."""
    return typefaces.characters(named(font_files))


def named(font_files: DataFrame) -> DataFrame:
    """(font, content): files by their names."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.ttf$", "")
    return font_files.select(name.alias("font"), "content")
