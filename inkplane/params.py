"""Settings of page synthesis, training and display, with overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

PREFIX = "KD_"


@dataclass(frozen=True)
class Settings:
    """Defaults (but for names of project and dataset, which are free). ``ENVIRONMENT`` names the variable that overrides each."""

    val_ratio: float = 0.15
    crop_size: int = 640
    pages_amount: int = 20
    char_gap: int = 4
    column_gap: int = 8
    region_deviation_limit: int = 25
    position_tries: int = 10
    box_margin: float = 0.10
    model_file: str = "yolo26n.pt"
    epochs: int = 50
    image_size: int = 640
    batch: int = 16
    hosted_workers: int = 2
    local_workers: int = 4
    project_name: str = "detector"
    hosted_dataset: str = "detector-dataset"
    negative_probability: float = 0.20
    blocks_min: int = 3
    blocks_max: int = 8
    columns_min: int = 2
    columns_max: int = 6
    chars_min: int = 6
    chars_max: int = 16
    blur_probability: float = 0.50
    blur_sigma_min: float = 0.1
    blur_sigma_max: float = 2.5
    morph_probability: float = 0.40
    morph_kernel_min: int = 2
    morph_kernel_max: int = 4
    morph_rounds_min: int = 1
    morph_rounds_max: int = 3
    noise_probability: float = 0.60
    noise_std_min: float = 0.01
    noise_std_max: float = 0.25
    rotation_probability: float = 0.40
    rotation_max: float = 3.0


#: What users set today.
ENVIRONMENT = {
    "val_ratio": "VAL_RATIO",
    "crop_size": "CROP_SIZE",
    "pages_amount": "PAGES_AMOUNT",
    "char_gap": "GAP_CHAR",
    "column_gap": "GAP_COL",
    "region_deviation_limit": "LIMITE_DESVIO",
    "position_tries": "MAX_TENTATIVAS",
    "box_margin": "BBOX_MARGEM",
    "model_file": "YOLO_MODEL",
    "epochs": "EPOCHS",
    "image_size": "IMGSZ",
    "batch": "BATCH",
    "hosted_workers": "KAGGLE_WORKERS",
    "local_workers": "LOCAL_WORKERS",
    "project_name": "PROJECT_NAME",
    "hosted_dataset": "KAGGLE_DATASET",
    "negative_probability": "PROB_NEGATIVA",
    "blocks_min": "N_BLOCOS_MIN",
    "blocks_max": "N_BLOCOS_MAX",
    "columns_min": "N_COLUNAS_MIN",
    "columns_max": "N_COLUNAS_MAX",
    "chars_min": "CHARS_POR_COLUNA_MIN",
    "chars_max": "CHARS_POR_COLUNA_MAX",
    "blur_probability": "BLUR_PROB",
    "blur_sigma_min": "BLUR_SIGMA_MIN",
    "blur_sigma_max": "BLUR_SIGMA_MAX",
    "morph_probability": "MORFO_PROB",
    "morph_kernel_min": "MORFO_K_MIN",
    "morph_kernel_max": "MORFO_K_MAX",
    "morph_rounds_min": "MORFO_ITER_MIN",
    "morph_rounds_max": "MORFO_ITER_MAX",
    "noise_probability": "RUIDO_PROB",
    "noise_std_min": "RUIDO_STD_MIN",
    "noise_std_max": "RUIDO_STD_MAX",
    "rotation_probability": "ROTACAO_PROB",
    "rotation_max": "ROTACAO_MAX",
}


def parse(raw: str, like: object) -> object:
    """``raw`` as the type of ``like``; what doesn't parse raises. Booleans are true for 1, true and yes."""
    if isinstance(like, bool):
        return raw.lower() in ("1", "true", "yes")
    return type(like)(raw)


def load(environment: Mapping[str, str] | None = None) -> Settings:
    """Defaults, replaced where the environment has a value; an empty value counts as present."""
    env = os.environ if environment is None else environment
    found = {f.name: parse(env[PREFIX + ENVIRONMENT[f.name]], f.default) for f in fields(Settings) if PREFIX + ENVIRONMENT[f.name] in env}
    return replace(Settings(), **found)


def overrides(settings: Settings) -> dict[str, str]:
    """The environment that makes ``load`` return ``settings``."""
    return {PREFIX + ENVIRONMENT[f.name]: str(getattr(settings, f.name)) for f in fields(Settings)}


def as_row(spark: SparkSession, settings: Settings) -> DataFrame:
    """One row with all settings."""
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join(f"{f.name} {kinds[type(f.default)]}" for f in fields(Settings))
    return spark.createDataFrame([tuple(getattr(settings, f.name) for f in fields(Settings))], schema)


def hosted(mount: str, markers: tuple[str, ...], environment: Mapping[str, str] | None = None) -> bool:
    """Whether this runs on a notebook host: its mount exists, or its environment has one of the markers."""
    env = os.environ if environment is None else environment
    return os.path.exists(mount) or any(m in env for m in markers)
