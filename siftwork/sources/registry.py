"""Dimension tables: robustness conditions, stress conditions, families and splits. Fixed values, in natural order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SPLITS = ("train", "validation", "test", "generator_validation", "generator_test")


class Condition(NamedTuple):
    condition_id: str
    family: str
    severity: float
    parameters: dict[str, str]


FAMILIES = {"jpeg": "JPEG", "blur": "Blur", "resize": "Resize", "noise": "Noise", "color_jitter": "Color jitter", "center_crop": "Center crop"}

CONDITIONS = (
    Condition("jpeg_q90", "jpeg", 90.0, {"quality": "90", "subsampling": "2"}),
    Condition("jpeg_q70", "jpeg", 70.0, {"quality": "70", "subsampling": "2"}),
    Condition("jpeg_q50", "jpeg", 50.0, {"quality": "50", "subsampling": "2"}),
    Condition("jpeg_q30", "jpeg", 30.0, {"quality": "30", "subsampling": "2"}),
    Condition("blur_s0.5", "blur", 0.5, {"sigma": "0.5"}),
    Condition("blur_s1.0", "blur", 1.0, {"sigma": "1.0"}),
    Condition("blur_s2.0", "blur", 2.0, {"sigma": "2.0"}),
    Condition("resize_x0.5", "resize", 0.5, {"scale": "0.5"}),
    Condition("resize_x0.25", "resize", 0.25, {"scale": "0.25"}),
    Condition("noise_s0.02", "noise", 0.02, {"sigma": "0.02"}),
    Condition("noise_s0.05", "noise", 0.05, {"sigma": "0.05"}),
    Condition("noise_s0.10", "noise", 0.10, {"sigma": "0.10"}),
    Condition("color_jitter_20", "color_jitter", 0.20, {"magnitude": "0.20"}),
    Condition("center_crop_80", "center_crop", 0.80, {"fraction": "0.80"}),
)

STRESS = (
    Condition("webp_q80", "stress", 80.0, {"codec": "webp", "quality": "80"}),
    Condition("webp_q50", "stress", 50.0, {"codec": "webp", "quality": "50"}),
    Condition("screenshot_1440", "stress", 1440.0, {"canvas_width": "1440", "canvas_height": "900", "interpolation": "bicubic"}),
    Condition("screenshot_1080", "stress", 1080.0, {"canvas_width": "1080", "canvas_height": "675", "interpolation": "bicubic"}),
)

_SCHEMA = "condition_id string, family string, severity double, parameters map<string,string>"


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(c) for c in CONDITIONS], _SCHEMA)


def stress_conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(c) for c in STRESS], _SCHEMA)


def condition(condition_id: str) -> Condition:
    for c in CONDITIONS:
        if c.condition_id == condition_id:
            return c
    raise KeyError(condition_id)
