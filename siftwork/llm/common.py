"""Helpers that the operators share: tables read from a dataset folder, text patterns, and tables written to cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.exprs import let
from siftwork.sources.shared import clear, scratch, shared_folder
from siftwork.sources.shared import materialized as written

__all__ = ["WORD_GAP", "clear", "let", "lower_ascii", "scratch", "shared_folder", "table", "word_count", "words", "written"]

#: The characters between words: space and the controls tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as long."""
    parts = F.size(F.split(text, WORD_GAP, -1))
    blank = lambda rule: text.rlike(rule).cast("int")
    n = parts - blank(r"\A[\x20\x09-\x0D]") - blank(r"[\x20\x09-\x0D]\z")
    only_gaps = text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(only_gaps, F.lit(0)).otherwise(n).cast("long")
