"""Profiles of a manifest: counts, exact quantiles, crosstab, missing values, duplicates, label shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.exprs import missing, number, stripped

QUANTILES = ("minimum", "q25", "median", "q75", "maximum")


def class_counts(manifest: DataFrame) -> DataFrame:
    return manifest.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


def value_counts(manifest: DataFrame, *columns: str) -> DataFrame:
    """column_name, value, n of stripped values that aren't missing; one pass for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = manifest.select(F.explode(pairs).alias("p")).select("p.*").where(~missing(F.col("value")))
    return rows.groupBy("column_name", stripped(F.col("value")).alias("value")).agg(F.count("*").alias("n"))


def quantiles(manifest: DataFrame, *columns: str) -> DataFrame:
    """column_name and the exact quantiles, interpolated; null where a column has no number."""
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    row = manifest.agg(*(F.percentile(number(F.col(c)), at).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("q")) for c in columns))
    return row.select(F.explode(pairs).alias("p")).select("p.column_name", *(F.get("p.q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)))


def label_crosstab(manifest: DataFrame, column: str = "file_format") -> DataFrame:
    """value, label_0, label_1; values that occur, zero-filled."""
    rows = manifest.where(~missing(F.col(column)) & F.col("label").isin(0, 1))
    return rows.groupBy(stripped(F.col(column)).alias("value")).agg(*(F.count_if(F.col("label") == k).alias(f"label_{k}") for k in (0, 1)))


def missing_counts(manifest: DataFrame, *expected: str) -> DataFrame:
    """column_name, n_missing for all columns; an expected column that isn't there misses in every row."""
    absent = [c for c in expected if c not in manifest.columns]
    row = manifest.agg(*(F.count_if(missing(F.col(c))).alias(c) for c in manifest.columns), *(F.count("*").alias(c) for c in absent))
    return row.unpivot([], list(row.columns), "column_name", "n_missing")


def duplicate_count(manifest: DataFrame, column: str = "content_checksum") -> DataFrame:
    """n_duplicates: rows beyond the first of each value that isn't missing."""
    value = F.when(~missing(F.col(column)), F.col(column))
    return manifest.agg((F.count(value) - F.count_distinct(value)).alias("n_duplicates"))


def label_shortcuts(manifest: DataFrame, *columns: str) -> DataFrame:
    """column_name, is_shortcut: every value has one label, and there are two values or more and both labels."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = manifest.where(F.col("label").isin(0, 1)).select("label", F.explode(pairs).alias("p")).select("label", "p.*")
    each = rows.where(~missing(F.col("value"))).groupBy("column_name", stripped(F.col("value")).alias("value")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    found = each.groupBy("column_name").agg((F.bool_and(F.col("lo") == F.col("hi")) & (F.count("*") >= 2) & (F.min("lo") == 0) & (F.max("hi") == 1)).alias("is_shortcut"))
    names = manifest.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("is_shortcut", F.lit(False)).alias("is_shortcut"))


def audit(manifest: DataFrame) -> dict[str, DataFrame]:
    """All sections, each a small table."""
    names = [c for c in ("dataset_name", "generator_family", "file_format", "licence_identifier") if c in manifest.columns]
    return {
        "class_counts": class_counts(manifest),
        "value_counts": value_counts(manifest, *names),
        "quantiles": quantiles(manifest, "width", "height"),
        "crosstab": label_crosstab(manifest),
        "missing": missing_counts(manifest, "content_checksum"),
        "duplicates": duplicate_count(manifest) if "content_checksum" in manifest.columns else manifest.limit(0).agg(F.lit(0).cast("long").alias("n_duplicates")),
        "shortcuts": label_shortcuts(manifest, *names),
    }
