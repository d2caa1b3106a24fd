"""Sources: manifests in Parquet, row streams, pair lists, folder trees of images; validation and union."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.errors import DataIntegrityError
from siftwork.functions import png
from siftwork.functions.exprs import missing, normalized_filename_value, safe_relative_path
from siftwork.operators import checks
from siftwork.operators.images import png_facts
from siftwork.sources.shared import materialized, scratch

MANIFEST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("sample_id", "path")]
    + [T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("dataset_name", "dataset_version", "generator_family", "source_group_id", "original_image_id")]
    + [T.StructField(c, T.IntegerType()) for c in ("width", "height")]
    + [T.StructField(c, T.StringType()) for c in ("file_format", "licence_identifier", "content_checksum", "perceptual_hash", "split")]
)
MANIFEST_COLUMNS = MANIFEST_SCHEMA.names

IMAGE_SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")

#: A source: (spark) -> rows of the manifest's schema.
Source = Callable[[SparkSession], DataFrame]


def canonical(df: DataFrame) -> DataFrame:
    """The manifest's columns in order, absent ones empty, extra ones refused."""
    extra = set(df.columns) - set(MANIFEST_COLUMNS)
    if extra:
        raise DataIntegrityError(f"unknown manifest columns: {', '.join(sorted(extra))}")
    default = {"content_checksum": F.lit(""), "perceptual_hash": F.lit(""), "split": F.lit("unassigned")}
    return df.select(*((F.col(f.name) if f.name in df.columns else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in MANIFEST_SCHEMA))


def parquet_manifest(path: str, dataset_name: str | None = None) -> Source:
    def scan(spark: SparkSession) -> DataFrame:
        rows = canonical(spark.read.parquet(path))
        if dataset_name is not None:
            checks.enforce(rows.where(~F.col("dataset_name").eqNullSafe(F.lit(dataset_name))).select("sample_id", "dataset_name"), what="rows of another dataset")
        return rows

    return scan


def rooted_manifest(path: str, root: str, dataset_name: str) -> Source:
    """As ``parquet_manifest``, with every path relative, free of steps up, and put under ``root``."""

    def scan(spark: SparkSession) -> DataFrame:
        rows = parquet_manifest(path, dataset_name)(spark)
        checks.enforce(rows.where(~safe_relative_path(F.col("path"))).select("sample_id", "path"), what="paths outside the root")
        return rows.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))

    return scan


def labelled_rows(rows: DataFrame, dataset_name: str, version: str = "v1", id_field: str = "img_id", label_field: str = "label") -> DataFrame:
    """Rows of labels 0, 1, 2 as a manifest: 2 (tampered) is left out, any other label is an error."""
    checks.enforce(rows.where(F.col(label_field).isNull() | ~F.col(label_field).isin(0, 1, 2)).select(id_field, label_field), what="labels outside 0, 1, 2")
    kept = rows.where(F.col(label_field) != 2)
    identity = F.col(id_field).cast("string")
    get = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)
    return canonical(kept.select(
        F.concat(F.lit(f"{dataset_name}:"), identity).alias("sample_id"), F.concat(F.lit("images/"), identity).alias("path"), F.col(label_field).cast("int").alias("label"),
        F.lit(dataset_name).alias("dataset_name"), F.lit(version).alias("dataset_version"), F.when(F.col(label_field) == 0, "authentic").otherwise("fully_synthetic").alias("generator_family"),
        identity.alias("source_group_id"), identity.alias("original_image_id"), get("width", 1).alias("width"), get("height", 1).alias("height"), get("file_format", "unknown").alias("file_format"), F.lit("unknown").alias("licence_identifier"),
    ))


def _folded_name(name: Column) -> Column:
    """Compatibility decomposition isn't a built-in function: an Arrow function over batches."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(normalized_filename_value, na_action="ignore")

    return F.pandas_udf(fold, "string")(name)


def resolve_names(wanted: DataFrame, files: DataFrame, key: str, name: str = "name") -> DataFrame:
    """``wanted`` with the file's ``name`` and whether it matched exactly; else by letters and digits of the folded name. None: null.

    A folded name that several files share is an error if any row needs it.
    """
    fold = _folded_name
    exact = files.select(F.col(name), F.col(name).alias("__n")).distinct()
    folded = files.select(F.col(name), fold(F.col(name)).alias("__f")).distinct().groupBy("__f").agg(F.min(name).alias("__near"), F.count("*").alias("__k"))
    joined = wanted.join(exact, F.col(key) == F.col("__n"), "left").withColumn("__key", fold(F.col(key))).join(folded, F.col("__key") == F.col("__f"), "left")
    found = joined.withColumn("exact", F.col("__n").isNotNull())
    ambiguous = F.when(~F.col("exact") & (F.col("__k") > 1), F.raise_error(F.concat(F.lit("ambiguous file name: "), F.col(key)))).otherwise(F.coalesce(name, "__near"))
    return found.withColumn(name, ambiguous).drop("__n", "__f", "__near", "__k", "__key")


#: First bytes, in hex, of the formats of ``IMAGE_SUFFIXES``: PNG, JPEG, GIF, BMP, TIFF and BigTIFF, WebP.
SIGNATURES = r"^(?:89504E470D0A1A0A|FFD8FF|474946383[79]61|424D|49492[AB]00|4D4D002[AB]|52494646.{8}57454250)"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative, ``/`` between parts), suffix, length, content_checksum, width, height, perceptual_hash of all image files under a folder; suffixes without regard to case.

    The checksum is the SHA-256 of the file's bytes, null for a file that is empty, doesn't begin as an
    image of any known format, or begins as PNG and can't be decoded. Sizes and hashes are those of PNG
    files; other formats have no codec here, so their sizes are null and their hashes empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = spark.createDataFrame([(unquote(re.sub("^([^:/]+:)//(?=/)", r"\1", f)),) for f in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti")  # the scan skips files without bytes, the listing doesn't
    rows = files.select("path", "length", "content").unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    relative = F.regexp_replace("path", "^.*?" + folder.strip("/").replace(".", r"\.") + "/", "")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    images = rows.where(suffix.isin(*IMAGE_SUFFIXES)).withColumn("head", F.hex(F.substring("content", 1, 12)))
    is_png = F.col("head").startswith(png.SIGNATURE.hex().upper())
    seen = images.withColumn("seen", png_facts(F.when(is_png, F.col("content"))))
    checksum = F.when(F.col("head").rlike(SIGNATURES) & (~is_png | F.col("seen.width").isNotNull()), F.sha2("content", 256))
    return seen.select(relative.alias("path"), suffix.alias("suffix"), "length", checksum.alias("content_checksum"), "seen.width", "seen.height", F.coalesce("seen.perceptual_hash", F.lit("")).alias("perceptual_hash"))


def _tree(spark: SparkSession, root: str, label: Column, family: Column, dataset_name: str) -> DataFrame:
    rows = image_files(spark, root).withColumn("label", label).withColumn("family", family).where("label is not null")
    seen = {r["label"] for r in rows.select("label").distinct().collect()}
    if seen != {0, 1}:
        raise DataIntegrityError(f"{root} lacks images of label {sorted({0, 1} - seen)}")
    identity = F.regexp_replace("path", r"\.[^./]+$", "")
    return canonical(rows.select(
        F.concat(F.lit(f"{dataset_name}:"), identity).alias("sample_id"), "path", "label", F.lit(dataset_name).alias("dataset_name"), F.lit("local").alias("dataset_version"), F.col("family").alias("generator_family"),
        identity.alias("source_group_id"), identity.alias("original_image_id"), F.col("suffix").alias("file_format"), F.lit("unknown").alias("licence_identifier"), "content_checksum", "width", "height", "perceptual_hash",
    ))


def nested_tree(root: str, dataset_name: str, real: str = "real", fake: str = "fake") -> Source:
    """``real/...`` and ``fake/<family>/...``: label and family from the path."""
    top, second = F.lower(F.element_at(F.split("path", "/"), 1)), F.element_at(F.split("path", "/"), 2)
    return lambda spark: _tree(spark, root, F.when(top == real, 0).when(top == fake, 1), F.when(top == real, "authentic").otherwise(second), dataset_name)


def flat_tree(root: str, dataset_name: str, real: str = "REAL", fake: str = "FAKE", family: str = "synthetic") -> Source:
    """Two folders, one for each label."""
    top = F.element_at(F.split("path", "/"), 1)
    return lambda spark: _tree(spark, root, F.when(top == real, 0).when(top == fake, 1), F.when(top == real, "authentic").otherwise(F.lit(family)), dataset_name)


def pair_list(csv_path: str, folder: str, dataset_name: str, family: str = "synthetic") -> Source:
    """A CSV with columns real and fake: two rows for each pair, which share a group; names resolved against the folder."""

    def scan(spark: SparkSession) -> DataFrame:
        pairs = spark.read.option("header", True).option("encoding", "UTF-8").csv(csv_path)
        pairs = pairs.toDF(*(c.lstrip("﻿") for c in pairs.columns))
        checks.require_columns(pairs, "real", "fake", where=csv_path)
        checks.enforce(pairs.where(missing(F.col("real")) | missing(F.col("fake"))).select("real", "fake"), what="pairs with a blank name")
        sides = pairs.select("real", "fake", F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col("real").alias("wanted")), F.struct(F.lit(1).alias("label"), F.col("fake").alias("wanted")))).alias("s")).select("real", "s.*")
        checks.enforce(checks.repeated_keys(sides, "wanted").select("wanted"), what="files in two pairs")
        files = image_files(spark, folder).select(F.col("path").alias("name"), "content_checksum", "width", "height", "perceptual_hash")
        found = resolve_names(sides, files, "wanted").join(files, "name", "left")
        checks.enforce(found.where("name is null").select("wanted"), what="files that aren't there")
        return canonical(found.select(
            F.concat(F.lit(f"{dataset_name}:"), F.col("name")).alias("sample_id"), F.col("name").alias("path"), "label", F.lit(dataset_name).alias("dataset_name"), F.lit("local").alias("dataset_version"), F.when(F.col("label") == 0, "authentic").otherwise(F.lit(family)).alias("generator_family"),
            F.concat(F.lit(f"{dataset_name}:"), F.col("real")).alias("source_group_id"), F.col("name").alias("original_image_id"), F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1)).alias("file_format"), F.lit("unknown").alias("licence_identifier"), "content_checksum", "width", "height", "perceptual_hash",
        ))

    return scan


def build_manifest(spark: SparkSession, sources: list[Source], most_corrupt: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(valid rows of all sources, violations of the others as sample_id, rule); raises if the others' share exceeds the limit.

    A null checksum is that of a file that isn't an image, and a violation; an empty one is of a source
    without files to read. Of rows that share a sample_id none is valid, whichever came first; rows
    without one break the contract by that alone. The rows are judged once and written to the shared
    folder, so no file is read again for the count or the result.
    """
    rows = reduce(DataFrame.unionByName, (s(spark) for s in sources))
    unread = {"width": F.coalesce("width", F.lit(1)), "height": F.coalesce("height", F.lit(1))}
    unread |= {c: F.when(F.col(c) == "", F.lit("0" * n)).otherwise(F.col(c)) for c, n in (("content_checksum", 64), ("perceptual_hash", 16))}
    own = [F.col(c).alias(f"own_{c}") for c in unread]
    judged = rows.select("*", *own).withColumns(unread).withColumn("broken", checks.broken_rules())
    with scratch(spark) as keep:
        judged = materialized(judged.select(*(F.col(f"own_{c}" if c in unread else c).alias(c) for c in MANIFEST_COLUMNS), "broken"))
        twice = checks.repeated_keys(judged.where(~missing(F.col("sample_id"))), "sample_id").select(F.col("sample_id").alias("twice"))
        rules = F.when(F.col("twice").isNull(), F.col("broken")).otherwise(F.array_append("broken", F.lit("repeated sample_id")))
        marked = keep(judged.join(twice, F.col("sample_id") == F.col("twice"), "left").select(*MANIFEST_COLUMNS, rules.alias("broken")))
    total, corrupt = marked.agg(F.count("*"), F.count_if(F.size("broken") > 0)).first()
    if total and corrupt / total > most_corrupt:
        raise DataIntegrityError(f"{corrupt} of {total} rows are corrupt, more than {most_corrupt:.2%}")
    return marked.where(F.size("broken") == 0).select(*MANIFEST_COLUMNS), marked.select("sample_id", F.explode("broken").alias("rule"))


def prediction_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A prediction table, filtered by split at the scan."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def missing_classes(rows: DataFrame, cap: int) -> DataFrame:
    """label, n, short: labels with fewer rows than the cap."""
    want = rows.sparkSession.createDataFrame([(0,), (1,)], "label int")
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    return want.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n")).withColumn("short", F.lit(cap) - F.col("n")).where("short > 0")
