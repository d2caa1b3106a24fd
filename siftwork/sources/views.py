"""The manifest, score and stress tables as views over a dataset folder, and the same views as SQL.

``manifest`` has a row for each document, labelled by ``labels``; ``scores`` a row for each labelled
document and condition, with a logit in thousandths that follows from a digest, so that both
engines compute it to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.exprs import let, sigmoid
from siftwork.sources.registry import CONDITIONS, STRESS, conditions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape_hash(text: Column) -> Column:
    """A 64-bit average hash of a text as 16 hex digits: a bit for each of 64 equal segments, set if it has its share of the letter e."""
    width = F.greatest(F.lit(1), F.ceil(F.length(text) / 64.0).cast("int"))
    # one pass over the text; each value is bound once, as a lambda computes anew what it closes over
    segments = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))
    letters = lambda s: F.coalesce(F.length(s) - F.length(F.replace(s, F.lit("e"), F.lit(""))), F.lit(0))
    counts = let(segments, lambda s: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: letters(F.get(s, i))))

    def digits(c: Column) -> Column:
        def of(total: Column) -> Column:
            half = lambda first: F.aggregate(F.slice(c, first, 32), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x * 64 >= total, 1).otherwise(0))
            return F.concat(*(F.lpad(F.lower(F.hex(half(first))), 8, "0") for first in (1, 33)))

        return let(F.aggregate(c, F.lit(0), lambda a, x: a + x), of)

    return F.when(text.isNull(), F.lit("0" * 16)).otherwise(let(counts, digits))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts become digests before the join, which deals rows out by doc_id at every size: no text is shuffled, no label goes through the driver."""
    lines = F.split("text", "\n", -1)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.md5(F.element_at(lines, 1)).alias("source_group_id"),
        F.size(lines).alias("height"),
        F.sha2("text", 256).alias("content_checksum"),
        shape_hash(F.col("text")).alias("perceptual_hash"),
    )
    return docs.join(table(spark, sf_dir, "labels").hint("merge"), "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("toxic").cast("int").alias("label"),
        F.col("source").alias("dataset_name"),
        F.lit("v1").alias("dataset_version"),
        F.when(F.col("toxic") == 0, "authentic").when(F.col("toxic") == 1, F.col("lang")).alias("generator_family"),
        "source_group_id",
        F.col("doc_id").cast("string").alias("original_image_id"),
        F.col("n_chars").cast("int").alias("width"),
        "height",
        F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long").alias("file_format"),
        F.when(F.col("quality") == 1, "open").when(F.col("quality") == 0, " ").alias("licence_identifier"),
        "content_checksum",
        "perceptual_hash",
        F.lit("unassigned").alias("split"),
    )


def _milli(doc: Column, condition: Column, label: Column) -> Column:
    digest = F.md5(F.concat_ws("|", doc.cast("string"), condition))
    return (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % 4000 - 2000 + 1500 * label).cast("long")


def scores(spark: SparkSession, sf_dir: str, stress: bool = False) -> DataFrame:
    """Labelled documents x conditions, the clean one among them; with ``stress``, the stress conditions instead of the others."""
    dim = conditions(spark).select("condition_id", F.col("family").alias("transform_family"))
    if stress:
        dim = spark.createDataFrame([(c.condition_id, c.family) for c in STRESS], "condition_id string, transform_family string")
    dim = dim.unionByName(spark.createDataFrame([("clean", "clean")], "condition_id string, transform_family string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    # the grid of samples and conditions: the dimension is the fixed list above, 15 rows
    grid = docs.crossJoin(F.broadcast(dim))
    milli = _milli(F.col("doc_id"), F.col("condition_id"), F.col("toxic"))
    logit = milli / F.lit(1000.0)
    return grid.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"),
        F.col("toxic").cast("int").alias("label"),
        milli.alias("milli"),
        logit.alias("logit"),
        F.round(sigmoid(logit), 9).alias("score"),
        F.when(F.col("doc_id") % 4 == 0, "generator_validation").otherwise("validation").alias("split"),
        F.when(F.col("toxic") == 0, "authentic").otherwise(F.col("lang")).alias("generator_family"),
        "transform_family",
        "condition_id",
        F.concat(F.lit("run-"), (F.col("doc_id") % 2).cast("string")).alias("checkpoint_id"),
    )


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


_HALF = """lpad(to_hex(list_sum(list_transform(generate_series({0}, {0} + 31), lambda i: CASE WHEN (length(substr(text, (i * wd + 1)::BIGINT, wd)) - length(replace(substr(text, (i * wd + 1)::BIGINT, wd), 'e', ''))) * 64 >= length(text) - length(replace(text, 'e', '')) THEN (1::BIGINT << (31 + {0} - i)::INTEGER) ELSE 0 END))::BIGINT), 8, '0')"""

MANIFEST_SQL = f"""manifest AS (
  SELECT 'doc-' || d.doc_id AS sample_id, 'documents/' || d.doc_id || '.txt' AS path, toxic::INTEGER AS label, source AS dataset_name, 'v1' AS dataset_version,
    CASE WHEN toxic = 0 THEN 'authentic' WHEN toxic = 1 THEN lang END AS generator_family,
    md5(string_split(text, chr(10))[1]) AS source_group_id, d.doc_id::VARCHAR AS original_image_id,
    n_chars::INTEGER AS width, len(string_split(text, chr(10)))::INTEGER AS height,
    CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS file_format,
    CASE WHEN quality = 1 THEN 'open' WHEN quality = 0 THEN ' ' END AS licence_identifier,
    sha256(text) AS content_checksum, lower({_HALF.format(0)} || {_HALF.format(32)}) AS perceptual_hash, 'unassigned' AS split
  FROM (SELECT *, greatest(1, ceil(length(text) / 64.0))::BIGINT AS wd FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def scores_sql(stress: bool = False) -> str:
    rows = [(c.condition_id, c.family) for c in (STRESS if stress else CONDITIONS)] + [("clean", "clean")]
    return f"""scores AS (
  SELECT sample_id, label, milli, milli / 1000.0::DOUBLE AS logit,
    round(CASE WHEN milli >= 0 THEN 1 / (1 + exp(-abs(milli / 1000.0::DOUBLE))) ELSE exp(-abs(milli / 1000.0::DOUBLE)) / (1 + exp(-abs(milli / 1000.0::DOUBLE))) END, 9) AS score,
    split, generator_family, transform_family, condition_id, checkpoint_id
  FROM (
    SELECT 'doc-' || d.doc_id AS sample_id, toxic::INTEGER AS label,
      (('0x' || substr(md5(d.doc_id || '|' || condition_id), 1, 4))::BIGINT % 4000 - 2000 + 1500 * toxic)::BIGINT AS milli,
      CASE WHEN d.doc_id % 4 = 0 THEN 'generator_validation' ELSE 'validation' END AS split,
      CASE WHEN toxic = 0 THEN 'authentic' ELSE lang END AS generator_family,
      transform_family, condition_id, 'run-' || (d.doc_id % 2) AS checkpoint_id
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id, (VALUES {_values(rows)}) AS c(condition_id, transform_family)
  )
)"""
