"""Queries over rules and reports: score contracts, manifests from several sources, artifacts, histories, paths, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import exprs
from siftwork.operators import checks, images, split, training
from siftwork.plans.registry import query
from siftwork.sources import readers, sinks
from siftwork.sources.registry import FAMILIES, STRESS
from siftwork.sources.views import MANIFEST_SQL as _M
from siftwork.sources.views import manifest, scores, scores_sql, table

_S = scores_sql()
_KNOWN = ", ".join(f"'{f}'" for f in ("clean", *FAMILIES))
_DAMAGED = f"""x AS (SELECT CASE WHEN milli % 23 = 0 THEN ' ' ELSE sample_id END AS sample_id, CASE WHEN milli % 11 = 0 THEN NULL ELSE label END AS label, CASE WHEN milli % 13 = 0 THEN 'NaN'::DOUBLE ELSE logit END AS logit,
  CASE WHEN milli % 17 = 0 THEN 1.5 ELSE score END AS score, CASE WHEN milli % 19 = 0 THEN 'other' ELSE transform_family END AS transform_family, condition_id, milli, split FROM scores)"""
_SIGMOID = "CASE WHEN logit >= 0 THEN 1 / (1 + exp(-abs(logit))) ELSE exp(-abs(logit)) / (1 + exp(-abs(logit))) END"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of which some break each contract."""
    every = lambda n: F.col("milli") % n == 0
    return scores(spark, sf_dir).withColumns({
        "sample_id": F.when(every(23), " ").otherwise(F.col("sample_id")),
        "label": F.when(~every(11), F.col("label")),
        "logit": F.when(every(13), float("nan")).otherwise(F.col("logit")),
        "score": F.when(every(17), 1.5).otherwise(F.col("score")),
        "transform_family": F.when(every(19), "other").otherwise(F.col("transform_family")),
    })


@query(f"""WITH {_S}, {_DAMAGED}, v AS (
  SELECT 'blank sample_id' AS rule FROM x WHERE trim(sample_id) = ''
  UNION ALL SELECT 'label' FROM x WHERE coalesce(label NOT IN (0, 1), true)
  UNION ALL SELECT 'logit' FROM x WHERE isnan(logit)
  UNION ALL SELECT 'score' FROM x WHERE score < 0 OR score > 1
  UNION ALL SELECT 'score is not the sigmoid of logit' FROM x WHERE isnan(logit) OR abs(score - {_SIGMOID}) > 1e-9
  UNION ALL SELECT 'family' FROM x WHERE transform_family NOT IN ({_KNOWN})
  UNION ALL SELECT 'clean condition and family differ' FROM x WHERE (condition_id = 'clean') <> (transform_family = 'clean'))
SELECT rule, count(*) AS n FROM v GROUP BY rule""")
def score_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.score_violations(_damaged(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH {_S}, {_DAMAGED}
SELECT 'unexpected split' AS problem, count(*) AS n FROM x WHERE split NOT IN ('validation', 'test') HAVING count(*) > 0
UNION ALL SELECT 'no rows of validation', 1 FROM x HAVING count(*) FILTER (WHERE split = 'validation') = 0
UNION ALL SELECT 'no rows of test', 1 FROM x HAVING count(*) FILTER (WHERE split = 'test') = 0
UNION ALL SELECT 'clean condition and family differ', count(*) FROM x WHERE (condition_id = 'clean') <> (transform_family = 'clean') HAVING count(*) > 0""")
def score_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.score_partition_violations(_damaged(spark, sf_dir), ("validation", "test"))


#: Rows of the manifest, a part of them again, and rows of labels 0, 1 and 2 (which is left out).
_SOURCES = f"""{_M}, u AS (
  SELECT sample_id, path, label, dataset_name, source_group_id, width, height, content_checksum, perceptual_hash FROM manifest
  UNION ALL SELECT sample_id, path, label, dataset_name, source_group_id, width, height, content_checksum, perceptual_hash FROM manifest WHERE original_image_id::BIGINT % 10 = 0
  UNION ALL SELECT 'pages:' || page_id, 'images/' || page_id, (page_id % 3)::INTEGER, 'pages', page_id::VARCHAR, 1, 1, repeat('0', 64), repeat('0', 16) FROM pages WHERE page_id % 3 <> 2
), k AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS times FROM u), v AS (
  SELECT sample_id, 'label' AS rule FROM k WHERE coalesce(label NOT IN (0, 1), true)
  UNION ALL SELECT sample_id, 'blank source_group_id' FROM k WHERE coalesce(trim(source_group_id) = '', true)
  UNION ALL SELECT sample_id, 'width' FROM k WHERE coalesce(width <= 0, false)
  UNION ALL SELECT sample_id, 'height' FROM k WHERE coalesce(height <= 0, false)
  UNION ALL SELECT sample_id, 'content_checksum' FROM k WHERE content_checksum IS NULL
  UNION ALL SELECT sample_id, 'perceptual_hash' FROM k WHERE perceptual_hash IS NULL
  UNION ALL SELECT sample_id, 'repeated sample_id' FROM k WHERE times > 1)"""


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = manifest(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("img_id"), (F.col("page_id") % 3).alias("label"))
    sources = [lambda _: readers.canonical(rows), lambda _: readers.canonical(rows.where("original_image_id % 10 = 0")), lambda _: readers.labelled_rows(pages, "pages")]
    return readers.build_manifest(spark, sources, most_corrupt=1.0)


@query(f"WITH {_SOURCES} SELECT sample_id, path, label, dataset_name FROM u WHERE sample_id NOT IN (SELECT sample_id FROM v)")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[0].select("sample_id", "path", "label", "dataset_name")


@query(f"WITH {_SOURCES} SELECT sample_id, rule FROM v")
def manifest_build_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[1]


@query("""WITH d AS (SELECT 'doc-' || doc_id AS path, sha256(coalesce(text, '')) AS want FROM documents),
f AS (SELECT 'doc-' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(coalesce(text, '') || 'x') WHEN doc_id % 2 = 0 THEN upper(sha256(coalesce(text, ''))) ELSE sha256(coalesce(text, '')) END AS have FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'new-' || doc_id, sha256(doc_id::VARCHAR) FROM documents WHERE doc_id % 11 = 0)
SELECT coalesce(d.path, f.path) AS path, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'not declared' ELSE 'changed' END AS problem FROM d FULL JOIN f ON d.path = f.path WHERE have IS NULL OR want IS NULL OR lower(want) <> lower(have)""")
def artifact_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string")).alias("path")
    whole = F.sha2("text", 256)
    changed = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).when(F.col("doc_id") % 2 == 0, F.upper(whole)).otherwise(whole)
    found = docs.where("doc_id % 5 <> 0").select(named("doc-"), changed.alias("sha256")).unionByName(docs.where("doc_id % 11 = 0").select(named("new-"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256")))
    return sinks.artifact_mismatches(docs.select(named("doc-"), whole.alias("sha256")), found)


@query("SELECT (l_orderkey % 12)::BIGINT AS epoch, round(avg(l_discount), 9) AS loss FROM lineitem GROUP BY 1")
def epoch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 12).alias("epoch"), F.col("l_discount").alias("loss"))
    return training.epoch_means(steps).withColumn("loss", F.round("loss", 9))


@query("SELECT round(median(value), 9) AS median_ms, count(*) AS n FROM events WHERE event_id >= 10")
def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), F.col("value").alias("ms"))
    return training.median_latency(timings, warmup=10).withColumn("median_ms", F.round("median_ms", 9))


@query("""WITH n AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT w.label, coalesce(n, 0) AS n, 1000000 - coalesce(n, 0) AS short FROM (VALUES (0), (1)) AS w(label) LEFT JOIN n ON n.label = w.label WHERE 1000000 - coalesce(n, 0) > 0""")
def acquisition_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.missing_classes(table(spark, sf_dir, "labels").select(F.col("toxic").cast("int").alias("label")), 1_000_000)


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 500 < 50 THEN (p_partkey % 500 + 1) / 50.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (p_partkey % 500 - 50) / 350.0::DOUBLE))) END, 9) AS factor FROM part")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = exprs.learning_rate_factor(F.col("p_partkey") % 500, warmup=50, total=400)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(factor, 9).alias("factor"))


_HEADS = ("a/", "/", "../", "C:", "\\", "x/../", "..\\", "a..b/", " ", "x\\..")


@query(f"""WITH p AS (SELECT doc_id, [{', '.join(f"'{h}'" for h in _HEADS)}][(doc_id % {len(_HEADS)}) + 1] || CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS path FROM documents)
SELECT doc_id, path, trim(path) <> '' AND NOT regexp_matches(path, '^[/\\\\]') AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT regexp_matches(path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AS safe FROM p""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*(F.lit(h) for h in _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))).alias("path"))
    return docs.withColumn("safe", exprs.safe_relative_path(F.col("path")))


@query(r"""WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN E'# Card\n\n## Limits  \n' || text || E'\n## Data\n' || lang WHEN 1 THEN E'## Limits\n' || text ELSE E'### Limits\n' || text END AS card FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(E'\n' || card, '\n## Limits\s*\n') THEN regexp_extract(regexp_extract(E'\n' || card, '\n## Limits\s*\n(.*)$', 1, 's'), '^(.*?)(?:\n## |$)', 1, 's') END AS limits FROM m""")
def card_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    card = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Card\n\n## Limits  \n"), text, F.lit("\n## Data\n"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("## Limits\n"), text)).otherwise(F.concat(F.lit("### Limits\n"), text))
    return table(spark, sf_dir, "documents").select("doc_id", exprs.heading_section(card, "Limits").alias("limits"))


@query(f"""WITH {_M} SELECT source_group_id AS split_group_id, bool_or(label = 0) AS has_real, bool_or(label = 1) AS has_fake, bool_or(label = 1 AND generator_family = 'en') AS in_validation, bool_or(label = 1 AND generator_family = 'de') AS in_test
FROM manifest WHERE label IS NOT NULL GROUP BY 1""")
def holdout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = manifest(spark, sf_dir).where("label is not null").withColumn("split_group_id", F.col("source_group_id"))
    return split.group_summary(grouped, ["en"], ["de"])


@query(f"WITH {_S} SELECT DISTINCT checkpoint_id, CASE checkpoint_id WHEN 'run-0' THEN '/runs/run-0/run' ELSE '/runs/run-1' END AS run FROM scores")
def candidate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.run_of_candidate(scores(spark, sf_dir).select("checkpoint_id").distinct(), ["/runs/run-0/run", "/runs/run-1", "/other/run-1/run"])


def _json(parameters: dict[str, str]) -> str:
    return "{" + ",".join(f'"{k}":"{parameters[k]}"' for k in sorted(parameters)) + "}"


def _logit(rows: DataFrame) -> DataFrame:
    """A stand-in for a model: thousandths that follow from a digest of sample and condition."""
    digest: Column = F.md5(F.concat_ws("|", "sample_id", "condition_id"))
    return rows.withColumn("logit", (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % 4000 - 2000) / F.lit(1000.0))


_DIGIT = "(('0x' || substr(md5(sample_id || '|' || {0}), 1, 4))::BIGINT % 4000 - 2000) / 1000.0::DOUBLE"


@query(f"""WITH s AS (SELECT 'doc-' || doc_id AS sample_id FROM documents), g AS (SELECT sample_id, condition_id, transform_metadata, {_DIGIT.format('condition_id')} AS logit, {_DIGIT.format("'clean'")} AS clean_logit FROM s, (VALUES {', '.join(f"('{c.condition_id}', '{_json(c.parameters)}')" for c in STRESS)}) AS c(condition_id, transform_metadata))
SELECT sample_id, condition_id, transform_metadata, logit, round({_SIGMOID}, 12) AS score, round({_SIGMOID.replace('logit', 'clean_logit')}, 12) AS clean_score, 'run-0' AS checkpoint_id FROM g""")
def stress_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"))
    return training.stress_grid(samples, _logit, "run-0").select("sample_id", "condition_id", "transform_metadata", "logit", "score", "clean_score", "checkpoint_id")


_INNER = ", ".join(f"4 * g[{8 * y + x + 1}] - g[{8 * y + x}] - g[{8 * y + x + 2}] - g[{8 * y + x - 7}] - g[{8 * y + x + 9}]" for y in range(1, 7) for x in range(1, 7))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS g FROM embeddings), d AS (SELECT vec_id, unnest([{_INNER}]) AS d FROM v), s AS (SELECT vec_id, var_pop(d) AS sharpness FROM d GROUP BY 1)
SELECT 'vec-' || vec_id AS sample_id, 8 AS width, 8 AS height, 0.0::DOUBLE AS blockiness, round(sharpness, 9) AS sharpness FROM s""")
def pixel_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("sample_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").cast("array<double>").alias("pixels"))
    return images.pixel_signals(vectors).select("sample_id", "width", "height", "blockiness", F.round("sharpness", 9).alias("sharpness"))


@query("""WITH s AS (SELECT doc_id, (n_chars % 600 + 1)::INTEGER AS width, (n_chars % 90 + 10)::INTEGER AS height, (doc_id % 40) / 20.0::DOUBLE AS blockiness, (doc_id % 50) / 1000.0::DOUBLE AS sharpness, (doc_id % 30) / 200.0::DOUBLE AS residual, CASE doc_id % 6 WHEN 0 THEN 'jpg' ELSE 'png' END AS file_format FROM documents),
j AS (SELECT *, file_format = 'jpg' AS jpeg, blockiness >= 1.35 AS blocky, least(width, height) >= 64 AND sharpness < 0.0012 AS soft, least(width, height) >= 64 AND residual > 0.075 AND sharpness > 0.025 AS noisy, greatest(width, height) < 384 AS small FROM s)
SELECT doc_id, concat_ws('|', CASE WHEN jpeg OR blocky THEN 'JPEG encoding or compression' END, CASE WHEN soft THEN 'Strong blur or loss of detail' END, CASE WHEN noisy THEN 'Noise-like high-frequency pattern' END, CASE WHEN small THEN 'Low resolution; prior rescaling is possible' END) AS labels,
  jpeg OR blocky OR soft OR noisy OR small AS detected, CASE WHEN blocky OR soft THEN 'moderate' ELSE 'low' END AS confidence FROM j""")
def processing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda n, of: (F.col("doc_id") % n) / F.lit(float(of))
    signals = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 600 + 1).alias("width"), (F.col("n_chars") % 90 + 10).alias("height"), share(40, 20).alias("blockiness"), share(50, 1000).alias("sharpness"), share(30, 200).alias("residual"), F.when(F.col("doc_id") % 6 == 0, "jpg").otherwise("png").alias("file_format"))
    return images.processing_labels(signals, "file_format").select("doc_id", F.array_join("labels", "|").alias("labels"), "detected", "confidence")
