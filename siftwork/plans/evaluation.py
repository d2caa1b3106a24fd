"""Queries over score tables: areas, roll-ups, thresholds, ranking, cases, calibration, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import exprs
from siftwork.operators import calibrate, cases, checks, metrics, training
from siftwork.plans.registry import query
from siftwork.sources.registry import FAMILIES
from siftwork.sources.views import scores, scores_sql, table

_S, _STRESS = scores_sql(), scores_sql(stress=True)


def _auc(rows: str, by: str = "", score: str = "milli", where: str = "true") -> str:
    """SELECT of by, roc_auc, n_positive, n_negative over a table."""
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}(sum(p * (2 * nb + n)))::DOUBLE / (2 * sum(p) * sum(n))::DOUBLE AS roc_auc, sum(p)::BIGINT AS n_positive, sum(n)::BIGINT AS n_negative
  FROM (SELECT *, coalesce(sum(n) OVER ({over}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
    FROM (SELECT {keys}{score} AS s, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM {rows} WHERE {where} GROUP BY {keys}{score})) {tail}"""


_ROLL = f"""WITH {_S}, c AS ({_auc("scores", "condition_id, transform_family", where="split = 'validation'")}),
fam AS (SELECT transform_family, avg(roc_auc) AS value FROM c WHERE condition_id <> 'clean' GROUP BY transform_family),
pool AS ({_auc("scores", where="split = 'validation' AND condition_id <> 'clean'")}),
unseen AS ({_auc("scores", where="split = 'generator_validation' AND condition_id = 'clean'")}),
r AS (
  SELECT 'clean' AS metric, roc_auc AS value FROM c WHERE condition_id = 'clean'
  UNION ALL SELECT 'family:' || transform_family, value FROM fam
  UNION ALL SELECT 'macro_robust', avg(value) FROM fam
  UNION ALL SELECT 'pooled_robust', roc_auc FROM pool
  UNION ALL SELECT 'worst_family', min(value) FROM fam
  UNION ALL SELECT 'worst_condition', min(roc_auc) FROM c WHERE condition_id <> 'clean'
  UNION ALL SELECT 'unseen_generator', roc_auc FROM unseen
  UNION ALL SELECT 'composite', 0.5 * (SELECT roc_auc FROM c WHERE condition_id = 'clean') + 0.5 * avg(value) FROM fam
)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 9) for c in columns})


@query(f"""WITH e AS (SELECT event_type, value, CASE WHEN json_extract(props, '$.k')::BIGINT >= 50 THEN 1 ELSE 0 END AS label FROM events)
SELECT event_type, round(roc_auc, 9) AS roc_auc, n_positive, n_negative FROM ({_auc("e", "event_type", "value")})""")
def auc_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events").select("event_type", "value", F.when(k >= 50, 1).otherwise(0).alias("label"))
    return _rounded(metrics.roc_auc(events, "event_type", score="value"), "roc_auc")


@query(f"""WITH b AS (SELECT l_linestatus || '-' || month(l_shipdate) AS condition_id, l_discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)
SELECT condition_id, round(roc_auc, 9) AS roc_auc, n_positive, n_negative FROM ({_auc("b", "condition_id", "l_discount")})""")
def auc_by_shipping_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_linestatus", F.month("l_shipdate").cast("string")).alias("condition_id"), "l_discount", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    return _rounded(metrics.roc_auc(rows, "condition_id", score="l_discount"), "roc_auc")


@query(f"""WITH {_S} SELECT condition_id, transform_family, round(roc_auc, 9) AS roc_auc, n_positive, n_negative FROM ({_auc("scores", "condition_id, transform_family", where="split = 'validation'")})""")
def auc_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.condition_auc(scores(spark, sf_dir), "validation"), "roc_auc")


@query(f"{_ROLL} SELECT metric, round(value, 9) AS value FROM r")
def auc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.rollup(scores(spark, sf_dir)), "value")


_NAMES = " ".join(f"WHEN 'family:{k}' THEN '{v}'" for k, v in FAMILIES.items())
_PLACES = " ".join(f"WHEN 'family:{k}' THEN {i + 1}" for i, k in enumerate(FAMILIES))


@query(f"""{_ROLL}, u AS (
  SELECT CASE metric WHEN 'clean' THEN 'Clean' {_NAMES} WHEN 'macro_robust' THEN 'Macro robust' WHEN 'pooled_robust' THEN 'Pooled robust' WHEN 'worst_family' THEN 'Worst family' WHEN 'worst_condition' THEN 'Worst condition' WHEN 'unseen_generator' THEN 'Unseen generator' ELSE 'Composite' END AS partition, value,
    CASE metric WHEN 'clean' THEN 0 {_PLACES} WHEN 'macro_robust' THEN 1000 WHEN 'pooled_robust' THEN 1001 WHEN 'worst_family' THEN 1002 WHEN 'worst_condition' THEN 1003 WHEN 'unseen_generator' THEN 1004 ELSE 1005 END AS place, '' AS tie FROM r
  UNION ALL SELECT 'Condition: ' || condition_id, roc_auc, 500, condition_id FROM c WHERE condition_id <> 'clean'
) SELECT row_number() OVER (ORDER BY place, tie) AS ordinal, partition, round(value, 9) AS roc_auc FROM u""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.metric_rows(scores(spark, sf_dir)), "roc_auc")


_CLEAN = f"""WITH {_S}, k AS (SELECT checkpoint_id, split, sample_id, max(score) AS clean_score FROM scores WHERE condition_id = 'clean' GROUP BY 1, 2, 3),
j AS (SELECT scores.*, clean_score FROM scores LEFT JOIN k ON k.checkpoint_id IS NOT DISTINCT FROM scores.checkpoint_id AND k.split IS NOT DISTINCT FROM scores.split AND k.sample_id IS NOT DISTINCT FROM scores.sample_id)"""


@query(f"{_CLEAN} SELECT sample_id, condition_id, checkpoint_id, score, clean_score FROM j")
def clean_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_clean_score(scores(spark, sf_dir)).select("sample_id", "condition_id", "checkpoint_id", "score", "clean_score")


@query(f"WITH {_S} SELECT sample_id, checkpoint_id, split, score FROM scores WHERE condition_id = 'clean' AND label = 0 AND score >= 0.5 ORDER BY score DESC, sample_id, checkpoint_id, split LIMIT 20")
def error_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.false_positives(scores(spark, sf_dir)).select("sample_id", "checkpoint_id", "split", "score")


@query(f"WITH {_S} SELECT sample_id, checkpoint_id, split, score FROM scores WHERE condition_id = 'clean' AND label = 1 AND score < 0.5 ORDER BY score, sample_id, checkpoint_id, split LIMIT 20")
def error_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.false_negatives(scores(spark, sf_dir)).select("sample_id", "checkpoint_id", "split", "score")


@query(f"{_CLEAN} SELECT sample_id, condition_id, checkpoint_id, round(abs(score - clean_score), 9) AS change FROM j WHERE condition_id <> 'clean' AND clean_score IS NOT NULL ORDER BY change DESC, sample_id, condition_id, checkpoint_id, split LIMIT 20")
def error_most_unstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.most_unstable(scores(spark, sf_dir)).select("sample_id", "condition_id", "checkpoint_id", "change")


@query(f"""WITH {_STRESS}, k AS (SELECT checkpoint_id, split, sample_id, max(score) AS clean_score FROM scores WHERE condition_id = 'clean' GROUP BY 1, 2, 3),
j AS (SELECT scores.*, score - clean_score AS d FROM scores JOIN k USING (checkpoint_id, split, sample_id) WHERE condition_id <> 'clean'),
a AS ({_auc("j", "condition_id")})
SELECT condition_id, round(roc_auc, 9) AS roc_auc, round(avg(d), 9) AS mean_shift, round(median(d), 9) AS median_shift, round(avg(abs(d)), 9) AS mean_abs_shift FROM j JOIN a USING (condition_id) GROUP BY condition_id, roc_auc""")
def stress_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.stress_shift(scores(spark, sf_dir, stress=True)), "roc_auc", "mean_shift", "median_shift", "mean_abs_shift")


@query(f"""WITH {_S}, n AS (SELECT count(*) FILTER (WHERE score >= 0.6 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.6 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.6 AND label = 0) AS tn, count(*) FILTER (WHERE score < 0.6 AND label = 1) AS fn FROM scores WHERE condition_id = 'clean')
SELECT tp, fp, tn, fn, round(coalesce((tp + tn) / (tp + fp + tn + fn), 0), 9) AS accuracy, round(coalesce(tp / (tp + fp), 0), 9) AS precision, round(coalesce(tp / (tp + fn), 0), 9) AS recall, round(coalesce(2 * tp / (2 * tp + fp + fn), 0), 9) AS f1 FROM n""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.confusion(scores(spark, sf_dir).where("condition_id = 'clean'"), 0.6), "accuracy", "precision", "recall", "f1")


@query(f"""WITH {_S}, g AS (SELECT score AS s, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM scores WHERE condition_id = 'clean' AND split = 'validation' GROUP BY score),
c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an, row_number() OVER (ORDER BY s DESC) AS rn, lead(p) OVER (ORDER BY s DESC) AS np, lead(n) OVER (ORDER BY s DESC) AS nn FROM g),
k AS (SELECT s, rn, tp::DOUBLE / ap::DOUBLE - fp::DOUBLE / an::DOUBLE AS j FROM c WHERE NOT (rn > 1 AND np IS NOT NULL AND np = p AND nn = n)),
b AS (SELECT *, max(j) OVER () AS best FROM k)
SELECT s AS threshold, round(j, 9) AS youden_j FROM b WHERE j >= best - 1e-12 ORDER BY abs(s - 0.5), rn LIMIT 1""")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.operating_threshold(scores(spark, sf_dir).where("condition_id = 'clean' and split = 'validation'")), "youden_j")


@query(f"""WITH {_S}, c AS ({_auc("scores", "checkpoint_id, condition_id, transform_family", where="split = 'validation'")}),
f AS (SELECT checkpoint_id, transform_family, avg(roc_auc) AS a FROM c WHERE condition_id <> 'clean' GROUP BY 1, 2),
m AS (SELECT checkpoint_id, avg(a) AS macro_robust_auc, min(a) AS worst_family_auc FROM f GROUP BY 1),
u AS ({_auc("scores", "checkpoint_id", where="split = 'generator_validation' AND condition_id = 'clean'")}),
r AS (SELECT m.checkpoint_id, c.roc_auc AS clean_auc, macro_robust_auc, worst_family_auc, coalesce(u.roc_auc, 0.0) AS unseen_auc FROM m JOIN c ON c.checkpoint_id = m.checkpoint_id AND c.condition_id = 'clean' LEFT JOIN u ON u.checkpoint_id = m.checkpoint_id)
SELECT checkpoint_id, round(clean_auc, 9) AS clean_auc, round(macro_robust_auc, 9) AS macro_robust_auc, round(worst_family_auc, 9) AS worst_family_auc, round(unseen_auc, 9) AS unseen_auc, round(0.5 * clean_auc + 0.5 * macro_robust_auc, 9) AS composite_score,
  row_number() OVER (ORDER BY 0.5 * clean_auc + 0.5 * macro_robust_auc DESC, worst_family_auc DESC, unseen_auc DESC, checkpoint_id DESC) AS place FROM r""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = metrics.rank_candidates(metrics.candidates(scores(spark, sf_dir)))
    return _rounded(ranked, "clean_auc", "macro_robust_auc", "worst_family_auc", "unseen_auc", "composite_score")


_SIG = "CASE WHEN milli >= 0 THEN 1 / (1 + exp(-abs(milli / 1000.0::DOUBLE / 1.7::DOUBLE))) ELSE exp(-abs(milli / 1000.0::DOUBLE / 1.7::DOUBLE)) / (1 + exp(-abs(milli / 1000.0::DOUBLE / 1.7::DOUBLE))) END"


@query(f"""WITH {_S}, c AS (SELECT *, round({_SIG}, 9) AS p FROM scores),
k AS (SELECT checkpoint_id, split, sample_id, max(p) AS cp FROM c WHERE condition_id = 'clean' GROUP BY 1, 2, 3)
SELECT sample_id, condition_id, p AS generated, round(1 - p, 9) AS authentic, round(greatest(p, 1 - p), 9) AS confidence, p >= 0.5 AS flagged,
  CASE WHEN round(greatest(p, 1 - p), 9) >= 0.85 THEN 'High confidence' WHEN round(greatest(p, 1 - p), 9) >= 0.65 THEN 'Moderate confidence' ELSE 'Low confidence' END AS bucket,
  CASE WHEN round(abs(p - cp), 9) <= 0.02 THEN 'Stable under transformation' WHEN round(abs(p - cp), 9) <= 0.10 THEN 'Moderate probability shift' ELSE 'Sensitive to transformation' END AS stability,
  (p >= 0.5) <> (cp >= 0.5) AS verdict_changed FROM c JOIN k USING (checkpoint_id, split, sample_id)""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(exprs.calibrated(F.col("logit"), 1.7), 9)
    both = metrics.with_clean_score(scores(spark, sf_dir).withColumn("score", p))
    sure, moved = F.round(F.greatest("score", 1 - F.col("score")), 9), F.round(F.abs(F.col("score") - F.col("clean_score")), 9)
    return both.select("sample_id", "condition_id", F.col("score").alias("generated"), F.round(1 - F.col("score"), 9).alias("authentic"), sure.alias("confidence"), (F.col("score") >= 0.5).alias("flagged"), exprs.confidence_bucket(sure).alias("bucket"), exprs.stability_rating(moved).alias("stability"), ((F.col("score") >= 0.5) != (F.col("clean_score") >= 0.5)).alias("verdict_changed"))


@query(f"""WITH {_S}, m AS (SELECT sample_id, condition_id, transform_family, CASE WHEN label = 1 THEN milli ELSE -milli END AS margin, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN label = 1 THEN milli ELSE -milli END, condition_id) AS rn FROM scores WHERE condition_id <> 'clean')
SELECT sample_id, condition_id, transform_family, margin FROM m WHERE rn = 1""")
def hard_mining_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.hardest_condition(scores(spark, sf_dir))


@query(f"""WITH {_S}, m AS (SELECT transform_family, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN label = 1 THEN milli ELSE -milli END, condition_id) AS rn FROM scores WHERE condition_id <> 'clean'),
f AS (SELECT transform_family, count(*) AS n FROM m WHERE rn = 1 GROUP BY 1)
SELECT transform_family, n, round(n / sum(n) OVER (), 9) AS share, n / sum(n) OVER () > 0.6 AS dominates FROM f""")
def family_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.family_proportions(cases.hardest_condition(scores(spark, sf_dir)))


@query(f"""WITH {_S} SELECT count(*) AS n, round(max(abs(logit - logit::FLOAT::DOUBLE)), 9) AS max_logit_difference, max(abs(logit - logit::FLOAT::DOUBLE)) <= 1e-4 AS within FROM scores""")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    single = rows.withColumn("logit", F.col("logit").cast("float").cast("double"))
    return calibrate.parity(rows, single, ["sample_id", "condition_id"]).select("n", F.round("max_logit_difference", 9).alias("max_logit_difference"), "within")


_BCE = "greatest({z}, 0) - {z} * y + ln(1 + exp(-abs({z})))"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding, 1, embedding) OVER (ORDER BY vec_id)::DOUBLE[] AS b, (label % 2)::DOUBLE AS y FROM embeddings),
p AS (SELECT a, b, y, a[1] AS za, b[1] AS zb FROM v)
SELECT round(avg({_BCE.format(z='za')}), 7) AS clean, round(avg({_BCE.format(z='zb')}), 7) AS transformed, round(avg((za - zb) ** 2), 7) AS logit_consistency, round(avg(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))), 7) AS feature_consistency,
  round(avg({_BCE.format(z='za')}) + avg({_BCE.format(z='zb')}) + 0.25 * avg((za - zb) ** 2) + 0.10 * avg(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))), 7) AS total FROM p""")
def survival_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), (F.col("label") % 2).alias("label"))
    # the second view of a vector is its neighbour's: ids are dense, so a join on the next id pairs them
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    pairs = vectors.join(after, "vec_id", "left").withColumn("b", F.coalesce("b", "a"))
    loss = calibrate.survival_loss(pairs.select("label", F.get("a", F.lit(0)).alias("clean_logit"), F.get("b", F.lit(0)).alias("transformed_logit"), F.col("a").alias("clean_features"), F.col("b").alias("transformed_features")))
    return loss.withColumns({c: F.round(c, 7) for c in loss.columns})


@query(f"""WITH {_S}, x AS (SELECT condition_id, CASE WHEN condition_id = 'jpeg_q90' AND milli % 2 = 0 THEN 'blur' ELSE transform_family END AS transform_family FROM scores)
SELECT condition_id, count(DISTINCT transform_family) AS n_families FROM x WHERE condition_id <> 'clean' GROUP BY 1 HAVING count(DISTINCT transform_family) > 1""")
def ambiguous_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when((F.col("condition_id") == "jpeg_q90") & (F.col("milli") % 2 == 0), "blur").otherwise(F.col("transform_family"))
    return checks.ambiguous_conditions(scores(spark, sf_dir).withColumn("transform_family", mixed))


@query(f"""WITH {_STRESS}, seen AS (SELECT DISTINCT transform_family AS family FROM scores WHERE condition_id <> 'clean'), want(family) AS (VALUES {', '.join(f"('{f}')" for f in FAMILIES)})
SELECT family, 'missing' AS problem FROM want ANTI JOIN seen USING (family) UNION ALL SELECT family, 'unexpected' FROM seen ANTI JOIN want USING (family)""")
def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.family_coverage(scores(spark, sf_dir, stress=True))


@query()
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.fit_temperature(scores(spark, sf_dir).where("condition_id = 'clean'"))


@query("""WITH h AS (SELECT dayofyear(l_shipdate)::BIGINT AS epoch, max(l_extendedprice) AS score FROM lineitem GROUP BY 1),
m AS (SELECT *, row_number() OVER (ORDER BY epoch) AS place, max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM h),
b AS (SELECT *, max(CASE WHEN prior IS NULL OR score > prior THEN place END) OVER (ORDER BY epoch) AS best_at, max(score) OVER (ORDER BY epoch) AS best FROM m)
SELECT epoch, score, best, place - best_at AS since_best, place - best_at >= 3 AS stop FROM b""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "lineitem").groupBy(F.dayofyear("l_shipdate").cast("long").alias("epoch")).agg(F.max("l_extendedprice").alias("score"))
    return training.early_stopping(history, patience=3)


@query(f"""WITH {_S}, h AS (SELECT sample_id, label, milli / 1000.0::DOUBLE AS z, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN label = 1 THEN milli ELSE -milli END, condition_id) AS rn FROM scores WHERE condition_id <> 'clean'),
p AS (SELECT h.label::DOUBLE AS y, h.z AS zt, c.logit AS zc FROM h JOIN scores c ON c.sample_id = h.sample_id AND c.condition_id = 'clean' WHERE rn = 1)
SELECT count(*) AS n, round(avg({_BCE.format(z='zc')}), 8) AS clean_loss, round(avg({_BCE.format(z='zt')}), 8) AS transformed_loss, round(avg((zc - zt) ** 2), 8) AS logit_consistency,
  round(avg({_BCE.format(z='zc')}) + avg({_BCE.format(z='zt')}) + 0.25 * avg((zc - zt) ** 2), 8) AS total FROM p""")
def hard_mined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    loss = training.hardest_loss(rows.where("condition_id <> 'clean'"), rows.where("condition_id = 'clean'"))
    return loss.withColumns({c: F.round(c, 8) for c in loss.columns if c != "n"})
