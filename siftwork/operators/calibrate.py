"""Temperature scaling, parity of two score tables, losses over paired views."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.exprs import bce, cosine, sigmoid


def fit_temperature(scored: DataFrame, rounds: int = 60, logit: str = "logit", label: str = "label") -> DataFrame:
    """temperature, nll, nll_before: one row.

    The mean cross entropy is convex in 1/T, so safeguarded Newton steps over one aggregate row each
    find the least; log T stays within 20 of 0, and T = 1 stays unless it is beaten. Logits are first
    aggregated to distinct (logit, label) with counts.
    """
    level = scored.groupBy(F.col(logit).cast("double").alias("z"), F.col(label).cast("double").alias("y")).agg(F.count("*").alias("w")).persist()
    total = level.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("no rows to fit")

    def at(beta: float) -> tuple[float, float, float]:
        z, p = F.col("z") * F.lit(beta), sigmoid(F.col("z") * F.lit(beta))
        row = level.agg(F.sum(F.col("w") * bce(z, F.col("y"))), F.sum(F.col("w") * F.col("z") * (p - F.col("y"))), F.sum(F.col("w") * F.col("z") * F.col("z") * p * (1 - p))).first()
        return row[0] / total, row[1] / total, row[2] / total

    lo, hi, beta = math.exp(-20.0), math.exp(20.0), 1.0
    before, slope, bend = at(1.0)
    for _ in range(rounds):
        if abs(slope) < 1e-10:
            break
        lo, hi = (beta, hi) if slope < 0 else (lo, beta)
        step = beta - slope / bend if bend > 0 else math.inf
        beta = step if lo < step < hi else math.sqrt(lo * hi)
        if hi / lo < 1 + 1e-9:
            break
        _, slope, bend = at(beta)
    after = at(beta)[0]
    level.unpersist()
    kept = (1.0 / beta, after) if after <= before + 1e-7 else (1.0, before)
    return scored.sparkSession.createDataFrame([(*kept, before)], "temperature double, nll double, nll_before double")


def parity(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-4) -> DataFrame:
    """One row: n, greatest differences of logits and probabilities, and whether both are within tolerance."""
    joined = a.select(*keys, F.col("logit").alias("a")).join(b.select(*keys, F.col("logit").alias("b")), keys)
    far, far_p = F.max(F.abs(F.col("a") - F.col("b"))), F.max(F.abs(sigmoid(F.col("a")) - sigmoid(F.col("b"))))
    return joined.agg(F.count("*").alias("n"), far.alias("max_logit_difference"), far_p.alias("max_probability_difference")).withColumn("within", (F.col("max_logit_difference") <= tolerance) & (F.col("max_probability_difference") <= tolerance))


def survival_loss(pairs: DataFrame, logit_weight: float = 0.25, feature_weight: float = 0.10) -> DataFrame:
    """One row of losses over (label, clean_logit, transformed_logit, clean_features, transformed_features)."""
    label = F.col("label").cast("double")
    apart = 1 - cosine(F.col("clean_features"), F.col("transformed_features"))
    each = pairs.agg(
        F.avg(bce(F.col("clean_logit"), label)).alias("clean"),
        F.avg(bce(F.col("transformed_logit"), label)).alias("transformed"),
        F.avg((F.col("clean_logit") - F.col("transformed_logit")) ** 2).alias("logit_consistency"),
        F.avg(apart).alias("feature_consistency"),
    )
    total = F.col("clean") + F.col("transformed") + logit_weight * F.col("logit_consistency") + feature_weight * F.col("feature_consistency")
    return each.withColumn("total", total)
