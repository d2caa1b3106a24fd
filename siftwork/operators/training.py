"""Tables around training: history and early stopping, hard-mined losses, stress grids, run times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.exprs import bce, finite, sigmoid
from siftwork.operators import checks
from siftwork.operators.calibrate import survival_loss
from siftwork.operators.cases import hardest_condition, mined_condition
from siftwork.operators.images import picked_conditions
from siftwork.sources.registry import stress_conditions


def epoch_means(steps: DataFrame) -> DataFrame:
    """epoch, loss: the mean over the steps of each epoch."""
    return steps.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def early_stopping(history: DataFrame, patience: int, least_gain: float = 0.0) -> DataFrame:
    """``history`` (epoch, score) with best so far, epochs since it, and stop; only a strictly greater score is a new best.

    One row for each epoch of a run.
    """
    order = Window.orderBy("epoch")
    before = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("is_best", before.isNull() | (F.col("score") > before + F.lit(float(least_gain))))
    place = F.row_number().over(order)
    best_at = F.max(F.when(F.col("is_best"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("place", place).withColumn("since_best", (F.col("place") - best_at).cast("long"))
    best = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("best", best).withColumn("stop", F.col("since_best") >= patience).select("epoch", "score", "best", "since_best", "stop")


def median_latency(timings: DataFrame, warmup: int = 0) -> DataFrame:
    """median_ms, n over (run, ms), the first ``warmup`` runs left out."""
    return timings.where(F.col("run") >= warmup).agg(F.median("ms").alias("median_ms"), F.count("*").alias("n"))


def mined_conditions(scored: DataFrame, samples: DataFrame, epoch: int, seed: int, count: int = 3, exploration: float = 0.20) -> DataFrame:
    """``cases.mined_condition`` over ``count`` sampled candidates of each sample; a candidate without one score is an error.

    ``scored``: sample_id, label, condition_id, transform_family, logit of all conditions that may be sampled.
    """
    if count < 2:
        raise ValueError("mining needs two candidates or more")
    picked = picked_conditions(samples, epoch, seed, count)
    found = picked.join(scored.select("sample_id", "condition_id", "transform_family", "label", "logit"), ["sample_id", "condition_id"], "left")
    unscored = found.groupBy("sample_id", "condition_id").agg(F.count("logit").alias("n")).where("n <> 1")
    checks.enforce(unscored, what="candidates without exactly one score")
    return mined_condition(found, epoch, seed, exploration)


def hard_mined_loss(scored: DataFrame, clean: DataFrame, epoch: int, seed: int, count: int = 3, exploration: float = 0.20, logit_weight: float = 0.25, feature_weight: float = 0.10) -> DataFrame:
    """One row: the survival loss over each sample's mined candidate and its clean view.

    ``scored`` as in ``mined_conditions``; ``clean``: sample_id, logit. Both with features, an array of
    doubles; tables without them need ``feature_weight`` 0.
    """
    have = "features" in scored.columns and "features" in clean.columns
    if feature_weight and not have:
        raise ValueError("feature consistency needs features, or a weight of 0")
    features = (lambda: F.col("features")) if have else (lambda: F.array(F.lit(1.0)))
    mined = mined_conditions(scored, clean, epoch, seed, count, exploration).select("sample_id", "condition_id")
    chosen = scored.join(mined, ["sample_id", "condition_id"]).select("sample_id", "label", F.col("logit").alias("transformed_logit"), features().alias("transformed_features"))
    pairs = chosen.join(clean.select("sample_id", F.col("logit").alias("clean_logit"), features().alias("clean_features")), "sample_id")
    return survival_loss(pairs, logit_weight, feature_weight)


def hardest_loss(candidates: DataFrame, clean: DataFrame, logit_weight: float = 0.25) -> DataFrame:
    """One row: the loss over each sample's hardest candidate and its clean view, without sampling, exploration or features.

    ``candidates``: sample_id, label, condition_id, transform_family, logit; ``clean``: sample_id, logit.
    """
    hardest = hardest_condition(candidates).select("sample_id", "condition_id")
    chosen = candidates.join(hardest, ["sample_id", "condition_id"]).select("sample_id", "label", F.col("logit").alias("transformed"))
    pairs = chosen.join(clean.select("sample_id", F.col("logit").alias("clean")), "sample_id")
    y = F.col("label").cast("double")
    each = pairs.agg(F.count("*").alias("n"), F.avg(bce(F.col("clean"), y)).alias("clean_loss"), F.avg(bce(F.col("transformed"), y)).alias("transformed_loss"), F.avg((F.col("clean") - F.col("transformed")) ** 2).alias("logit_consistency"))
    return each.withColumn("total", F.col("clean_loss") + F.col("transformed_loss") + logit_weight * F.col("logit_consistency"))


def stress_grid(samples: DataFrame, score: Callable[[DataFrame], DataFrame], checkpoint_id: str) -> DataFrame:
    """Stress predictions for every sample and stress condition, the clean score once for each sample.

    ``score`` takes rows of (sample_id, condition_id) and gives them back with ``logit``. The
    conditions are the fixed list of four.
    """
    spark = samples.sparkSession
    dim = stress_conditions(spark).select("condition_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("parameters")))).alias("transform_metadata"))
    grid = samples.crossJoin(F.broadcast(dim))
    clean = score(samples.select("sample_id").withColumn("condition_id", F.lit("clean"))).select("sample_id", F.round(sigmoid(F.col("logit")), 12).alias("clean_score"))
    logits = score(grid.select("sample_id", "condition_id")).select("sample_id", "condition_id", "logit")
    out = grid.join(logits, ["sample_id", "condition_id"]).join(clean, "sample_id")
    checked = F.when(finite(F.col("logit")), F.col("logit")).otherwise(F.raise_error(F.lit("a score isn't finite")).cast("double"))
    return out.withColumn("logit", checked).withColumn("score", F.round(sigmoid(F.col("logit")), 12)).withColumn("checkpoint_id", F.lit(checkpoint_id))
