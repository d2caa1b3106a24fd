"""Error cases: the worst false positives and negatives and the least stable samples; choice of the hardest condition."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.exprs import correct_margin, stable_seed_value
from siftwork.operators.metrics import with_clean_score


def first_of_each(scored: DataFrame) -> DataFrame:
    """One row for each (checkpoint, split, sample, condition): the one of least score, then label."""
    w = Window.partitionBy("checkpoint_id", "split", "sample_id", "condition_id").orderBy("score", "label")
    return scored.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def false_positives(scored: DataFrame, n: int = 20, threshold: float = 0.5) -> DataFrame:
    rows = first_of_each(scored).where((F.col("condition_id") == "clean") & (F.col("label") == 0) & (F.col("score") >= threshold))
    return rows.orderBy(F.desc("score"), "sample_id", "checkpoint_id", "split").limit(n)


def false_negatives(scored: DataFrame, n: int = 20, threshold: float = 0.5) -> DataFrame:
    rows = first_of_each(scored).where((F.col("condition_id") == "clean") & (F.col("label") == 1) & (F.col("score") < threshold))
    return rows.orderBy(F.asc("score"), "sample_id", "checkpoint_id", "split").limit(n)


def most_unstable(scored: DataFrame, n: int = 20) -> DataFrame:
    """With change, the absolute difference to the clean score; rows without a clean score are left out."""
    joined = with_clean_score(first_of_each(scored)).where("condition_id <> 'clean' and clean_score is not null")
    return joined.withColumn("change", F.round(F.abs(F.col("score") - F.col("clean_score")), 9)).orderBy(F.desc("change"), "sample_id", "condition_id", "checkpoint_id", "split").limit(n)


def hardest_condition(scored: DataFrame, order: str = "condition_id") -> DataFrame:
    """sample_id, condition_id, margin: the condition of least correct margin, the first by ``order`` where two are equal."""
    logit = "milli" if "milli" in scored.columns else "logit"
    rows = scored.where("condition_id <> 'clean'").withColumn("margin", correct_margin(F.col(logit), F.col("label")))
    least = rows.groupBy("sample_id").agg(F.min(F.struct("margin", F.col(order).alias("place"), "condition_id", "transform_family")).alias("m"))
    return least.select("sample_id", "m.condition_id", "m.transform_family", "m.margin")


def mined_condition(candidates: DataFrame, epoch: int, seed: int, exploration: float = 0.20) -> DataFrame:
    """sample_id, condition_id, transform_family, margin, explored: the candidate of least correct margin, the first by ``ordinal`` where two are equal;
    with probability ``exploration``, by the sample's own seed, a random candidate in its place.

    ``candidates``: sample_id, ordinal, condition_id, transform_family, label, logit.
    """
    if not 0 <= exploration <= 1:
        raise ValueError("exploration must be from 0 to 1")

    def explore(ids: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(k: str, n: int) -> int:
            rng = random.Random(stable_seed_value(seed, epoch, k, "explore"))
            return rng.randrange(n) if rng.random() < exploration else -1

        return pd.Series([one(k, n) for k, n in zip(ids, sizes, strict=True)], dtype="int32")

    margin = correct_margin(F.col("logit"), F.col("label")).alias("margin")
    each = candidates.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "condition_id", "transform_family", margin))).alias("c"))
    drawn = each.withColumn("draw", F.pandas_udf(explore, "int")("sample_id", F.size("c")))
    least = F.array_min(F.transform("c", lambda x, i: F.struct(x["margin"].alias("margin"), i.alias("i"))))["i"]
    chosen = drawn.withColumn("m", F.get("c", F.when(F.col("draw") < 0, least).otherwise(F.col("draw"))))
    return chosen.select("sample_id", "m.condition_id", "m.transform_family", "m.margin", (F.col("draw") >= 0).alias("explored"))


def family_proportions(selected: DataFrame, warn_above: float = 0.6) -> DataFrame:
    """transform_family, n, share, dominates."""
    each = selected.groupBy("transform_family").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each family
    return each.withColumn("share", F.round(share, 9)).withColumn("dominates", share > warn_above)
