"""Exact ROC AUC with ties, roll-ups over conditions and families, stress shifts, confusion, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.exprs import composite, order_bucket
from siftwork.sources.registry import FAMILIES
from siftwork.sources.shared import materialized


def roc_auc(scored: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """``by``, roc_auc, n_positive, n_negative: the exact area, ties counting half; null with one class only.

    Scores are first aggregated to one row for each distinct score, with map-side combination. The
    running count of negatives is that of the buckets below (``order_bucket``) and that within the
    score's own bucket, so that no task sorts all scores of a group.
    """
    keys, bucketed = list(by), order_bucket(F.col("__s")).alias("__bucket")
    level = scored.groupBy(*keys, F.col(score).alias("__s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n")).select("*", bucketed)
    sums = level.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    other = before.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__other"), "__before")
    same = F.col("__bucket") == F.col("__other")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__bucket").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    level = level.join(other, same).select(*keys, "__s", "p", "n", "__bucket", "__before")
    below = F.col("__before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    ranked = level.withColumn("won", F.col("p") * (2 * below + F.col("n")))
    total = ranked.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    return total.select(*keys, F.try_divide(F.col("won").cast("double"), (2 * F.col("n_positive") * F.col("n_negative")).cast("double")).alias("roc_auc"), "n_positive", "n_negative")


def condition_auc(scored: DataFrame, split: str) -> DataFrame:
    return roc_auc(scored.where(F.col("split") == split), "condition_id", "transform_family", score="milli" if "milli" in scored.columns else "score")


def rollup(scored: DataFrame, split: str = "validation", unseen_split: str = "generator_validation", each: DataFrame | None = None) -> DataFrame:
    """metric, value: clean, each family, macro, pooled, worst family, worst condition, unseen, composite.

    A family is the mean of its conditions and macro the mean of the families, which isn't the
    pooled area over all rows. ``each``: the areas of ``condition_auc``, if they are there already.
    """
    score = "milli" if "milli" in scored.columns else "score"
    each = materialized(condition_auc(scored, split)) if each is None else each  # a row for each condition, read many times
    robust = each.where("condition_id <> 'clean'")
    families = robust.groupBy("transform_family").agg(F.avg("roc_auc").alias("value"))
    summary = families.agg(F.avg("value").alias("macro"), F.min("value").alias("worst_family"))
    worst = robust.agg(F.min("roc_auc").alias("value"))
    clean = each.where("condition_id = 'clean'").agg(F.max("roc_auc").alias("value"))
    pooled = roc_auc(scored.where((F.col("split") == split) & (F.col("condition_id") != "clean")), score=score)
    unseen = roc_auc(scored.where((F.col("split") == unseen_split) & (F.col("condition_id") == "clean")), score=score)
    named = lambda df, name, value: df.select(F.lit(name).alias("metric"), F.col(value).alias("value"))
    out = named(clean, "clean", "value").unionByName(families.select(F.concat(F.lit("family:"), F.col("transform_family")).alias("metric"), "value"))
    for df, name, value in ((summary, "macro_robust", "macro"), (pooled, "pooled_robust", "roc_auc"), (summary, "worst_family", "worst_family"), (worst, "worst_condition", "value"), (unseen, "unseen_generator", "roc_auc")):
        out = out.unionByName(named(df, name, value))
    both = clean.select(F.col("value").alias("c")).join(summary, F.lit(True))  # one row each
    return out.unionByName(both.select(F.lit("composite").alias("metric"), composite(F.col("c"), F.col("macro")).alias("value")))


def metric_rows(scored: DataFrame, split: str = "validation", unseen_split: str = "generator_validation") -> DataFrame:
    """ordinal, partition, roc_auc in report order: clean, families, conditions by name, summaries."""
    spark = scored.sparkSession
    areas = materialized(condition_auc(scored, split))
    rows = rollup(scored, split, unseen_split, areas)
    order = [("clean", "Clean"), *((f"family:{k}", v) for k, v in FAMILIES.items())]
    last = [("macro_robust", "Macro robust"), ("pooled_robust", "Pooled robust"), ("worst_family", "Worst family"), ("worst_condition", "Worst condition"), ("unseen_generator", "Unseen generator"), ("composite", "Composite")]
    names = spark.createDataFrame([(k, v, i, "") for i, (k, v) in enumerate(order)] + [(k, v, 1000 + i, "") for i, (k, v) in enumerate(last)], "metric string, partition string, place int, tie string")
    fixed = rows.join(F.broadcast(names), "metric").select("partition", F.col("value").alias("roc_auc"), "place", "tie")
    each = areas.where("condition_id <> 'clean'").select(F.concat(F.lit("Condition: "), F.col("condition_id")).alias("partition"), "roc_auc", F.lit(500).alias("place"), F.col("condition_id").alias("tie"))
    ordered = Window.orderBy("place", "tie")  # a report: a few rows for each condition
    return fixed.unionByName(each).select(F.row_number().over(ordered).cast("long").alias("ordinal"), "partition", "roc_auc")


def with_clean_score(scored: DataFrame) -> DataFrame:
    """``scored`` with clean_score: the score of the same checkpoint, split and sample under the clean condition; keys match null to null."""
    clean = scored.where("condition_id = 'clean'").groupBy("checkpoint_id", "split", "sample_id").agg(F.max("score").alias("clean_score"))
    c = clean.select(*(F.col(k).alias(f"__{k}") for k in ("checkpoint_id", "split", "sample_id")), "clean_score")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in ("checkpoint_id", "split", "sample_id")]
    return scored.join(c, same, "left").drop("__checkpoint_id", "__split", "__sample_id")


def stress_shift(scored: DataFrame) -> DataFrame:
    """condition_id, roc_auc, and mean, median and mean absolute difference to the clean score."""
    joined = with_clean_score(scored).where("condition_id <> 'clean'")
    shift = F.col("score") - F.col("clean_score")
    moved = joined.groupBy("condition_id").agg(F.avg(shift).alias("mean_shift"), F.median(shift).alias("median_shift"), F.avg(F.abs(shift)).alias("mean_abs_shift"))
    return roc_auc(joined, "condition_id", score="milli" if "milli" in scored.columns else "score").select("condition_id", "roc_auc").join(moved, "condition_id")


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1; a ratio of nothing is 0."""
    hit = F.col("score") >= F.lit(float(threshold))
    n = scored.agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 0)).alias("tn"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return n.select("tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def operating_threshold(scored: DataFrame) -> DataFrame:
    """threshold, youden_j: the greatest J; within 1e-12 of it the score nearest to 0.5, then the highest.

    Points inside a straight stretch of the curve are dropped first, so that a tie falls on its ends.
    """
    level = scored.groupBy(F.col("score").alias("s")).agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((1 - F.col("label")).cast("long")).alias("n")).withColumn("bucket", order_bucket(F.col("s")))
    # a row for each bucket: what lies above it, its number of scores, and the first score of the next
    each = level.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"), F.count("*").alias("k"), F.max_by(F.struct("p", "n"), "s").alias("top"))
    down, total = Window.orderBy(F.desc("bucket")), Window.partitionBy(F.lit(0))
    above = lambda c: F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    sums = each.select("bucket", above("bp").alias("tp0"), above("bn").alias("fp0"), above("k").alias("at0"), F.lead("top").over(down).alias("next_top"), F.sum("bp").over(total).alias("all_p"), F.sum("bn").over(total).alias("all_n"))
    inner = Window.partitionBy("bucket").orderBy(F.desc("s"))
    upto = lambda c: F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    curve = level.join(sums, "bucket").withColumn("tp", F.col("tp0") + upto("p")).withColumn("fp", F.col("fp0") + upto("n")).withColumn("at", F.col("at0") + F.row_number().over(inner))
    curve = curve.withColumn("after", F.coalesce(F.lead(F.struct("p", "n")).over(inner), F.col("next_top")))
    straight = (F.col("at") > 1) & F.col("after").isNotNull() & (F.col("after.p") == F.col("p")) & (F.col("after.n") == F.col("n"))
    kept = curve.where(~F.coalesce(straight, F.lit(False)))
    scored_j = kept.select("s", "at", (F.try_divide(F.col("tp").cast("double"), F.col("all_p").cast("double")) - F.try_divide(F.col("fp").cast("double"), F.col("all_n").cast("double"))).alias("youden_j"))
    best = scored_j.agg(F.max("youden_j").alias("j"))  # one row
    near = scored_j.where(F.col("youden_j") >= best.scalar() - 1e-12)
    return near.orderBy(F.abs(F.col("s") - 0.5), "at").limit(1).select(F.col("s").alias("threshold"), "youden_j")


def candidates(scored: DataFrame, split: str = "validation", unseen_split: str = "generator_validation") -> DataFrame:
    """A row of metrics for each checkpoint."""
    score = "milli" if "milli" in scored.columns else "score"
    each = materialized(roc_auc(scored.where(F.col("split") == split), "checkpoint_id", "condition_id", "transform_family", score=score))
    clean = each.where("condition_id = 'clean'").select("checkpoint_id", F.col("roc_auc").alias("clean_auc"))
    family = each.where("condition_id <> 'clean'").groupBy("checkpoint_id", "transform_family").agg(F.avg("roc_auc").alias("a"))
    macro = family.groupBy("checkpoint_id").agg(F.avg("a").alias("macro_robust_auc"), F.min("a").alias("worst_family_auc"))
    unseen = roc_auc(scored.where((F.col("split") == unseen_split) & (F.col("condition_id") == "clean")), "checkpoint_id", score=score).select("checkpoint_id", F.col("roc_auc").alias("unseen_auc"))
    return clean.join(macro, "checkpoint_id").join(unseen, "checkpoint_id", "left").withColumn("unseen_auc", F.coalesce("unseen_auc", F.lit(0.0)))


def rank_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with composite_score and place: composite, worst family, unseen, fewer parameters, then the later id."""
    order = [F.desc("composite_score"), F.desc("worst_family_auc"), F.desc("unseen_auc")]
    if "parameter_count" in rows.columns:
        order.append(F.asc("parameter_count"))
    ranked = rows.withColumn("composite_score", composite(F.col("clean_auc"), F.col("macro_robust_auc")))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order, F.desc("checkpoint_id"))).cast("long"))  # a handful of checkpoints
