"""Leakage-safe splits over duplicate groups, capped selections, sampling weights and draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.errors import DataIntegrityError, LeakageError
from siftwork.functions.exprs import half_up_count
from siftwork.operators import checks
from siftwork.sources.shared import materialized


@dataclass(frozen=True)
class SplitPolicy:
    seed: int = 17
    validation_fraction: float = 0.10
    test_fraction: float = 0.10
    generator_validation_families: tuple[str, ...] = ()
    generator_test_families: tuple[str, ...] = ()
    generator_evaluation_real_fraction: float = 0.10
    minimum_holdout_family_rows: int = 100
    attempts: int = 100
    #: A group that links both holdouts is an error, or with True goes to the validation holdout as a whole, rows of test families too.
    keep_linked_holdouts: bool = False

    def __post_init__(self) -> None:
        if not (0 < self.validation_fraction < 1 and 0 < self.test_fraction < 1 and self.validation_fraction + self.test_fraction < 1):
            raise DataIntegrityError("split fractions must be positive and leave a training share")
        if bool(self.generator_validation_families) != bool(self.generator_test_families):
            raise DataIntegrityError("holdout families must be given for both partitions or for neither")
        if set(self.generator_validation_families) & set(self.generator_test_families):
            raise DataIntegrityError("holdout families must be disjoint")


def family_counts(manifest: DataFrame) -> DataFrame:
    return manifest.where("label = 1").groupBy("generator_family").agg(F.count("*").alias("n"))


def holdout_families(manifest: DataFrame, minimum_rows: int = 100) -> DataFrame:
    """generator_family, n, split: the largest fake family of enough rows is the test holdout, the second the validation holdout."""
    order = Window.orderBy(F.desc("n"), "generator_family")  # one row for each family
    placed = family_counts(manifest).where(F.col("n") >= minimum_rows).withColumn("place", F.row_number().over(order))
    return placed.where("place <= 2").select("generator_family", "n", F.when(F.col("place") == 1, "generator_test").otherwise("generator_validation").alias("split"))


def choose_holdouts(manifest: DataFrame, policy: SplitPolicy) -> tuple[list[str], list[str]]:
    """(validation families, test families); raises if there are too few. Families are control data: one row for each."""
    if policy.generator_validation_families:
        counts = {r["generator_family"]: r["n"] for r in family_counts(manifest).collect()}
        small = [f"{f}={counts.get(f, 0)}" for f in (*policy.generator_validation_families, *policy.generator_test_families) if counts.get(f, 0) < policy.minimum_holdout_family_rows]
        if small:
            raise DataIntegrityError(f"holdout families with too few rows: {', '.join(small)}")
        return list(policy.generator_validation_families), list(policy.generator_test_families)
    n = family_counts(manifest).count()
    if n < 3:
        raise DataIntegrityError(f"three fake families are needed, found {n}")
    found = {r["split"]: r["generator_family"] for r in holdout_families(manifest, policy.minimum_holdout_family_rows).collect()}
    if len(found) < 2:
        raise DataIntegrityError("two fake families of enough rows are needed")
    return [found["generator_validation"]], [found["generator_test"]]


def seeded(seed: int, *columns: str) -> Column:
    """A digest that orders rows by seed and key, the same on every engine and at every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def group_summary(grouped: DataFrame, validation_families: list[str], test_families: list[str]) -> DataFrame:
    """One row for each group: its labels and whether it holds rows of a holdout family."""
    fake = F.col("label") == 1
    return grouped.groupBy("split_group_id").agg(
        F.bool_or(F.col("label") == 0).alias("has_real"),
        F.bool_or(fake).alias("has_fake"),
        F.bool_or(fake & F.col("generator_family").isin(*validation_families)).alias("in_validation"),
        F.bool_or(fake & F.col("generator_family").isin(*test_families)).alias("in_test"),
    )


def _ordinal(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with at, from 1, in seeded order: ranks by digest prefix and within it, so that no task sorts them all."""
    keyed = rows.withColumn("digest", seeded(seed, "split_group_id")).withColumn("head", F.substring("digest", 1, 3))
    sizes = keyed.groupBy("head").agg(F.count("*").alias("n"))  # at most 4,096 rows
    before = sizes.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("head").orderBy("digest", "split_group_id"))
    return keyed.join(F.broadcast(before), "head").withColumn("at", F.col("before") + within).drop("digest", "head", "before")


def assign_groups(summary: DataFrame, policy: SplitPolicy) -> DataFrame:
    """split_group_id, split: holdouts by whole groups, real controls for holdouts without real rows, the rest three ways."""
    if not policy.keep_linked_holdouts:
        checks.enforce(summary.where("in_validation and in_test").select("split_group_id"), LeakageError, "groups link both holdouts")
    held = summary.where("in_validation or in_test").select("split_group_id", F.when(F.col("in_validation"), "generator_validation").otherwise("generator_test").alias("split"), "has_real")
    real = {r["split"]: r["r"] for r in held.groupBy("split").agg(F.bool_or("has_real").alias("r")).collect()}
    without = [s for s in ("generator_validation", "generator_test") if not real.get(s, False)]
    free = summary.where("not in_validation and not in_test")
    parts = [held.select("split_group_id", "split")]
    if without:
        real_only = _ordinal(free.where("has_real and not has_fake").select("split_group_id"), policy.seed)
        n = real_only.count()
        each = max(1, int(n * policy.generator_evaluation_real_fraction + 0.5))
        if n < each * len(without):
            raise DataIntegrityError(f"generator evaluation needs {each * len(without)} real groups, found {n}")
        chosen = F.when(F.col("at") <= each, without[0])
        if len(without) > 1:
            chosen = chosen.when(F.col("at") <= 2 * each, without[1])
        controls = materialized(real_only.select("split_group_id", chosen.alias("split")).where("split is not null"))
        parts.append(controls)
        free = free.join(controls, "split_group_id", "left_anti")
    return _three_ways(materialized(free), parts, policy)


def _three_ways(free: DataFrame, parts: list[DataFrame], policy: SplitPolicy) -> DataFrame:
    n = free.count()
    if n < 3:
        raise DataIntegrityError("three remaining groups are needed")
    test, validation = (max(1, int(n * f + 0.5)) for f in (policy.test_fraction, policy.validation_fraction))
    if test + validation >= n:
        raise DataIntegrityError("split fractions leave no training group")
    for offset in range(policy.attempts):
        band = F.when(F.col("at") <= test, "test").when(F.col("at") <= test + validation, "validation").otherwise("train")
        placed = materialized(_ordinal(free, policy.seed + offset).select("split_group_id", "has_real", "has_fake", band.alias("split")))
        both = placed.groupBy("split").agg((F.bool_or("has_real") & F.bool_or("has_fake")).alias("ok")).where("ok").count()
        if both == 3:
            out = placed.select("split_group_id", "split")
            for p in parts:
                out = out.unionByName(p)
            return out
    raise DataIntegrityError(f"{policy.attempts} seeds gave no split with both labels in each part")


def assign_splits(grouped: DataFrame, policy: SplitPolicy) -> DataFrame:
    """``grouped`` (with split_group_id) with split, checked: five parts, both labels in each, nothing leaks."""
    validation, test = choose_holdouts(grouped, policy)
    summary = materialized(group_summary(grouped, validation, test))
    assigned = materialized(grouped.drop("split").join(assign_groups(summary, policy), "split_group_id"))
    bad = assigned.groupBy("split").agg(F.count_distinct("label").alias("n")).where("n < 2")
    checks.enforce(bad, DataIntegrityError, "splits without both labels")
    checks.enforce(checks.leaking_identities(assigned), LeakageError, "identities cross splits")
    return assigned


def split_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("split_group_id").alias("n_groups"))


def first_per_group(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__at") <= n).drop("__at")


def parity_sample(manifest: DataFrame, n: int = 32, key: str = "sample_id") -> DataFrame:
    """The first ``n`` rows of validation and test by ``key``, for comparing two forms of a model; fewer are an error.

    A table has no file order, so the key takes its place.
    """
    found = materialized(manifest.where(F.col("split").isin("validation", "test")).orderBy(key).limit(n))
    if found.count() < n:
        raise DataIntegrityError(f"{n} validation or test rows are needed")
    return found


def sampling_weights(manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """``key``, weight: half of the mass for each label, equal shares for its strata (real: source; fake: source and family), equal within."""
    stratum = F.when(F.col("label") == 0, F.col("dataset_name")).otherwise(F.concat_ws("\x1f", "dataset_name", "generator_family"))
    rows = manifest.where("label in (0, 1)").select(key, "label", stratum.alias("stratum"))
    sizes = rows.groupBy("label", "stratum").agg(F.count("*").alias("n"))  # a row for each stratum
    strata = sizes.groupBy("label").agg(F.count("*").alias("k"))
    shares = sizes.join(F.broadcast(strata), "label").select("label", "stratum", (F.lit(0.5) / (F.col("k") * F.col("n"))).alias("weight"))
    return rows.join(shares, ["label", "stratum"]).select(key, "label", "weight")


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the first 52 bits of the seeded digest."""
    return F.conv(F.substring(seeded(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _distinct_sample(weighted: DataFrame, draws: int, seed: int, key: str) -> DataFrame:
    """draw, ``key``: the rows of positive weight with the least -ln(u) / weight, u in (0, 1] by each row's own digest."""
    rows = weighted.where("weight > 0").select(key, (-F.ln(1 - uniform(seed, key)) / F.col("weight")).alias("at"))
    n = rows.count()
    if n < draws:
        raise DataIntegrityError(f"{draws} draws without replacement need as many rows of positive weight, found {n}")
    ranked = rows.orderBy("at", key).select(key).rdd.zipWithIndex().filter(lambda r: r[1] < draws).map(lambda r: (r[1], r[0][0]))
    return weighted.sparkSession.createDataFrame(ranked, T.StructType([T.StructField("draw", T.LongType()), weighted.schema[key]]))


def weighted_sample(weighted: DataFrame, draws: int, seed: int, key: str = "sample_id", replacement: bool = True) -> DataFrame:
    """draw, ``key``: draws with replacement (or of distinct rows, without), in proportion to weight; draw k's uniform falls in one row's stretch of the running weights.

    The running sum is taken over digests' prefixes and within them; a draw is matched to a row by
    the bucket of 1/1024 that both touch, so the join is on equal keys.
    """
    if not replacement:
        return _distinct_sample(weighted, draws, seed, key)
    keyed = weighted.select(key, "weight", F.md5(F.col(key)).alias("d")).withColumn("head", F.substring("d", 1, 3))
    sums = materialized(keyed.groupBy("head").agg(F.sum("weight").alias("w")))  # at most 4,096 rows
    heads = Window.orderBy("head")
    upto = F.sum("w").over(heads.rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.select("head", upto.alias("after")).withColumn("before", F.coalesce(F.lag("after").over(heads), F.lit(0.0))).withColumn("total", F.max("after").over(Window.partitionBy(F.lit(0))))
    # a row's stretch begins where the one before ends, by the same number, so that no draw falls between two
    rows = Window.partitionBy("head").orderBy("d", key)
    run = F.sum("weight").over(rows.rowsBetween(Window.unboundedPreceding, 0))
    edged = keyed.join(F.broadcast(ends), "head").withColumn("edge", F.least(F.col("before") + run, "after"))
    last = F.lead("d").over(rows).isNull()
    spans = edged.withColumn("hi", F.when(last, F.col("after")).otherwise(F.col("edge")) / F.col("total")).withColumn("lo", F.coalesce(F.lag("edge").over(rows), "before") / F.col("total"))
    cut = lambda c: F.least(F.lit(1023), F.greatest(F.lit(0), F.floor(F.col(c) * 1024))).cast("int")
    left = spans.select(key, "lo", "hi", F.explode(F.sequence(cut("lo"), cut("hi"))).alias("bucket"))
    points = weighted.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("u", uniform(seed, "draw")).withColumn("bucket", F.least(F.lit(1023), F.floor(F.col("u") * 1024)).cast("int"))
    return points.join(left, "bucket").where("u >= lo and u < hi").groupBy("draw").agg(F.min(key).alias(key))


__all__ = ["SplitPolicy", "assign_splits", "half_up_count"]
