"""Constraints as tables of violations, and the wrapper that raises on the first ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.errors import DataIntegrityError, LeakageError, MetricPartitionError, PolicyError, UserInputError
from siftwork.functions.exprs import finite, is_hash64, is_sha256, missing, number, sigmoid
from siftwork.sources.registry import FAMILIES, SPLITS

__all__ = ["DataIntegrityError", "LeakageError", "MetricPartitionError", "PolicyError", "UserInputError"]


def require_columns(df: DataFrame, *columns: str, where: str = "table") -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise DataIntegrityError(f"{where} lacks columns: {', '.join(absent)}")


def enforce(violations: DataFrame, error: type[Exception] = DataIntegrityError, what: str = "violations") -> None:
    """Raises ``error`` with the number of violations and three examples, if there are any."""
    n = violations.count()
    if n:
        examples = [r.asDict() for r in violations.orderBy(*violations.columns).limit(3).collect()]
        raise error(f"{n} {what}, among them {examples}")


def _broken(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that are true (or null) for a row."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules)))


def broken_rules() -> Column:
    """The names of the manifest's row contracts that a row breaks."""
    return _broken([
        ("blank sample_id", missing(F.col("sample_id"))),
        ("label", ~number(F.col("label")).isin(0.0, 1.0)),
        ("blank source_group_id", missing(F.col("source_group_id"))),
        ("width", ~(number(F.col("width")) > 0)),
        ("height", ~(number(F.col("height")) > 0)),
        ("content_checksum", ~is_sha256(F.col("content_checksum"))),
        ("perceptual_hash", ~is_hash64(F.col("perceptual_hash"))),
        ("split", ~F.col("split").isin(*SPLITS, "unassigned")),
    ])


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """sample_id, rule for every row contract of the manifest that doesn't hold; one pass."""
    return manifest.select("sample_id", F.explode(broken_rules()).alias("rule"))


def score_violations(scored: DataFrame) -> DataFrame:
    """sample_id, rule for every row contract of a prediction table that doesn't hold."""
    score, logit = number(F.col("score")), number(F.col("logit"))
    rules = [
        ("blank sample_id", missing(F.col("sample_id"))),
        ("label", ~number(F.col("label")).isin(0.0, 1.0)),
        ("logit", ~finite(logit)),
        ("score", ~(finite(score) & (score >= 0) & (score <= 1))),
        ("score is not the sigmoid of logit", ~(F.abs(score - sigmoid(logit)) <= 1e-9)),
        ("family", ~F.col("transform_family").isin("clean", *FAMILIES)),
        ("clean condition and family differ", (F.col("condition_id") == "clean") != (F.col("transform_family") == "clean")),
    ]
    return scored.select("sample_id", F.explode(_broken(rules)).alias("rule"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leaking_identities(assigned: DataFrame, *identities: str) -> DataFrame:
    """identity, value, n_splits for identities that stand in two splits or more; checksums without regard to case."""
    names = identities or ("content_checksum", "source_group_id", "split_group_id")
    value = lambda c: F.lower(F.col(c)) if c == "content_checksum" else F.col(c)
    pairs = F.array(*(F.struct(F.lit(c).alias("identity"), value(c).alias("value")) for c in names))
    rows = assigned.select("split", F.explode(pairs).alias("p")).select("split", "p.*")
    return rows.groupBy("identity", "value").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def ambiguous_conditions(scored: DataFrame) -> DataFrame:
    """condition_id, n_families of conditions that belong to more than one family."""
    return scored.where("condition_id <> 'clean'").groupBy("condition_id").agg(F.count_distinct("transform_family").alias("n_families")).where("n_families > 1")


def family_coverage(scored: DataFrame) -> DataFrame:
    """family, problem: expected families that don't occur and families that aren't expected."""
    seen = scored.where("condition_id <> 'clean'").select(F.col("transform_family").alias("family")).distinct()
    expected = scored.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    return expected.join(seen, "family", "left_anti").withColumn("problem", F.lit("missing")).unionByName(seen.join(F.broadcast(expected), "family", "left_anti").withColumn("problem", F.lit("unexpected")))


def policy_violations(manifest: DataFrame, policy: DataFrame, least_families: int = 3) -> DataFrame:
    """dataset_name, problem. ``policy``: dataset_name, approved, allow_real, allow_fake, generator_labelled; a row for each source.

    Families count where the source labels its generators; without that column, in every source.
    """
    labelled = F.coalesce("generator_labelled", F.lit(False)) if "generator_labelled" in policy.columns else F.lit(True)
    per = manifest.groupBy("dataset_name").agg(F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label") == 1).alias("fake"))
    joined = per.join(F.broadcast(policy), "dataset_name", "left")
    approved = F.coalesce("approved", F.lit(False))
    problems = F.array_compact(F.array(
        F.when(~approved, "source not approved"),
        F.when(approved & (F.col("real") > 0) & ~F.col("allow_real"), "real rows not allowed"),
        F.when(approved & (F.col("fake") > 0) & ~F.col("allow_fake"), "fake rows not allowed"),
    ))
    rows = joined.select("dataset_name", F.explode(problems).alias("problem"))
    family = F.when((F.col("label") == 1) & ~missing(F.col("generator_family")), F.trim("generator_family"))
    sources = policy.select("dataset_name", labelled.alias("names_generators")) if "generator_labelled" in policy.columns else None
    rated = manifest.join(F.broadcast(sources), "dataset_name", "left") if sources is not None else manifest.withColumn("names_generators", F.lit(True))
    whole = rated.agg(F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label") == 1).alias("fake"), F.count_distinct(F.when(F.col("names_generators"), family)).alias("families"))
    overall = F.array_compact(F.array(F.when(F.col("real") == 0, "no real rows"), F.when(F.col("fake") == 0, "no fake rows"), F.when(F.col("families") < least_families, "too few fake families")))
    return rows.unionByName(whole.select(F.lit("*").alias("dataset_name"), F.explode(overall).alias("problem")))


def score_partition_violations(scored: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """problem, n: splits that aren't asked for or aren't there, clean families under other conditions."""
    wrong = scored.agg(F.count_if(~F.col("split").isin(*splits)).alias("unexpected split"), *(F.when(F.count_if(F.col("split") == s) == 0, 1).otherwise(0).cast("long").alias(f"no rows of {s}") for s in splits), F.count_if((F.col("condition_id") == "clean") != (F.col("transform_family") == "clean")).alias("clean condition and family differ"))
    return wrong.unpivot([], list(wrong.columns), "problem", "n").where("n > 0")
