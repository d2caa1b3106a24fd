import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftwork import plans
from siftwork.errors import DataIntegrityError, LeakageError
from siftwork.operators import audit, checks, graph, groups, split
from siftwork.operators.graph import connected_components
from siftwork.sources import shared, views

AUDIT = [
    (0, "sid", "authentic", "PNG", 100, 50, "a", "known"),
    (0, "sid", "authentic", "PNG", 200, 100, "b", None),
    (1, "wild", "flux", "JPEG", 300, 150, "c", ""),
    (1, "wild", "sdxl", "JPEG", 400, 200, "c", "known"),
    (1, "wild", "sdxl", "PNG", 500, 250, "", "known"),
]
AUDIT_SCHEMA = "label int, dataset_name string, generator_family string, file_format string, width int, height int, content_checksum string, optional_metadata string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_audit(spark):
    df = spark.createDataFrame(AUDIT, AUDIT_SCHEMA)
    assert rows(audit.class_counts(df)) == [(0, 2), (1, 3)]
    counts = {(c, v): n for c, v, n in rows(audit.value_counts(df, "dataset_name", "generator_family"))}
    assert counts == {("dataset_name", "wild"): 3, ("dataset_name", "sid"): 2, ("generator_family", "authentic"): 2, ("generator_family", "sdxl"): 2, ("generator_family", "flux"): 1}
    assert rows(audit.quantiles(df, "width")) == [("width", 100.0, 200.0, 300.0, 400.0, 500.0)]
    assert sorted(rows(audit.label_crosstab(df))) == [("JPEG", 0, 2), ("PNG", 2, 1)]
    missing = dict(rows(audit.missing_counts(df, "perceptual_hash")))
    assert (missing["optional_metadata"], missing["content_checksum"], missing["perceptual_hash"]) == (2, 1, 5)
    assert rows(audit.duplicate_count(df)) == [(1,)]
    assert dict(rows(audit.label_shortcuts(df, "dataset_name", "file_format"))) == {"dataset_name": True, "file_format": False}


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], AUDIT_SCHEMA)
    assert rows(audit.class_counts(df)) == [] and rows(audit.duplicate_count(df)) == [(0,)]
    assert rows(audit.quantiles(df, "width")) == [("width", None, None, None, None, None)]
    assert dict(rows(audit.label_shortcuts(df, "dataset_name"))) == {"dataset_name": False}


def closure(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src int, dst int"))))
    want = closure(400, edges)
    assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}


def sample(i, **over):
    base = {"sample_id": i, "label": 1, "generator_family": "f", "source_group_id": f"s-{i}", "content_checksum": hashlib.sha256(f"checksum:{i}".encode()).hexdigest(), "perceptual_hash": hashlib.sha256(f"phash:{i}".encode()).hexdigest()[:16]}
    return base | over


SCHEMA = "sample_id string, label int, generator_family string, source_group_id string, content_checksum string, perceptual_hash string"


def grouped(spark, samples, radius):
    df = spark.createDataFrame(samples, SCHEMA)
    return dict(rows(groups.split_groups(df, radius).select("sample_id", "split_group_id")))


def test_mixed_chain_is_one_group(spark):
    h = "0" * 16
    got = grouped(spark, [sample("a", source_group_id="g"), sample("b", source_group_id="g", content_checksum="A" * 64), sample("c", content_checksum="a" * 64, perceptual_hash=h), sample("d", perceptual_hash="000000000000000f"), sample("e", source_group_id="G")], 4)
    first = "split-" + hashlib.sha256(b"a").hexdigest()[:16]
    assert [got[i] for i in "abcd"] == [first] * 4 and got["e"] != first


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6, 8])
def test_radius_join_equals_brute_force(spark, radius):
    rng = random.Random(radius)
    values = [0, 1, 3, 0xF, 0xFF, 1 << 63, 3 << 62, 2**64 - 1]
    for _ in range(60):
        v = rng.choice(values)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    df = spark.createDataFrame([(f"{v:016x}",) for v in values], "perceptual_hash string")
    got = sorted(rows(groups.hash_pairs(df, radius)))
    distinct = sorted({f"{v:016x}" for v in values})
    want = [(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for i, a in enumerate(distinct) for b in distinct[i + 1 :]]
    assert got == [w for w in want if w[2] <= radius]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_and_manifest_go_around_the_driver(spark, tmp_path):
    df = spark.createDataFrame([(f"{v:016x}",) for v in (1, 3, 1 << 40)], "perceptual_hash string")
    assert "Broadcast" not in executed(groups.hash_pairs(df, 4))
    plan = executed(views.manifest(spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan and plan.index("SortMergeJoin") < plan.index("md5(")  # digests are taken below the join


def test_groups_go_around_the_driver(spark, monkeypatch):
    plans, written = [], shared.materialized

    def seen(df):
        plans.append(executed(df))
        return written(df)

    for module in (shared, groups, graph):
        monkeypatch.setattr(module, "materialized", seen)
    h = "0" * 16
    df = spark.createDataFrame([sample("a", source_group_id="g"), sample("b", source_group_id="g", content_checksum="a" * 64), sample("c", content_checksum="a" * 64, perceptual_hash=h), sample("d", perceptual_hash="0" * 15 + "1")], SCHEMA)
    out = groups.split_groups(df, 4)
    assert out.select("split_group_id").distinct().count() == 1
    assert len(plans) > 5 and all("Broadcast" not in p for p in [*plans, executed(out)])


def test_masks_hold_all_pairs_within_the_radius():
    rng = random.Random(3)
    for radius in (0, 1, 2, 4, 8, 20, 63):
        masks = groups.band_masks(radius)
        assert len(masks) <= groups.MOST_KEYS and all(0 < m < 1 << 64 for m in masks)
        for _ in range(200):
            moved = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(moved & m == 0 for m in masks)
    assert len(groups.band_masks(4)) == 70 and all(m.bit_count() == 32 for m in groups.band_masks(4))


def families(spark, sizes, real=60):
    data = [sample(f"{f}:{i:03d}", generator_family=f) for f, n in sizes.items() for i in range(n)]
    data += [sample(f"real:{i:03d}", label=0, generator_family="authentic") for i in range(real)]
    return spark.createDataFrame(data, SCHEMA)


def test_holdouts(spark):
    df = families(spark, {"zeta": 101, "beta": 120, "alpha": 120})
    assert split.choose_holdouts(df, split.SplitPolicy()) == (["beta"], ["alpha"])
    with pytest.raises(DataIntegrityError, match="found 2"):
        split.choose_holdouts(families(spark, {"a": 100, "b": 100}), split.SplitPolicy())


def test_split_assignment(spark):
    df = families(spark, {"alpha": 30, "beta": 30, "gamma": 30})
    linked = df.withColumn("source_group_id", F.when(F.col("sample_id") == "gamma:000", "s-alpha:000").otherwise(F.col("source_group_id")))
    policy = split.SplitPolicy(minimum_holdout_family_rows=30, validation_fraction=0.15, test_fraction=0.15)
    out = split.assign_splits(groups.split_groups(linked, 4), policy)
    got = dict(rows(out.select("sample_id", "split")))
    again = dict(rows(split.assign_splits(groups.split_groups(linked.repartition(3), 4), policy).select("sample_id", "split")))
    assert got == again and set(got.values()) == {"train", "validation", "test", "generator_validation", "generator_test"}
    assert {got[f"alpha:{i:03d}"] for i in range(30)} == {"generator_test"} == {got["gamma:000"]}
    assert {got[f"beta:{i:03d}"] for i in range(30)} == {"generator_validation"}
    assert rows(checks.leaking_identities(out)) == []
    crossed = df.withColumn("content_checksum", F.when(F.col("sample_id").isin("alpha:000", "beta:000"), "a" * 64).otherwise(F.col("content_checksum")))
    with pytest.raises(LeakageError):
        split.assign_splits(groups.split_groups(crossed, 4), policy)


def test_linked_holdouts_go_to_validation_as_a_whole(spark):
    df = families(spark, {"alpha": 30, "beta": 30, "gamma": 30})
    crossed = df.withColumn("content_checksum", F.when(F.col("sample_id").isin("alpha:000", "beta:000"), "a" * 64).otherwise(F.col("content_checksum")))
    policy = split.SplitPolicy(minimum_holdout_family_rows=30, validation_fraction=0.15, test_fraction=0.15, keep_linked_holdouts=True)
    out = split.assign_splits(groups.split_groups(crossed, 4), policy)
    got = dict(rows(out.select("sample_id", "split")))
    assert len(got) == df.count() and got["alpha:000"] == "generator_validation" == got["beta:000"]
    assert {got[f"alpha:{i:03d}"] for i in range(1, 30)} == {"generator_test"}
    assert rows(checks.leaking_identities(out)) == []


def test_split_assignment_keeps_linked_holdouts(spark, tmp_path):
    """Of two texts of the holdout families with a first line in common, the query makes one group, as its SQL does."""
    data = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3] if i < 90 else "en"
        text = f"first {i if i > 1 else 'line'}\n" + "".join(hashlib.sha256(f"{i}:{k}".encode()).hexdigest() for k in range(9))
        data.append((i, text, lang, "s", len(text), 1, int(i < 90)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    df.drop("quality", "toxic").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["sample_id"]: r["split"] for r in plans.QUERIES["split_assignment"](spark, str(tmp_path)).collect()}
    # all families have 30 rows, so the first two by name are held out
    assert len(got) == 120 and got["doc-0"] == got["doc-1"] == "generator_validation"
    assert {got[f"doc-{i}"] for i in range(4, 90, 3)} == {"generator_test"} and {got[f"doc-{i}"] for i in range(3, 90, 3)} == {"generator_validation"}


def test_sampling_weights(spark):
    data = list(zip("abcdefghi", [0, 0, 0, 1, 1, 1, 1, 1, 1], ["sid", "sid", "camera", "wild", "wild", "wild", "wild", "other", "other"], ["authentic"] * 3 + ["sdxl"] * 3 + ["flux"] + ["sdxl"] * 2, strict=True))
    df = spark.createDataFrame(data, "sample_id string, label int, dataset_name string, generator_family string")
    got = [w for _, w in sorted(rows(split.sampling_weights(df).select("sample_id", "weight")))]
    assert got == pytest.approx([1 / 8, 1 / 8, 1 / 4, 1 / 18, 1 / 18, 1 / 18, 1 / 6, 1 / 12, 1 / 12])
    draws = dict(rows(split.weighted_sample(split.sampling_weights(df), 6000, 5).groupBy("sample_id").count()))
    assert sum(draws.values()) == 6000 and all(abs(draws[i] / 6000 - w) < 0.03 for i, w in zip("abcdefghi", got, strict=True))


def test_first_per_group(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, k int")
    assert sorted(rows(split.first_per_group(df, ["k"], ["i"], 2))) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 2)]


def test_enforce_names_examples(spark):
    df = spark.createDataFrame([(" ", "2")], "sample_id string, label string")
    with pytest.raises(DataIntegrityError, match="1 violations"):
        checks.enforce(df)
    with pytest.raises(DataIntegrityError, match="lacks columns: b"):
        checks.require_columns(df, "label", "b")


def test_sample_without_replacement(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("sample_id"), F.when(F.col("id") % 3 == 0, 4.0).when(F.col("id") < 10, 0.0).otherwise(1.0).alias("weight"))
    weight = {r["sample_id"]: r["weight"] for r in rows.collect()}
    got = split.weighted_sample(rows.repartition(3), 300, 7, replacement=False).collect()
    assert sorted(r["draw"] for r in got) == list(range(300)) and len({r["sample_id"] for r in got}) == 300
    heavy = sum(weight[r["sample_id"]] == 4.0 for r in got)
    assert all(weight[r["sample_id"]] > 0 for r in got) and 160 < heavy < 240  # two thirds of the mass, some of it used up
    assert sorted(got) == sorted(split.weighted_sample(rows.repartition(7), 300, 7, replacement=False).collect())
    positive = sum(w > 0 for w in weight.values())
    assert split.weighted_sample(rows, positive, 7, replacement=False).select("sample_id").distinct().count() == positive
    with pytest.raises(DataIntegrityError, match="without replacement"):
        split.weighted_sample(rows, positive + 1, 7, replacement=False)


def test_families_count_where_sources_label_generators(spark):
    df = spark.createDataFrame([("a", 0, "authentic"), ("a", 1, "f"), ("b", 1, "g"), ("b", 1, " f "), ("c", 1, "h")], "dataset_name string, label int, generator_family string")
    few = ("*", "too few fake families")
    policy = "dataset_name string, approved boolean, allow_real boolean, allow_fake boolean"
    found = lambda flags, least: rows(checks.policy_violations(df, spark.createDataFrame([(n, True, True, True, g) for n, g in flags], policy + ", generator_labelled boolean"), least))
    assert found([("a", True), ("b", True), ("c", True)], 3) == [] and found([("a", True), ("b", True), ("c", False)], 3) == [few]
    assert found([("a", True), ("b", True), ("c", False)], 2) == [] and found([("a", False), ("b", None), ("c", True)], 2) == [few]
    assert rows(checks.policy_violations(df, spark.createDataFrame([(n, True, True, True) for n in "abc"], policy), 3)) == []


def test_every_draw_finds_a_row(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("sample_id"), (1 / (3 + F.col("id") % 7)).alias("weight"))
    out = split.weighted_sample(df, draws=20_000, seed=3)
    assert out.count() == 20_000 and out.select("draw").distinct().count() == 20_000


def test_parity_sample(spark):
    df = spark.createDataFrame([(f"s{i:03d}", ("train", "test", "validation")[i % 3]) for i in range(60)], "sample_id string, split string")
    got = [r["sample_id"] for r in split.parity_sample(df.repartition(3)).collect()]
    assert sorted(got) == [f"s{i:03d}" for i in range(60) if i % 3][:32]
    with pytest.raises(DataIntegrityError, match="41 validation"):
        split.parity_sample(df, 41)
