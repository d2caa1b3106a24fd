import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.errors import DataIntegrityError
from siftwork.operators import calibrate, cases, images, metrics

# known answers
SCORES = {
    ("clean", "clean"): (0.1, 0.2, 0.8, 0.9),
    ("jpeg_q90", "jpeg"): (0.1, 0.4, 0.6, 0.9),
    ("jpeg_q30", "jpeg"): (0.7, 0.8, 0.2, 0.3),
    ("blur_s0.5", "blur"): (0.1, 0.2, 0.8, 0.9),
    ("resize_x0.5", "resize"): (0.1, 0.7, 0.3, 0.9),
    ("noise_s0.02", "noise"): (0.6, 0.7, 0.3, 0.4),
    ("color_jitter_20", "color_jitter"): (0.1, 0.4, 0.6, 0.9),
    ("center_crop_80", "center_crop"): (0.2, 0.6, 0.4, 0.8),
}
SCHEMA = "sample_id string, label int, score double, split string, transform_family string, condition_id string, checkpoint_id string"


@pytest.fixture()
def predictions(spark):
    data = [(f"s{i}", label, s[i], "validation", fam, c, "k") for (c, fam), s in SCORES.items() for i, label in enumerate((0, 0, 1, 1))]
    data += [(f"g{i}", label, s, "generator_validation", "clean", "clean", "k") for i, (label, s) in enumerate(zip((0, 0, 1, 1), (0.15, 0.25, 0.75, 0.85), strict=True))]
    return spark.createDataFrame(data, SCHEMA)


def test_rollup(predictions):
    got = {r["metric"]: r["value"] for r in metrics.rollup(predictions).collect()}
    want = {"clean": 1.0, "family:jpeg": 0.5, "family:blur": 1.0, "family:resize": 0.75, "family:noise": 0.0, "family:color_jitter": 1.0, "family:center_crop": 0.75, "macro_robust": 4 / 6, "worst_family": 0.0, "worst_condition": 0.0, "unseen_generator": 1.0, "composite": 0.5 + 2 / 6}
    assert {k: got[k] for k in want} == pytest.approx(want)
    order = [r["partition"] for r in metrics.metric_rows(predictions).orderBy("ordinal").collect()]
    assert order[:3] == ["Clean", "JPEG", "Blur"] and order[-1] == "Composite" and order[7].startswith("Condition: blur")


def test_published_macro(spark):
    """The mean of family means over published areas, to four digits."""
    areas = {"jpeg": (0.9974, 0.9972, 0.9968, 0.9966), "blur": (0.9973, 0.9971, 0.9971), "resize": (0.9970, 0.9970), "noise": (0.9978, 0.9973, 0.9970), "color": (0.9973,), "crop": (0.9970,)}
    df = spark.createDataFrame([(f, a) for f, v in areas.items() for a in v], "f string, a double")
    assert round(df.groupBy("f").agg(F.avg("a").alias("m")).agg(F.avg("m")).first()[0], 4) == 0.9971


def test_auc_equals_pair_counting(spark):
    rng = random.Random(2)
    data = [(g, rng.randrange(2), rng.randrange(9) / 8) for g in "ab" for _ in range(80)]
    got = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(spark.createDataFrame(data, "g string, label int, score double"), "g").collect()}
    for g in "ab":
        p, n = ([s for k, y, s in data if k == g and y == label] for label in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)))
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()["roc_auc"] is None


def test_confusion_of_published_counts(spark):
    data = [(1, 1.0)] * 51 + [(0, 1.0)] * 14 + [(1, 0.0)] * 2 + [(0, 0.0)] * 939
    r = metrics.confusion(spark.createDataFrame(data, "label int, score double"), 0.905192).first()
    assert [round(r[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == [0.9841, 0.7846, 0.9623, 0.8644]
    none = metrics.confusion(spark.createDataFrame([(0, 0.1)], "label int, score double"), 0.5).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("scores", "labels", "lo", "hi"), [((0.05, 0.2, 0.7, 0.95), (0, 0, 1, 1), 0.2, 0.7), ((0.1, 0.4, 0.6, 0.9), (0, 1, 0, 1), 0.39, 0.4)])
def test_threshold(spark, scores, labels, lo, hi):
    df = spark.createDataFrame(list(zip(scores, labels, strict=True)), "score double, label int")
    assert lo < metrics.operating_threshold(df).first()["threshold"] <= hi


def test_stress_shift(spark):
    data = [("a", 0, 0.10, "clean"), ("b", 1, 0.90, "clean"), ("a", 0, 0.15, "webp_q80"), ("b", 1, 0.82, "webp_q80")]
    df = spark.createDataFrame(data, "sample_id string, label int, score double, condition_id string").withColumn("split", F.lit("s")).withColumn("checkpoint_id", F.lit(None).cast("string"))
    r = metrics.stress_shift(df).first()
    assert (r["roc_auc"], round(r["mean_shift"], 6), round(r["mean_abs_shift"], 6)) == (1.0, -0.015, 0.065)


def test_ranking(spark):
    data = [("E0", 0.8340, 0.8247, 0.8182, 0.9313), ("E1", 0.9780, 0.9764, 0.9708, 0.9948), ("E2", 0.9844, 0.9821, 0.9768, 1.0), ("E3", 0.9732, 0.9702, 0.9648, 0.9979), ("E4", 0.9676, 0.9663, 0.9628, 0.9958)]
    columns = "checkpoint_id string, clean_auc double, macro_robust_auc double, worst_family_auc double, unseen_auc double"
    got = [r["checkpoint_id"] for r in metrics.rank_candidates(spark.createDataFrame(data, columns)).orderBy("place").collect()]
    assert got == ["E2", "E1", "E3", "E4", "E0"]
    ties = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 5), ("b", 1.0, 1.0, 1.0, 1.0, 5), ("c", 1.0, 1.0, 1.0, 1.0, 9)], columns + ", parameter_count long")
    assert [r["checkpoint_id"] for r in metrics.rank_candidates(ties).orderBy("place").collect()] == ["b", "a", "c"]


def test_error_cases(spark):
    data = [("real-high-1", 0, 0.99, "clean"), ("real-high-2", 0, 0.90, "clean"), ("real-low", 0, 0.10, "clean"), ("fake-low-1", 1, 0.01, "clean"), ("fake-low-2", 1, 0.11, "clean"), ("fake-high", 1, 0.9, "clean"), ("real-high-1", 0, 0.05, "jpeg_q30"), ("fake-low-1", 1, 0.96, "blur_s2.0")]
    df = spark.createDataFrame(data, "sample_id string, label int, score double, condition_id string").withColumn("split", F.lit("v")).withColumn("checkpoint_id", F.lit("k"))
    assert [r["sample_id"] for r in cases.false_positives(df, 2).collect()] == ["real-high-1", "real-high-2"]
    assert [r["sample_id"] for r in cases.false_negatives(df, 2).collect()] == ["fake-low-1", "fake-low-2"]
    assert [(r["sample_id"], r["change"]) for r in cases.most_unstable(df, 2).collect()] == [("fake-low-1", 0.95), ("real-high-1", 0.94)]


def test_hardest_condition(spark):
    table = {"jpeg_q30": (2.0, -2.0), "blur_s2.0": (-1.0, 1.0), "noise_s0.10": (0.5, -0.5)}
    df = spark.createDataFrame([(f"s{i}", 1 - i, c, c.split("_")[0], z[i]) for c, z in table.items() for i in (0, 1)], "sample_id string, label int, condition_id string, transform_family string, logit double")
    picked = cases.hardest_condition(df)
    assert {r["condition_id"] for r in picked.collect()} == {"blur_s2.0"}
    assert picked.count() == 2 and cases.family_proportions(picked).first()["dominates"]


def test_temperature(spark):
    df = spark.createDataFrame([(4.0, 1), (3.0, 0), (-4.0, 0), (-3.0, 1)], "logit double, label int")
    r = calibrate.fit_temperature(df).first()
    z, y = np.array([4.0, 3, -4, -3]), np.array([1, 0, 0, 1])
    nll = lambda t: np.mean(np.maximum(z / t, 0) - z / t * y + np.log1p(np.exp(-abs(z / t))))
    assert r["nll"] <= r["nll_before"] + 1e-6
    assert r["nll"] == pytest.approx(min(nll(np.exp(u)) for u in np.linspace(-3, 6, 4000)), abs=1e-6)


def test_survival_loss(spark):
    columns = "label int, clean_logit double, transformed_logit double, clean_features array<double>, transformed_features array<double>"
    r = calibrate.survival_loss(spark.createDataFrame([(1, 0.4, 0.1, [1.0, 1.0], [1.0, 0.0]), (0, -0.2, 0.3, [1.0, 0.0], [1.0, 0.0])], columns)).first()
    bce = lambda z, y: np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))
    want = (bce(0.4, 1) + bce(-0.2, 0)) / 2 + (bce(0.1, 1) + bce(0.3, 0)) / 2 + 0.25 * (0.09 + 0.25) / 2 + 0.10 * (1 - 2**-0.5) / 2
    assert r["total"] == pytest.approx(want)
    same = calibrate.survival_loss(spark.createDataFrame([(1, 0.4, 0.4, [1.0, 1.0], [1.0, 1.0])], columns)).first()
    assert (same["logit_consistency"], round(same["feature_consistency"], 12)) == (0.0, 0.0)


def test_parity(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", -2.0)], "sample_id string, logit double")
    r = calibrate.parity(a, a.withColumn("logit", F.col("logit") + 1e-5), ["sample_id"]).first()
    assert r["n"] == 2 and r["within"] and r["max_logit_difference"] == pytest.approx(1e-5)


def picture(kind, n=64):
    rng = np.random.default_rng(1)
    if kind == "flat":
        return np.full((n, n), 0.5)
    if kind == "noise":
        return rng.random((n, n))
    return np.kron(rng.random((n // 8, n // 8)), np.ones((8, 8)))


def test_pixel_signals(spark):
    data = [(k, 64, 64, picture(k).ravel().tolist()) for k in ("flat", "noise", "blocks")]
    df = spark.createDataFrame(data, "sample_id string, width int, height int, pixels array<double>")
    got = {r["sample_id"]: r for r in images.processing_labels(images.pixel_signals(df)).collect()}
    assert "Strong blur or loss of detail" in got["flat"]["labels"] and "Noise-like high-frequency pattern" in got["noise"]["labels"]
    assert "JPEG encoding or compression" in got["blocks"]["labels"] and got["blocks"]["confidence"] == "moderate"
    soft = images.pixel_signals(images.perturbed(df, "blur", 2.0, 1)).collect()
    assert {r["sample_id"]: r["sharpness"] for r in soft}["noise"] < got["noise"]["sharpness"]
    again = [images.perturbed(df, "noise", 0.05, 1).collect() for _ in range(2)]
    assert again[0] == again[1]
    with pytest.raises(ValueError, match="codec"):
        images.perturbed(df, "jpeg", 30.0, 1)
    for family, severity in (("resize", 0.25), ("center_crop", 0.8), ("color_jitter", 0.2)):
        out = {r["sample_id"]: r["pixels"] for r in images.perturbed(df, family, severity, 1).collect()}
        assert out == {r["sample_id"]: r["pixels"] for r in images.perturbed(df.repartition(3), family, severity, 1).collect()}
        assert all(len(p) == 64 * 64 and 0 <= min(p) and max(p) <= 1 for p in out.values()) and out["noise"] != picture("noise").ravel().tolist()
        if family != "color_jitter":  # what is flat stays so at any size
            assert out["flat"] == pytest.approx(picture("flat").ravel().tolist())
    logits = {r["sample_id"]: r["logit"] for r in images.scored(df, lambda: lambda grays: [g.mean() for g in grays]).collect()}
    assert logits["flat"] == pytest.approx(0.5)


def test_picked_conditions(spark):
    ids = spark.range(3000).select(F.concat(F.lit("id-"), F.col("id")).alias("sample_id"))
    families = dict(images.picked_conditions(ids, 5, 17).groupBy(F.regexp_extract("condition_id", "^[a-z]+", 0)).count().collect())
    assert len(families) == 6 and all(abs(n / 3000 - 1 / 6) < 0.03 for n in families.values())
    many = images.picked_conditions(ids.limit(50), 1, 2, count=3)
    assert many.groupBy("sample_id").agg(F.count_distinct(F.regexp_extract("condition_id", "^[a-z]+", 0)).alias("n")).where("n = 3").count() == 50


def test_mined_loss(spark):
    from siftwork.functions.exprs import stable_seed_value
    from siftwork.operators import training
    from siftwork.sources.registry import CONDITIONS

    r = random.Random(3)
    ids = [f"s{i}" for i in range(400)]
    label = {k: i % 2 for i, k in enumerate(ids)}
    vector = lambda: [r.uniform(-1, 1) for _ in range(3)]
    logit = {(k, c.condition_id): (float(r.randint(-3, 3)), vector()) for k in ids for c in CONDITIONS}  # ties are frequent
    plain = {k: (r.uniform(-2, 2), vector()) for k in ids}
    scored = spark.createDataFrame([(k, label[k], c.condition_id, c.family, *logit[k, c.condition_id]) for k in ids for c in CONDITIONS], "sample_id string, label int, condition_id string, transform_family string, logit double, features array<double>").repartition(3)
    clean = spark.createDataFrame([(k, *plain[k]) for k in ids], "sample_id string, logit double, features array<double>")
    picked = {k: [None] * 3 for k in ids}
    for p in images.picked_conditions(clean, 4, 17, 3).collect():
        picked[p["sample_id"]][p["ordinal"]] = p["condition_id"]
    want, explored = {}, 0
    for k in ids:
        margins = [logit[k, c][0] * (1 if label[k] else -1) for c in picked[k]]
        at, rng = margins.index(min(margins)), random.Random(stable_seed_value(17, 4, k, "explore"))
        if rng.random() < 0.20:
            at, explored = rng.randrange(3), explored + 1
        want[k] = picked[k][at]
    mined = training.mined_conditions(scored, clean, 4, 17).collect()
    assert {m["sample_id"]: m["condition_id"] for m in mined} == want
    assert sum(m["explored"] for m in mined) == explored and 50 < explored < 110
    bce = lambda z, y: np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))
    apart = lambda a, b: 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    pairs = [(label[k], plain[k], logit[k, want[k]]) for k in ids]
    base = [bce(a[0], y) + bce(b[0], y) + 0.25 * (a[0] - b[0]) ** 2 for y, a, b in pairs]
    got = training.hard_mined_loss(scored, clean, 4, 17).first()
    assert got["total"] == pytest.approx(np.mean(base) + 0.10 * np.mean([apart(a[1], b[1]) for _, a, b in pairs]))
    bare = scored.drop("features"), clean.drop("features")
    assert training.hard_mined_loss(*bare, 4, 17, feature_weight=0.0).first()["total"] == pytest.approx(np.mean(base))
    with pytest.raises(ValueError, match="needs features"):
        training.hard_mined_loss(*bare, 4, 17)
    with pytest.raises(DataIntegrityError, match="exactly one score"):
        training.hard_mined_loss(scored.where("condition_id <> 'blur_s1.0'"), clean, 4, 17)


def test_resampling():
    ramp = np.linspace(0.2, 0.8, 40)[None, :].repeat(30, axis=0)
    assert images.resampled_value(ramp, 30, 40) == pytest.approx(ramp)
    assert images.resampled_value(ramp, 60, 20)[:, 3:-3] == pytest.approx(ramp.reshape(30, 20, 2).mean(axis=2).repeat(2, axis=0)[:, 3:-3])
    assert images.resize_value(ramp, 0.01).shape == (30, 40)  # one pixel at least
    assert images.crop_value(ramp, 0.5)[15, 10:30] == pytest.approx(np.interp((np.arange(10, 30) + 0.5) / 2 + 9.5, np.arange(40), ramp[0]), abs=1e-3)
    colours = np.random.default_rng(3).random((20, 10, 3))
    spread = lambda a: (a.max(axis=2) - a.min(axis=2)).mean()
    gray = images.gray_value(colours)[..., None].repeat(3, axis=2)
    assert spread(images.jitter_value(gray, 0.2, 5)) == pytest.approx(0) and spread(images.jitter_value(colours, 0.2, 5)) > 0
    assert images.jitter_value(colours, 0.0, 5) == pytest.approx(colours)


def test_colours_and_enriched_hashes(spark):
    rgb = np.random.default_rng(1).random((8, 16, 3)).ravel().tolist()
    df = spark.createDataFrame([("a", 16, 8, rgb)], "sample_id string, width int, height int, pixels array<double>")
    for family in images.PERTURBATIONS:
        assert len(images.perturbed(df, family, 0.5, 1).first()["pixels"]) == 8 * 16 * 3
    manifest = spark.createDataFrame([("s1", "x.png", "old"), ("s2", "y.png", None)], "sample_id string, path string, content_checksum string")
    files = spark.createDataFrame([("x.png", b"1"), ("y.png", b"2")], "path string, content binary")
    pixels = spark.createDataFrame([(p, 64, 64, picture(k).ravel().tolist()) for p, k in (("x.png", "noise"), ("y.png", "blocks"))], "path string, width int, height int, pixels array<double>")
    got = images.enriched_hashes(manifest, files, pixels)
    assert got.columns == ["sample_id", "path", "content_checksum", "perceptual_hash"]
    want = {"s1": (hashlib.sha256(b"1").hexdigest(), images.dct_hash_value(picture("noise"))), "s2": (hashlib.sha256(b"2").hexdigest(), images.dct_hash_value(picture("blocks")))}
    assert {r["sample_id"]: (r["content_checksum"], r["perceptual_hash"]) for r in got.collect()} == want
    with pytest.raises(Exception, match="no file at y.png"):
        images.enriched_hashes(manifest, files.where("path = 'x.png'"), pixels).collect()
