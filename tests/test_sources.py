import hashlib
import json
import os
import struct
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.errors import DataIntegrityError
from siftwork.functions import png
from siftwork.operators import images
from siftwork.sources import readers, sinks
from siftwork.streaming import acquire


def touch(root, *names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "wb") as f:
            f.write(n.encode())


def test_trees(spark, tmp_path):
    touch(tmp_path, "t/real/a.png", "t/fake/flux/b.JPG", "t/fake/sdxl/c.png", "t/notes.txt")
    got = sorted((r["path"], r["label"], r["generator_family"]) for r in readers.nested_tree(f"{tmp_path}/t", "wild")(spark).collect())
    assert got == [("fake/flux/b.JPG", 1, "flux"), ("fake/sdxl/c.png", 1, "sdxl"), ("real/a.png", 0, "authentic")]
    touch(tmp_path, "u/REAL/a.png", "u/FAKE/b.png")
    assert readers.flat_tree(f"{tmp_path}/u", "flat")(spark).count() == 2
    touch(tmp_path, "v/REAL/a.png")
    with pytest.raises(DataIntegrityError, match="lacks images"):
        readers.flat_tree(f"{tmp_path}/v", "flat")(spark)


def test_pair_list(spark, tmp_path):
    touch(tmp_path, "p/real.png", "p/fake-¦.png", "p/real2.png", "p/fake2.png")
    with open(f"{tmp_path}/pairs.csv", "w", encoding="utf-8-sig") as f:
        f.write("fake,real,similarity\nfake°.png,real.png,0.9\nfake2.png,real2.png,0.8\n")
    rows = readers.pair_list(f"{tmp_path}/pairs.csv", f"{tmp_path}/p", "pairs")(spark)
    got = sorted((r["path"], r["label"], r["source_group_id"]) for r in rows.collect())
    assert got == [("fake-¦.png", 1, "pairs:real.png"), ("fake2.png", 1, "pairs:real2.png"), ("real.png", 0, "pairs:real.png"), ("real2.png", 0, "pairs:real2.png")]
    with open(f"{tmp_path}/bad.csv", "w") as f:
        f.write("fake,real\nnothing.png,real.png\n")
    with pytest.raises(DataIntegrityError, match="aren't there"):
        readers.pair_list(f"{tmp_path}/bad.csv", f"{tmp_path}/p", "pairs")(spark)


def test_files_are_read(spark, tmp_path):
    from siftwork.operators import groups

    levels = np.random.default_rng(3).integers(0, 256, (40, 50, 3))
    picture, again = png.encode(levels), png.encode(levels)
    again = again[:33] + struct.pack(">I", 4) + b"tEXt" + b"a\0bc" + struct.pack(">I", zlib.crc32(b"tEXta\0bc")) + again[33:]
    jpeg, webp = b"\xff\xd8\xff\xe0" + b"2" * 40, b"RIFF\x0a\x0a\x0a\x0aWEBP" + b"3"
    data = {"real/a.png": picture, "fake/flux/copy.png": picture, "real/noted.png": again, "real/cut.png": picture[:-20], "real/bad.png": picture[:60] + bytes([picture[60] ^ 1]) + picture[61:], "real/b.jpg": jpeg, "fake/flux/w é%20 1.webp": webp, "fake/flux/empty.png": b"", "real/text.png": b"not an image"}
    for name, content in data.items():
        touch(tmp_path, f"t/{name}")
        with open(f"{tmp_path}/t/{name}", "wb") as f:
            f.write(content)
    with open(f"{tmp_path}/pairs.csv", "w") as f:
        f.write("fake,real\nfake/flux/copy.png,real/a.png\nfake/flux/empty.png,real/text.png\n")
    tree, pairs = readers.nested_tree(f"{tmp_path}/t", "wild"), readers.pair_list(f"{tmp_path}/pairs.csv", f"{tmp_path}/t", "pairs")
    for source, bad in ((tree, {"wild:fake/flux/empty", "wild:real/text", "wild:real/cut", "wild:real/bad"}), (pairs, {"pairs:fake/flux/empty.png", "pairs:real/text.png"})):
        valid, violations = readers.build_manifest(spark, [source], most_corrupt=0.5)
        assert {tuple(r) for r in violations.collect()} == {(i, "content_checksum") for i in bad}
        assert all(r["content_checksum"] == hashlib.sha256(data[r["path"]]).hexdigest() for r in valid.collect())
        with pytest.raises(DataIntegrityError, match="corrupt"):
            readers.build_manifest(spark, [source])
    grouped = groups.split_groups(readers.build_manifest(spark, [tree], most_corrupt=0.5)[0])
    group = {r["path"]: r["split_group_id"] for r in grouped.collect()}
    assert len(group) == 5 and len(set(group.values())) == 3 and group["real/a.png"] == group["fake/flux/copy.png"] == group["real/noted.png"]
    seen = {r["path"]: (r["width"], r["height"], r["perceptual_hash"]) for r in readers.build_manifest(spark, [tree], most_corrupt=0.5)[0].collect()}
    assert seen["real/a.png"] == seen["real/noted.png"] == (50, 40, images.dct_hash_value(images.gray_value(levels / 255.0))) and seen["real/b.jpg"] == (None, None, "")


def test_labelled_rows_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i % 3) for i in range(30)], "img_id string, label int")
    made = readers.labelled_rows(rows, "set")
    assert made.columns == readers.MANIFEST_COLUMNS and made.groupBy("label").count().count() == 2
    sinks.write_parquet(made, f"{tmp_path}/m")
    source = readers.rooted_manifest(f"{tmp_path}/m", "/data/images", "set")
    valid, bad = readers.build_manifest(spark, [source])
    assert valid.count() == 20 and bad.count() == 0 and valid.first()["path"].startswith("/data/images/images/")
    with pytest.raises(DataIntegrityError, match="another dataset"):
        readers.parquet_manifest(f"{tmp_path}/m", "other")(spark)
    broken = made.withColumn("source_group_id", F.when(F.col("sample_id") == "set:0", "").otherwise(F.col("source_group_id")))
    with pytest.raises(DataIntegrityError, match="corrupt"):
        readers.build_manifest(spark, [lambda s: broken])
    assert readers.build_manifest(spark, [lambda s: broken], most_corrupt=0.1)[0].count() == 19
    lost = made.withColumn("sample_id", F.when(F.col("sample_id") == "set:0", F.lit(None)).when(F.col("sample_id") == "set:1", "set:3").otherwise(F.col("sample_id")))
    valid, bad = readers.build_manifest(spark, [lambda s: lost], most_corrupt=0.2)
    assert sorted((r["sample_id"] or "", r["rule"]) for r in bad.collect()) == [("", "blank sample_id"), *[("set:3", "repeated sample_id")] * 2]
    assert valid.count() == 17 and valid.where("sample_id is null or sample_id = 'set:3'").count() == 0
    with pytest.raises(DataIntegrityError, match="3 of 20"):  # rows count, not their ids
        readers.build_manifest(spark, [lambda s: lost], most_corrupt=0.14)
    with pytest.raises(DataIntegrityError, match="outside 0, 1, 2"):
        readers.labelled_rows(spark.createDataFrame([("a", 3)], "img_id string, label int"), "set")
    assert sorted(tuple(r) for r in readers.missing_classes(made, 12).collect()) == [(0, 10, 2), (1, 10, 2)]


def test_publish_is_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_parquet(spark.range(3), path)
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_parquet(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["t"]
    sinks.write_parquet(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4


def test_split_manifest_digest(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", "train", f"g{i % 2}") for i in range(8)], "sample_id string, split string, split_group_id string")
    a = sinks.write_split_manifest(df, f"{tmp_path}/a", f"{tmp_path}/a.json", {"seed": 1})
    b = sinks.write_split_manifest(df.repartition(3), f"{tmp_path}/b", f"{tmp_path}/b.json", {"seed": 1})
    assert a == b == json.load(open(f"{tmp_path}/a.json"))["split_sha256"]
    assert sinks.table_digest(df.limit(7)) != a


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Clean", 0.5), (2, "Condition: a,b", 0.25)], "ordinal int, partition string, roc_auc double")
    sinks.robustness_csv(rows, f"{tmp_path}/r.csv")
    assert open(f"{tmp_path}/r.csv").read() == 'partition,roc_auc\nClean,0.5\n"Condition: a,b",0.25\n'
    sinks.area_chart(rows.unionByName(spark.createDataFrame([(3, "x<y", None)], rows.schema)), f"{tmp_path}/c.svg")
    chart = ElementTree.parse(f"{tmp_path}/c.svg").getroot()
    bars = [float(e.get("height")) for e in chart if e.tag.endswith("rect")]
    assert bars[0] == 2 * bars[1] and len(bars) == 2 and "x<y" in [e.text for e in chart]
    assert "| a\\|b |" in sinks.markdown_table(spark.createDataFrame([("a|b",)], "x string"), ["x"])
    assert json.loads(sinks.finite_json({"b": float("nan"), "a": [1.0]})) == {"a": [1.0], "b": None}
    sinks.predictions_json(spark.createDataFrame([("b.png", 0.5), ("a.png", 0.25)], "path string, score double"), f"{tmp_path}/p.json")
    assert json.load(open(f"{tmp_path}/p.json")) == [{"image_path": "a.png", "pred": 0.25}, {"image_path": "b.png", "pred": 0.5}]
    cases = spark.createDataFrame([("s1", 0.9)], "sample_id string, score double")
    manifest = spark.createDataFrame([("s1", "a<b.png", "d")], "sample_id string, path string, dataset_name string")
    assert "a&lt;b.png" in sinks.error_gallery(cases, manifest)
    with pytest.raises(DataIntegrityError, match="lacks: s1"):
        sinks.error_gallery(cases, manifest.limit(0))
    sinks.append_history(rows, f"{tmp_path}/h")
    sinks.append_history(rows, f"{tmp_path}/h")
    assert spark.read.json(f"{tmp_path}/h").count() == 4


def test_run_of_a_candidate(spark):
    best = spark.createDataFrame([("k1", 0.9), ("k2", 0.8)], "checkpoint_id string, score double")
    got = {r["checkpoint_id"]: r["run"] for r in sinks.run_of_candidate(best, ["/a/k1", "/b/k2/run/", "/c/k1/run"]).collect()}
    assert got == {"k1": "/a/k1", "k2": "/b/k2/run/"}
    with pytest.raises(Exception, match="no run of candidate k2"):
        sinks.run_of_candidate(best, ["/a/k1"]).collect()


def test_artifacts(spark, tmp_path):
    touch(tmp_path, "b/model.bin", "b/sub/config.json")
    found = sinks.artifact_manifest(spark, f"{tmp_path}/b")
    assert sinks.artifact_mismatches(found, found).count() == 0
    declared = found.where("path = 'model.bin'").withColumn("sha256", F.lit("0" * 64)).unionByName(found.limit(1).withColumn("path", F.lit("gone")))
    assert sorted(tuple(r) for r in sinks.artifact_mismatches(declared, found).collect()) == [("gone", "missing"), ("model.bin", "changed"), ("sub/config.json", "not declared")]
    touch(tmp_path, "r/README.md", "r/w.pt")
    with open(f"{tmp_path}/r/c.py", "w") as f:
        f.write("api_key = '0123456789abcdef0'")
    assert sorted(tuple(r) for r in sinks.release_violations(spark, f"{tmp_path}/r").collect()) == [("LICENSE", "required file missing"), ("c.py", "holds a secret"), ("w.pt", "banned file type")]


def test_release_rules(spark, tmp_path):
    secret = {"hf": "x hf_" + "aB3" * 7, "pat": "github_pat_" + "a_1" * 7, "plain": "API-KEY: abcd1234", "pem": "-----begin rsa private key-----", "aws": "AKIA" + "A1" * 8, "quoted": "secret_key = '0123456789abcdef'", "nul": "hf\0_" + "a" * 20, ".hidden": "hf_" + "a" * 20}
    fine = {"short": "hf_abc api_key=abc", "README.md": "api_key = <your key>", ".git/config": "hf_" + "a" * 20}
    named = {".env": "banned file name", "sub/ID_RSA": "banned file name", "id_ed25519": "banned file name", "w.PTH": "banned file type", "data/raw/a.txt": "raw data"}
    card = "# Intended use\n## Limitations of it\n# Datasets\n# metrics #\n"
    documents = {"LICENSE": "Apache", "THIRD_PARTY_NOTICES.md": "# DINOv2\nApache-2.0\n## SID-Set\nCC-BY-4.0\n# CIFAKE\nno\n", "docs/model-card.md": card, "docs/datasets.md": ""}
    for name, content in {**secret, **fine, **dict.fromkeys(named, ""), **documents}.items():
        touch(tmp_path, f"r/{name}")
        with open(f"{tmp_path}/r/{name}", "w") as f:
            f.write(content)
    got = sorted(tuple(r) for r in sinks.release_violations(spark, f"{tmp_path}/r", sinks.REQUIRED_DOCUMENTS).collect())
    want = [(n, "holds a secret") for n in secret] + list(named.items()) + [(n, "required file missing") for n in ("docs/devpost-draft.md", "docs/video-script.md")]
    want += [("LICENSE", "licence is not MIT"), ("THIRD_PARTY_NOTICES.md", "lacks CIFAKE: MIT"), ("THIRD_PARTY_NOTICES.md", "lacks WildFake: REQUIRES-VERIFICATION"), ("docs/model-card.md", "lacks ethical")]
    assert got == sorted(want)


def test_acquisition_resumes(spark, tmp_path):
    shards, schema = f"{tmp_path}/shards", "sample_id string, label int"
    spark.createDataFrame([(f"a{i}", i % 3) for i in range(12)], schema).coalesce(1).write.parquet(shards)
    args = (shards, schema, f"{tmp_path}/out", f"{tmp_path}/progress", 6)
    assert acquire.acquire(spark, *args).groupBy("label").count().count() == 2
    assert acquire.acquire(spark, *args).count() == 8  # nothing is read twice
    spark.createDataFrame([(f"b{i}", i % 3) for i in range(12)], schema).coalesce(1).write.mode("append").parquet(shards)
    out = acquire.acquire(spark, *args)
    assert dict(out.groupBy("label").count().collect()) == {0: 6, 1: 6}
    assert out.where("sample_id like 'a%'").count() == 8


def test_acquisition_ends_when_caps_are_full(spark, tmp_path):
    shards, schema = f"{tmp_path}/shards", "sample_id string, label int"
    for part in range(2):
        spark.createDataFrame([(f"{part}-{i}", i % 2) for i in range(20)], schema).coalesce(1).write.mode("append").parquet(shards)
    args = (shards, schema, f"{tmp_path}/out", f"{tmp_path}/progress", 5)
    assert dict(acquire.acquire(spark, *args).groupBy("label").count().collect()) == {0: 5, 1: 5}
    with open(f"{shards}/part-damaged.parquet", "wb") as f:
        f.write(b"never read")
    assert acquire.acquire(spark, *args).count() == 10


def packed(rows, width, height, depth, colour, interlaced=0, extra=b""):
    """A PNG file of rows that are filtered and packed already."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(rows, step):
    """Rows of bytes under filters 0 to 4 in turn, by the format's definition, byte by byte."""
    out = bytearray()
    for y, row in enumerate(rows):
        kind = y % 5
        out.append(kind)
        for i, v in enumerate(row):
            a, b = (row[i - step] if i >= step else 0), (rows[y - 1][i] if y else 0)
            c = rows[y - 1][i - step] if y and i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
    return bytes(out)


@pytest.mark.parametrize("colour, per", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(colour, per):
    levels = np.random.default_rng(colour).integers(0, 256, (11, 7, per))
    rows = [bytes(r.ravel().tolist()) for r in levels]
    want = levels[:, :, 0] if per < 3 else levels[:, :, :3]
    assert (png.decode(packed(filtered(rows, per), 7, 11, 8, colour)) == want).all()
    wide = [bytes(x for v in r for x in (v, 99)) for r in rows]
    assert (png.decode(packed(filtered(wide, 2 * per), 7, 11, 16, colour)) == want).all()
    passes = b"".join(filtered([bytes(r.ravel().tolist()) for r in levels[y::dy, x::dx]], per) for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if levels[y::dy, x::dx].size)
    assert (png.decode(packed(passes, 7, 11, 8, colour, interlaced=1)) == want).all()


def test_png_depths_and_damage():
    bits = np.random.default_rng(1).integers(0, 2, (5, 11))
    assert (png.decode(packed(filtered([np.packbits(r.astype(np.uint8)).tobytes() for r in bits], 1), 11, 5, 1, 0)) == 255 * bits).all()
    colours = np.random.default_rng(2).integers(0, 256, (4, 3))
    body = bytes(colours.ravel().tolist())
    palette = struct.pack(">I", 12) + b"PLTE" + body + struct.pack(">I", zlib.crc32(b"PLTE" + body))
    index = np.array([[0, 1, 2, 3, 3]])
    assert (png.decode(packed(b"\0\x1b\xc0", 5, 1, 2, 3, extra=palette)) == colours[index]).all()
    levels = np.arange(60).reshape(4, 5, 3)
    whole = png.encode(levels)
    assert (png.decode(whole) == levels).all() and (png.decode(png.encode(levels[:, :, 0])) == levels[:, :, 0]).all()
    for bad in (b"", whole[:20], whole[:-1], whole[:50] + b"x" + whole[51:], packed(b"\0\xff", 5, 1, 8, 0), packed(b"\0\xff", 1, 1, 8, 3), packed(b"\7\xff", 1, 1, 8, 0), packed(b"", 1 << 20, 1 << 20, 8, 0)):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_decoded_and_preprocessed(spark):
    levels = np.random.default_rng(4).integers(0, 256, (300, 400, 3))
    files = spark.createDataFrame([("a.png", png.encode(levels)), ("b.png", png.encode(levels[:, :, 0]))], "path string, content binary")
    rows = {r["path"]: r for r in images.decoded(files).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (400, 300)
    assert np.allclose(rows["a.png"]["pixels"], images.gray_value(levels / 255.0).ravel()) and np.allclose(rows["b.png"]["pixels"], levels[:, :, 0].ravel() / 255.0)
    assert np.allclose(images.decoded(files.where("path = 'a.png'"), colours=True).first()["pixels"], levels.ravel() / 255.0)
    with pytest.raises(Exception, match="c.png"):
        images.decoded(spark.createDataFrame([("c.png", b"no")], "path string, content binary")).collect()
    small = images.decoded(files).withColumnRenamed("path", "sample_id")
    mean = images.preprocessed(small, lambda batch: np.array([[b.mean(), b.max()] for b in batch]), (2,))
    assert all(len(r["tensor"]) == 2 for r in mean.collect())
    for wrong in (lambda batch: np.zeros((len(batch), 3)), lambda batch: np.full((len(batch), 2), np.nan)):
        with pytest.raises(Exception, match="processor"):
            images.preprocessed(small, wrong, (2,)).collect()
    shown = images.thumbnails(files.unionByName(spark.createDataFrame([("c.png", b"no")], files.schema)))
    sizes = {r["path"]: None if r["thumbnail"] is None else png.decode(r["thumbnail"]).shape for r in shown.collect()}
    assert sizes == {"a.png": (168, 224, 3), "b.png": (168, 224), "c.png": None}
    cases = spark.createDataFrame([("s", 0.5)], "sample_id string, score double")
    manifest = spark.createDataFrame([("s", "a.png", "d")], "sample_id string, path string, dataset_name string")
    assert 'src="data:image/png;base64,' in sinks.error_gallery(cases, manifest, shown)


def test_screenshots_and_saved_pictures(spark, tmp_path):
    white = np.ones((60, 80, 3))
    assert np.allclose(images.screenshot_value(white, 90, 144), 1.0)
    dark = images.screenshot_value(np.zeros((90, 90)), 90, 144)  # 27 white columns on each side of the screen
    assert np.allclose(dark[:, :12], 1.0) and np.allclose(dark[:, 30:60], 0.0, atol=1e-9) and abs(dark.mean() - 54 / 144) < 0.01
    wide = images.screenshot_value(np.linspace(0, 1, 16 * 10).reshape(10, 16), 900, 1440)
    assert np.abs(wide - np.linspace(0, 1, 160).reshape(10, 16)).max() < 0.05  # of the screen's proportions: nothing is added
    levels = np.random.default_rng(6).integers(0, 256, (20, 30, 3))
    rows = spark.createDataFrame([("a", 30, 20, (levels / 255.0).ravel().tolist()), ("b", 30, 20, (levels[:, :, 0] / 255.0).ravel().tolist())], "sample_id string, width int, height int, pixels array<double>")
    assert images.stressed(rows, "screenshot_1080").count() == 2
    with pytest.raises(ValueError, match="codec"):
        images.stressed(rows, "webp_q80")
    sinks.save_pictures(rows, f"{tmp_path}/pictures")
    saved = {r["sample_id"]: r for r in spark.read.parquet(f"{tmp_path}/pictures").collect()}
    assert (png.decode(bytes(saved["a"]["content"])) == levels).all() and (png.decode(bytes(saved["b"]["content"])) == levels[:, :, 0]).all()
    with pytest.raises(DataIntegrityError, match="repeated"):
        sinks.save_pictures(rows.unionByName(rows), f"{tmp_path}/again")
    assert not os.path.exists(f"{tmp_path}/again")
