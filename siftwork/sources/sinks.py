"""Sinks: tables and reports, published whole or not at all."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import re
import shutil
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.errors import DataIntegrityError
from siftwork.functions.exprs import html_escaped_value, missing
from siftwork.operators import checks
from siftwork.operators.images import encoded


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_parquet(df: DataFrame, path: str) -> None:
    """The table under ``path``, replaced in one rename once all of it is written."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staged)
        fs, target = _fs(spark, path)
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
        had = fs.exists(target)
        if had:
            fs.rename(target, old)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
            if had:
                fs.rename(old, target)
            raise DataIntegrityError(f"{path} can't be published")
        if had:
            fs.delete(old, True)
    finally:
        fs, s = _fs(spark, staged)
        if fs.exists(s):
            fs.delete(s, True)


def write_text(text: str, path: str) -> None:
    """A driver-side report, renamed into place."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    try:
        with open(staged, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(staged, path)
    finally:
        if os.path.exists(staged):
            os.remove(staged)


def finite_json(value: Any) -> str:
    """Sorted keys; what isn't a finite number is null."""

    def clean(v: Any) -> Any:
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(clean(value), sort_keys=True, indent=2, allow_nan=False)


def config_hash(config: dict[str, Any]) -> str:
    """SHA-256 of a configuration as compact JSON with sorted keys; paths by their POSIX form."""
    plain = json.dumps(config, sort_keys=True, separators=(",", ":"), default=lambda v: v.as_posix() if hasattr(v, "as_posix") else str(v))
    return hashlib.sha256(plain.encode()).hexdigest()


def table_digest(df: DataFrame, *order: str) -> str:
    """A digest of a table's rows whatever their order and files: of the sorted digests' buckets, one row for each of 4,096."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    number = lambda at: F.conv(F.substring("d", at, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("d")).groupBy(F.substring("d", 1, 3).alias("head")).agg(F.count("*").alias("n"), F.sum(number(4)).alias("a"), F.sum(number(16)).alias("b"))
    text = "\n".join(f"{r['head']} {r['n']} {r['a']} {r['b']}" for r in sums.orderBy("head").collect())
    return hashlib.sha256(text.encode()).hexdigest()


def write_split_manifest(assigned: DataFrame, path: str, metadata_path: str, policy: dict[str, Any]) -> str:
    """The assigned manifest and its metadata, both or neither; returns the digest of its rows."""
    digest = table_digest(assigned)
    counts = {r["split"]: {"rows": r["n"], "groups": r["g"]} for r in assigned.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("split_group_id").alias("g")).collect()}
    staged = f"{metadata_path}.staged-{uuid.uuid4().hex}"
    write_text(finite_json({"split_sha256": digest, "hash_kind": "rows", "splits": counts, "policy": policy}), staged)
    try:
        write_parquet(assigned, path)
        os.replace(staged, metadata_path)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    return digest


def robustness_csv(rows: DataFrame, path: str) -> None:
    """partition, roc_auc in report order. ``rows``: ordinal, partition, roc_auc, a few for each condition."""
    lines = ["partition,roc_auc"]
    for r in rows.orderBy("ordinal").collect():
        name = r["partition"]
        lines.append(f'"{name}",{r["roc_auc"]}' if "," in name else f"{name},{r['roc_auc']}")
    write_text("\n".join(lines) + "\n", path)


#: Reports are read by people: more rows are an error, never a cut.
MOST_ROWS = 10_000


def _report_rows(rows: DataFrame) -> list:
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise DataIntegrityError(f"a report holds at most {MOST_ROWS} rows")
    return found


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a small report; pipes and markup in cells are escaped."""
    cell = lambda v: html_escaped_value(str(v)).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    out += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in _report_rows(rows.select(*columns))]
    return "\n".join(out) + "\n"


def area_chart(rows: DataFrame, path: str) -> None:
    """A bar chart of areas as SVG, the clean one and one for each family. ``rows``: ordinal, partition, roc_auc (0 to 1; null: no bar)."""
    bars = rows.orderBy("ordinal").collect()
    step, height = 90, 240
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{60 + step * len(bars)}" height="{height + 70}" font-family="sans-serif" font-size="12">']
    for tenth in range(0, 11, 2):
        y = 20 + height * (1 - tenth / 10)
        out.append(f'<line x1="45" x2="{55 + step * len(bars)}" y1="{y:g}" y2="{y:g}" stroke="#ddd"/><text x="38" y="{y + 4:g}" text-anchor="end">{tenth / 10:g}</text>')
    for i, r in enumerate(bars):
        value, x = r["roc_auc"], 60 + step * i
        if value is not None and math.isfinite(value):
            tall = height * min(max(value, 0.0), 1.0)
            out.append(f'<rect x="{x}" y="{20 + height - tall:g}" width="60" height="{tall:g}" fill="#3b6ea5"/><text x="{x + 30}" y="{14 + height - tall:g}" text-anchor="middle">{value:.3f}</text>')
        out.append(f'<text x="{x + 30}" y="{height + 40}" text-anchor="middle">{html_escaped_value(r["partition"])}</text>')
    out.append('<text x="12" y="14">ROC AUC</text></svg>')
    write_text("\n".join(out) + "\n", path)


def run_of_candidate(candidates: DataFrame, runs: list[str]) -> DataFrame:
    """``candidates`` (with checkpoint_id) with run, the first of the run folders that has the id as its name; a folder named ``run`` goes by its parent.

    A candidate without a run is an error. Runs are the few that a user names.
    """
    named = []
    for place, run in enumerate(runs):
        parts = [p for p in run.split("/") if p]
        named.append((place, parts[-2] if len(parts) > 1 and parts[-1] == "run" else parts[-1], run))
    places = candidates.sparkSession.createDataFrame(named, "place int, run_id string, run string")
    first = places.groupBy("run_id").agg(F.min_by("run", "place").alias("run"))
    found = candidates.join(F.broadcast(first), F.col("checkpoint_id") == F.col("run_id"), "left").drop("run_id")
    lost = F.raise_error(F.concat(F.lit("no run of candidate "), F.coalesce("checkpoint_id", F.lit("without an id")))).cast("string")
    return found.withColumn("run", F.coalesce("run", lost))


def error_gallery(cases: DataFrame, manifest: DataFrame, pictures: DataFrame | None = None) -> str:
    """An HTML page of error cases with their paths; a case that the manifest lacks is an error.

    ``pictures`` (path, thumbnail), as ``images.thumbnails`` gives them, puts thumbnails into the page in place of paths.
    """
    found = cases.join(manifest.select("sample_id", "path", "dataset_name"), "sample_id", "left")
    small = found.join(pictures.select("path", "thumbnail"), "path", "left") if pictures is not None else found.withColumn("thumbnail", F.lit(None).cast("binary"))
    joined = _report_rows(small)
    lost = [r["sample_id"] for r in joined if r["path"] is None]
    if lost:
        raise DataIntegrityError(f"samples that the manifest lacks: {', '.join(lost[:3])}")
    e = html_escaped_value
    shown = lambda r: "data:image/png;base64," + base64.b64encode(r["thumbnail"]).decode() if r["thumbnail"] else e(r["path"])
    figures = "".join(f"<figure><img src=\"{shown(r)}\" alt=\"\"><figcaption>{e(r['sample_id'])} ({e(r['dataset_name'])}): {r['score']:.4f}</figcaption></figure>" for r in joined)
    return f"<!doctype html><title>Error cases</title>{figures}\n"


def predictions_json(rows: DataFrame, path: str) -> None:
    """``[{"image_path", "pred"}]`` sorted by path, all or nothing: parts are written by executors, then joined by the driver as a stream."""
    staged = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        rows.select(F.col("path").alias("image_path"), F.col("score").alias("pred")).orderBy("image_path").write.json(staged)
        spark = rows.sparkSession
        first = True
        target = f"{path}.staged-{uuid.uuid4().hex}"
        with open(target, "w", encoding="utf-8") as out:
            out.write("[")
            for r in spark.read.text(staged).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("file", "at").toLocalIterator():
                out.write(("" if first else ",") + "\n" + r["value"])
                first = False
            out.write("\n]\n")
        os.replace(target, path)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def save_pictures(images: DataFrame, path: str, key: str = "sample_id") -> None:
    """Pictures as a table of PNG files (``key``, path, content), whole or not at all; a blank or repeated id is an error, before anything is written."""
    checks.enforce(images.where(missing(F.col(key))).select(key), what="pictures without an id")
    checks.enforce(checks.repeated_keys(images, key), what="repeated picture ids")
    write_parquet(encoded(images, key).select(key, F.concat(F.lit("images/"), F.sha2(key, 256), F.lit(".png")).alias("path"), "content"), path)


def append_history(rows: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    rows.write.mode("append").json(path)


def artifact_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), sha256, length of every file of a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", "^.*?" + folder.strip("/").replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def artifact_mismatches(declared: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem: files that are missing, changed, or not declared."""
    d, f = declared.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("have"))
    joined = d.join(f, "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "not declared").when(F.lower("want") != F.lower("have"), "changed")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


#: Rules of the release scan: names, suffixes, contents that must not be published, and what documents must hold.
SECRETS = (
    r"(?i)hf_[a-z0-9]{20,}",
    r"(?i)github_pat_[a-z0-9_]{20,}",
    r"(?i)api[_-]?key\s*[=:]\s*[^\s\"'<>]{8,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)(?:api|secret)[_-]?key\s*[=:]\s*['\"][^'\"]{16,}",
)
BANNED_NAMES = (".env", "id_ed25519", "id_rsa")
BANNED_SUFFIXES, MOST_BYTES = ("ckpt", "key", "onnx", "parquet", "pem", "pt", "pth", "safetensors"), 5_000_000
REQUIRED_DOCUMENTS = ("README.md", "LICENSE", "THIRD_PARTY_NOTICES.md", "docs/datasets.md", "docs/model-card.md", "docs/devpost-draft.md", "docs/video-script.md")
MODEL_CARD_FIELDS = ("intended use", "limitations", "datasets", "metrics", "ethical")
NOTICES = (("DINOv2", "Apache-2.0"), ("SID-Set", "CC-BY-4.0"), ("CIFAKE", "MIT"), ("WildFake", "REQUIRES-VERIFICATION"))
_UNPUBLISHED = {".git", ".venv", "__pycache__"}
_HEADING = re.compile(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$")


def _unscanned(spark: SparkSession, folder: str, scanned: set[str]) -> list[tuple[str, int, bytes]]:
    """path, length, content of the files that Spark's scan leaves out: empty ones, and names that begin with a dot or underscore."""
    fs, root = _fs(spark, folder)
    top, out, files = len(fs.makeQualified(root).toString()) + 1, [], fs.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        path, size = status.getPath().toString(), status.getLen()
        if path in scanned or _UNPUBLISHED & set(path[top:].split("/")):
            continue
        content = b""
        if 0 < size <= MOST_BYTES:  # a larger one is a violation already
            stream = fs.open(status.getPath())
            try:
                content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
        out.append((path, size, content))
    return out


def document_problems(documents: dict[str, bytes]) -> list[tuple[str, str]]:
    """path, problem of the licence, the notices and the model card, as far as they are there."""

    def text(path: str) -> str | None:
        try:
            return None if b"\0" in documents[path] else documents[path].decode()
        except UnicodeDecodeError:
            return None

    out = []
    if "LICENSE" in documents and "MIT License" not in (text("LICENSE") or ""):
        out.append(("LICENSE", "licence is not MIT"))
    if "THIRD_PARTY_NOTICES.md" in documents:
        notices, sections = text("THIRD_PARTY_NOTICES.md") or "", {}
        heads = list(_HEADING.finditer(notices))
        for h, end in zip(heads, [*(h.start() for h in heads[1:]), len(notices)], strict=True):
            name = h[1].strip().casefold()
            sections[name] = sections.get(name, "") + notices[h.end() : end]
        out += [("THIRD_PARTY_NOTICES.md", f"lacks {part}: {licence}") for part, licence in NOTICES if licence not in sections.get(part.casefold(), "")]
    if "docs/model-card.md" in documents:
        card = text("docs/model-card.md")
        heads = [h[1].strip().casefold() for h in _HEADING.finditer(card or "")]
        out += [("docs/model-card.md", f"lacks {f}") for f in MODEL_CARD_FIELDS if not any(h == f or h.startswith(f + " ") for h in heads)] if card is not None else [("docs/model-card.md", "not readable as UTF-8")]
    return out


def release_violations(spark: SparkSession, folder: str, required: tuple[str, ...] = ("README.md", "LICENSE")) -> DataFrame:
    """path, problem over all files of a folder: banned names, suffixes and places, sizes, secrets, documents that aren't there or lack what they must hold.

    ``REQUIRED_DOCUMENTS`` are those of a whole release.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
    rest = _unscanned(spark, folder, {r["path"] for r in scan.select("path").collect()})
    files = scan.unionByName(spark.createDataFrame(rest, "path string, length long, content binary"))
    relative = F.regexp_replace("path", "^.*?" + folder.strip("/").replace(".", r"\.") + "/", "")
    text = F.replace(F.decode("content", "ISO-8859-1"), F.lit("\0"), F.lit(""))
    suffix, name = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    secret = F.lit(False)
    for rule in SECRETS:
        secret = secret | text.rlike(rule)
    problems = F.array_compact(F.array(
        F.when(name.isin(*BANNED_NAMES), "banned file name"), F.when(suffix.isin(*BANNED_SUFFIXES), "banned file type"), F.when(F.lower(relative).startswith("data/raw/"), "raw data"),
        F.when(F.col("length") > MOST_BYTES, "too large"), F.when(secret, "holds a secret"),
    ))
    found = files.select(relative.alias("path"), F.explode(problems).alias("problem"))
    want = spark.createDataFrame([(r,) for r in required], "path string")
    absent = want.join(files.select(relative.alias("path")), "path", "left_anti").select("path", F.lit("required file missing").alias("problem"))
    judged = files.where(relative.isin("LICENSE", "THIRD_PARTY_NOTICES.md", "docs/model-card.md")).select(relative.alias("path"), "content").collect()
    held = spark.createDataFrame(document_problems({r["path"]: bytes(r["content"]) for r in judged}), "path string, problem string")
    return found.unionByName(absent).unionByName(held)
