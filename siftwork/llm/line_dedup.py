"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines of a document is hashed to 128 bits. A window that also
occurs earlier (smaller doc_id, or the same document further up) covers its three lines, and all
covered lines go; windows are judged on the input. Windows are counted with map-side combination;
the first places of repeated windows are written out, so that the join back has exchanges on both
sides that adaptive execution may split where one window is hot. Columns stay flat and each text is
shuffled once, in the join of the documents with their covered lines. Both joins merge sorted sides at
every size: repeated windows and covered lines grow with the corpus, so neither is broadcast.

Defined results: null texts stay null with 0 lines; an empty text is one empty line; documents of
fewer than three lines have no window and stay whole; windows without any word are no windows, so
blank stretches stay. Rows are told apart by doc_id and a digest of the text: rows that repeat both
are one document, none earlier than the other; rows that share a doc_id only are ordered by that
digest. Documents without doc_id stay whole and take nothing from others. All input columns stay;
``n_lines``, ``n_removed`` and ``kept`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import let, scratch, table, written

LINES = 3


def _lines(text):
    return F.split(text, "\n", -1)


def window_places(docs: DataFrame) -> DataFrame:
    """(doc_id, version, at, h1, h2) of every window; at counts lines from 0, version is a digest of the text."""

    def hashes(x):
        def one(first, i):
            parts = [first, *(F.get(x, i + k) for k in range(1, LINES))]
            has_word = parts[0].rlike(r"[^\x20\x09-\x0D]")
            for p in parts[1:]:
                has_word = has_word | p.rlike(r"[^\x20\x09-\x0D]")
            return F.when(has_word, F.struct(i.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(LINES), *reversed(parts)).alias("h2")))

        return F.filter(F.transform(F.slice(x, 1, F.greatest(F.size(x) - (LINES - 1), F.lit(0))), one), lambda w: w.isNotNull())

    return docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), F.inline(let(_lines(F.col("text")), hashes)))


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, covered): the lines that a later occurrence of a window covers."""
    with scratch(docs.sparkSession) as keep:
        places = written(window_places(docs))
        place = F.struct("doc_id", "version", "at")
        first = written(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"))
        later = places.join(first.hint("merge"), ["h1", "h2"]).where(place > F.col("first"))
        starts = later.groupBy("doc_id", "version").agg(F.collect_set("at").alias("starts"))
        return keep(starts.select("doc_id", "version", F.flatten(F.transform("starts", lambda s: F.array(*(s + k for k in range(LINES))))).alias("covered")))


def _judged(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(rows with every column under a private name, n_lines, n_removed, and left: the text of changed rows, else null; the private names)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    flat = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    doc, text = names["doc_id"], names["text"]
    covered = covered_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("covered_doc"), F.col("version").alias("covered_version"), "covered")
    joined = flat.join(covered.hint("merge"), (F.col(doc) == F.col("covered_doc")) & (F.xxhash64(text) == F.col("covered_version")), "left")

    def without(x):
        stay = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "covered")
        return let(stay, lambda i: F.struct((F.size(x) - F.size(i)).cast("long").alias("n_removed"), F.array_join(F.transform(i, lambda k: F.get(x, k)), "\n").alias("left")))

    changed = F.when(F.col("covered").isNotNull(), let(_lines(F.col(text)), without))
    lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text)))).cast("long")
    found = joined.select(*names.values(), lines.alias("n_lines"), changed.alias("d"))
    return found.select(*names.values(), "n_lines", F.coalesce("d.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.col("d.left").alias("left")), names


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept, the text of the lines that stay."""
    rows, names = _judged(docs)
    kept = F.when(F.col("n_removed") > 0, F.col("left")).otherwise(F.col(names["text"]))
    own = [F.col(n).alias(c) for c, n in names.items() if c not in ("n_lines", "n_removed", "kept")]
    return rows.select(*own, "n_lines", "n_removed", kept.alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated lines removed; a document of which nothing is left goes."""
    rows, names = _judged(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("left")).otherwise(F.col(names["text"]))
    out = {c: F.col(n) for c, n in names.items()} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.when(changed, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return rows.where(r"n_removed = 0 or left rlike '[^\\x20\\x09-\\x0D]'").select(*(out[c].alias(c) for c in docs.columns))
