"""Substring dedup: seed and extend over winnowed anchors.

A window is ``width`` consecutive words of one document. Of the 7-word grams in each window the
one with the least hash is its anchor, so equal windows have equal anchors at equal places, and
about one gram in seven is an anchor of some window.

1. Seeds: anchors that occur twice or more, counted with map-side combination and joined back to
   their places on two exchanges that adaptive execution may split.
2. Extension: the run of windows that an anchor stands for reaches from its first window's first
   word to its last window's last word. Places of a seed with the same run form a class; all but
   the first place of a class repeat it whole, so hot passages collapse before anything is expanded.
3. Where a seed has several classes, the first place of each is extended window by window to both
   sides: a window is a repeat if an equal one starts earlier. Touching windows merge into maximal
   spans, which is what ``repeats`` returns.

Equality of windows is equality of 128 bits: the anchor's hash from one half of the words' digests,
and the window's or run's from the other. Whole copies of a text are settled by the digest of the
text and aren't expanded.

Defined results: null and blank texts have no words and nothing is removed; windows never cross
documents; a text shorter than the window is never changed. Rows are told apart by doc_id and a
digest of the text: rows that repeat both are one document, none earlier than the other, and rows
that share a doc_id only are ordered by that digest. Documents without doc_id stay whole and take
nothing from others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bytescan import Runs, Texts, pieces, spread, window_starts
from siftwork.llm.common import scratch, table, written

WIDTH, GRAM = 20, 7

_ANCHORS = "seed long, doc_id long, version long, at int"
_EXTENDED = "doc_id long, version long, n_words long, kept_sha256 string, text string, seeds array<long>, at array<int>, lo array<int>, hi array<int>, run array<long>, windows array<binary>"


def anchors_of(words, width: int, gram: int):
    """(gram hashes by first word, text, first word and anchor of each window)."""
    runs = Runs(words.hashes(1), 1)
    n = len(words.starts)
    text, first = window_starts(words.count, words.first, width)
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    fits = np.arange(max(n - gram + 1, 0))
    grams[: len(fits)] = runs.hash(fits, fits + gram)
    if not len(first):
        return grams, text, first, first
    # least of the width - gram + 1 grams of each window, the leftmost where two are equal
    span, least, at = width - gram + 1, grams.copy(), np.arange(n)
    step = 1
    while step < span:
        reach = min(step, span - step)
        other, other_at = np.roll(least, -reach), np.roll(at, -reach)
        less = other < least
        least, at = np.where(less, other, least), np.where(less, other_at, at)
        step += reach
    return grams, text, first, at[first]


def _find_anchors(width: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column("doc_id")
                words = Texts(part.column("text")).words()
                grams, text, first, anchor = anchors_of(words, width, gram)
                keep = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
                at, of = anchor[keep], text[keep]
                of_row = pa.array(of)
                yield pa.record_batch({"seed": grams[at].view(np.int64), "doc_id": ids.take(of_row), "version": part.column("version").take(of_row), "at": (at - words.first[of]).astype(np.int32)})

    return scan


def kept_words(words, t: int, removed: np.ndarray) -> bytes:
    """The words of text t that aren't removed, joined by one space."""
    first, last = words.first[t], words.first[t + 1]
    keep = np.flatnonzero(~removed) + first
    at, of = spread(words.starts[keep], words.ends[keep] + 1)
    out = words.texts.bytes[at]
    out[np.cumsum(words.ends[keep] + 1 - words.starts[keep]) - 1] = 0x20
    return out[:-1].tobytes() if last > first and len(keep) else b""


def _extend(width: int, gram: int):
    """For documents with seeds: each seeded anchor's run and windows. For all others the result."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 500_000):
                rows = []
                words = Texts(part.column("text")).words()
                grams, text, first, anchor = anchors_of(words, width, gram)
                other = Runs(words.hashes(2), 2)
                copied = part.column("copied").to_pylist()
                seeded = part.column("at").to_pylist()
                texts = part.column("text")
                bounds = np.searchsorted(text, np.arange(words.texts.n + 1))
                for t, doc in enumerate(zip(part.column("doc_id").to_pylist(), part.column("version").to_pylist(), strict=True)):
                    n, base = int(words.count[t]), words.first[t]
                    whole = copied[t] and n >= width
                    if whole or not seeded[t]:
                        kept = kept_words(words, t, np.full(n, bool(whole)))
                        rows.append((*doc, n, hashlib.sha256(kept).hexdigest(), None, None, None, None, None, None, None))
                        continue
                    mine, starts = anchor[bounds[t] : bounds[t + 1]], first[bounds[t] : bounds[t + 1]]
                    at = np.sort(np.array(seeded[t], np.int64)) + base
                    lo, hi = np.searchsorted(mine, at), np.searchsorted(mine, at, "right")
                    begin, end = starts[lo], starts[hi - 1]
                    run = other.hash(begin, end + width).view(np.int64)
                    hashes = other.hash(starts, starts + width)
                    blobs = [hashes[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
                    rows.append((*doc, n, None, texts[t].as_py(), grams[at].view(np.int64), at - base, begin - at, end - at, run, blobs))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return scan


_NAMES = [x.strip().split()[0] for x in _EXTENDED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of a class's first place."""
    for batch in batches:
        blobs = batch.column("windows").to_pylist()
        if not blobs:
            continue
        hashes = np.frombuffer(b"".join(blobs), np.int64)
        size = np.array([len(x) // 8 for x in blobs])
        lo = batch.column("lo").to_numpy().astype(np.int64)
        off, of = spread(lo, lo + size)
        at = batch.column("at").to_numpy()
        take = lambda c: batch.column(c).to_numpy()[of]
        yield pa.record_batch({"seed": take("seed"), "window": hashes, "doc_id": take("doc_id"), "version": take("version"), "start": (at[of] + off).astype(np.int32)})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Texts(part.column("text")).words()
            spans = part.column("spans").to_pylist()
            removed, digest, kept_text = [], [], []
            for t in range(words.texts.n):
                gone = np.zeros(int(words.count[t]), bool)
                for s in spans[t] or ():
                    gone[s["begin"] : s["end"]] = True
                kept = kept_words(words, t, gone)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace"))
            yield pa.record_batch([part.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept_text)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _extended(docs: DataFrame, width: int, gram: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    named = docs.where("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        anchors = written(named.mapInArrow(_find_anchors(width, gram), _ANCHORS))
        seeds = written(anchors.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
        places = anchors.join(seeds, "seed").groupBy("doc_id", "version").agg(F.collect_set("at").alias("at"))
        digests = named.select("doc_id", "version", F.unhex(F.sha2("text", 256)).alias("digest"))
        firsts = written(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
        copies = digests.join(firsts, "digest").where("doc_id > first").select("doc_id", "version").distinct().withColumn("copied", F.lit(True))
        joined = docs.join(places, ["doc_id", "version"], "left").join(copies, ["doc_id", "version"], "left")
        return keep(joined.select("doc_id", "version", "text", "at", F.coalesce("copied", F.lit(False)).alias("copied")).mapInArrow(_extend(width, gram), _EXTENDED))


def _repeat_spans(extended: DataFrame, width: int) -> DataFrame:
    """(doc_id, version, begin, end) in words: stretches covered by windows that also start earlier; they may touch."""
    zipped = F.arrays_zip("seeds", "at", "lo", "hi", "run", "windows")
    with scratch(extended.sparkSession) as keep:
        places = written(extended.where("seeds is not null").select("doc_id", "version", F.explode(zipped).alias("p")).select("doc_id", "version", F.col("p.seeds").alias("seed"), "p.at", "p.lo", "p.hi", "p.run", "p.windows"))
        key = ["seed", "run", "lo", "hi"]
        classes = written(places.groupBy(*key).agg(F.min(F.struct("doc_id", "version", "at", "windows")).alias("first"), F.count("*").alias("n")))
        firsts = classes.where("n > 1").select(*key, F.struct("first.doc_id", "first.version", "first.at").alias("first"))
        later = places.drop("windows").join(firsts, key).where(F.struct("doc_id", "version", "at") > F.col("first"))
        whole = later.select("doc_id", "version", (F.col("at") + F.col("lo")).alias("begin"), (F.col("at") + F.col("hi") + width).alias("end"))
        several = written(classes.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
        edges = classes.join(several, "seed").select("seed", "lo", "first.doc_id", "first.version", "first.at", "first.windows")
        windows = written(edges.mapInArrow(_windows, "seed long, window long, doc_id long, version long, start int"))
        place = F.struct("doc_id", "version", "start")
        first = written(windows.groupBy("seed", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("seed", "window", "first"))
        repeated = windows.join(first, ["seed", "window"]).where(place > F.col("first"))
        return keep(whole.unionByName(repeated.select("doc_id", "version", F.col("start").alias("begin"), (F.col("start") + width).alias("end"))))


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document, and kept, the remaining words of changed ones."""
    extended = _extended(docs, width, gram)
    spans = _repeat_spans(extended, width).groupBy("doc_id", "version").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    changed = extended.where("seeds is not null").select("doc_id", "version", "text").join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    done = extended.where("seeds is null").select("doc_id", "n_words", F.when(F.col("kept_sha256") == _EMPTY, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return done.unionByName(changed.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))


_EMPTY = hashlib.sha256(b"").hexdigest()


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeats: doc_id, begin, end in words, each at least ``width`` long, that also occur earlier.

    Whole copies of a text are one repeat from the first to the last word.
    """
    extended = _extended(docs, width, gram)
    whole = extended.where((F.col("kept_sha256") == _EMPTY) & (F.col("n_words") > 0)).select("doc_id", F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end"))
    spans = _repeat_spans(extended, width).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("s"))
    grow = lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["begin"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x)))
    merged = spans.select("doc_id", F.explode(F.aggregate("s", F.array().cast("array<struct<begin:int,end:int>>"), grow)).alias("m"))
    return merged.select("doc_id", "m.begin", "m.end").unionByName(whole)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
