"""MinHash near-duplicate detection with tensored banding.

A document's set is its distinct five-word shingles. Two collections of ``TABLES`` half keys, each
a hash of ``HALF`` minhashes, are computed; a table key is a pair of one half key from each, so
``TABLES ** 2`` tables cost ``2 * TABLES * HALF`` minhashes instead of ``TABLES ** 2 * 2 * HALF``.
At a similarity of 0.75 a pair shares no table with probability 2 * (1 - 0.75**3)**24 = 4e-6.

1. Equal sets collapse to the one with the least doc_id, by a digest of 128 bits.
2. Half keys held by one set only are dropped, in both collections, before any pair of half keys
   is formed: a set that shares no half key in one collection shares no table. What remains forms
   table keys.
3. In each table the member with most shared half keys is the centre; all others are verified
   against it. That finds the links of a group around a base in as many pairs as members.
4. Links make components. What is left are pairs in different components. The members of tables
   that hold several components meet once more by two exact filters, on the rarest elements in which
   they differ from a common pivot and on their rarest shingles, and those pairs are verified too; so
   no table's pair is lost whatever the table's size. Before any pair is formed, the places at
   which a document meets others are cut to those that some partner's size and place allow, and
   meet as one row for each component, so pairs inside a component are never formed.

Every link is confirmed on full sets of shingle hashes (64 bits, from digests of the words).
Nothing is capped. In step 4 pages that share a template and hold text of their own meet nowhere
unless they reach the similarity. What remains quadratic is a corpus of documents that share their
rare shingles too, stay below the similarity, and yet share tables: blocks of text dealt at random.

Defined results: null, blank and wordless texts have no shingles and link with nothing; a text of
one to four words has its whole sequence as one shingle. Repeated rows get equal results; rows that
share a doc_id only are each judged by its own text, and what links one of them links the doc_id.
Documents without doc_id are kept and link with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bytescan import Runs, Texts, pieces, spread
from siftwork.llm.common import scratch, table, written
from siftwork.operators.graph import connected_components

SHINGLE, SIMILARITY_PERCENT = 5, 75
TABLES, HALF = 24, 3

_rng = np.random.default_rng(41)
_N = 2 * TABLES * HALF
_FLIP = _rng.integers(0, 2**32, _N, np.uint64).astype(np.uint32)
_TIMES = _rng.integers(0, 2**32, _N, np.uint64).astype(np.uint32) | np.uint32(1)
_FOLD = _rng.integers(0, 2**63, HALF, np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, sorted and distinct within each text; bounds of the texts)."""
    words = Texts(column, lower=True).words()
    runs = Runs(words.hashes(1), 1)
    per = np.where(words.count >= SHINGLE, words.count - SHINGLE + 1, np.minimum(words.count, 1))
    start, text = spread(words.first[:-1], words.first[:-1] + per)
    hashes = runs.hash(start, np.minimum(start + SHINGLE, words.first[1:][text]))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(words.texts.n + 1))


def half_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2 * TABLES) half keys; every text has a shingle."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.empty((len(bounds) - 1, _N), np.uint32)
    for i in range(_N):
        y = (x ^ _FLIP[i]) * _TIMES[i]
        y ^= y >> np.uint32(15)
        least[:, i] = np.minimum.reduceat(y, bounds[:-1])
    keys = least.reshape(-1, 2 * TABLES, HALF).astype(np.uint64)
    return ((keys + np.uint64(1)) * _FOLD).sum(axis=2, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, bounds = shingle_sets(part.column("text"))
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            keys = np.zeros((len(size), 2 * TABLES), np.int64)
            if len(some):
                keys[some] = half_keys(hashes, np.append(bounds[:-1][some], len(hashes))).view(np.int64)
            digest = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary())]
            offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * TABLES)
            for k in (0, 1):
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(keys[:, k * TABLES : (k + 1) * TABLES]).reshape(-1))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, bounds = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["doc_id", "items"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets reach the similarity."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"{c}_items")) for c in ("x", "y"))
    both = F.size(F.array_intersect("x_items", "y_items"))
    either = F.size("x_items") + F.size("y_items") - both
    return pairs.join(left, "x").join(right, "y").where(100 * both >= SIMILARITY_PERCENT * either).select("x", "y")


def _could_reach(x: str, y: str):
    """Sizes alone rule the pair out if the smaller is below the similarity times the larger."""
    return 100 * F.least(F.col(x), F.col(y)) >= SIMILARITY_PERCENT * F.greatest(F.col(x), F.col(y))


def _members(signed: DataFrame) -> DataFrame:
    """(key, doc_id, n, weight): members of each table that two sets or more share."""
    kept = None
    for side in ("a", "b"):
        rows = signed.select("doc_id", F.posexplode(side).alias("i", "h"))
        shared = written(rows.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1"))
        mine = rows.join(shared, ["i", "h"]).groupBy("doc_id").agg(F.collect_list(F.struct("i", "h")).alias(side), F.sum(F.log2("n")).alias(f"{side}_weight"))
        kept = mine if kept is None else kept.join(mine, "doc_id")
    kept = kept.join(signed.select("doc_id", F.col("n_shingles").alias("n")), "doc_id")
    keyed = kept.select("doc_id", "n", (F.col("a_weight") + F.col("b_weight")).alias("weight"), F.explode("a").alias("a"), "b").select("doc_id", "n", "weight", "a", F.explode("b").alias("b"))
    members = keyed.select(F.xxhash64("a.i", "a.h", "b.i", "b.h").alias("key"), "doc_id", "n", "weight")
    return written(members)


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed sets: doc_id, n_shingles, first of the equal sets; verified links x, y between different sets)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = written(docs.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>"))
    firsts = written(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first")))
    distinct = signed.join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    with scratch(docs.sparkSession) as keep:
        members = _members(distinct)
        centres = written(members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("neg"), "n")).alias("c"), F.count("*").alias("m")).where("m > 1").select("key", (-F.col("c.neg")).alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.weight").alias("centre_weight")))
        star = members.join(centres, "key").where("doc_id <> centre").where(_could_reach("n", "centre_n"))
        pairs = written(star.select(F.least("doc_id", "centre").alias("x"), F.greatest("doc_id", "centre").alias("y")).distinct())
        several = written(members.join(centres, "key", "left_semi"))
        sets = written(docs.join(several.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, items array<long>"))
        found = keep(_verified(pairs, sets))
        rest = written(_rest(several, centres, connected_components(found, "x", "y"), sets))
        more = keep(_verified(rest.join(pairs, ["x", "y"], "left_anti"), sets))
    copies = signed.join(firsts, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))
    return copies, found.unionByName(more)


def _undecided(several: DataFrame, centres: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, component, pivot) of the members of tables that hold more than one component.

    The pivot is the heaviest centre of all tables that the document is in.
    """
    labelled = written(several.join(groups.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = written(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    open_ = written(labelled.join(mixed, "key", "left_semi").select("doc_id").distinct())
    rows = labelled.join(open_, "doc_id", "left_semi").join(centres, "key")
    return rows.groupBy("doc_id", "component").agg(F.max(F.struct("centre_weight", (-F.col("centre")).alias("neg"))).alias("c")).select("doc_id", "component", (-F.col("c.neg")).alias("pivot"))


def _rarest_first(rows: DataFrame, keys: list[str], size: str, prefix: Column) -> DataFrame:
    """keys, item, at: the first ``prefix`` elements of each row's ``items``, rarest first over all rows, without those it has alone.

    ``at`` counts from 1 in that order; elements that one row has alone come first and only move
    the others back.
    """
    items = written(rows.select(*keys, F.explode("items").alias("item")))
    shared = written(items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"))
    kept = items.join(shared, "item").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("s"))
    alone = F.col(size) - F.size("s")
    placed = kept.select(*keys, alone.alias("alone"), prefix.alias("prefix"), F.posexplode("s").alias("i", "entry"))
    return written(placed.withColumn("at", F.col("alone") + F.col("i") + 1).where("at <= prefix").select(*keys, F.col("entry.item").alias("item"), "at"))


def _met(rows: DataFrame, also: list[str]) -> DataFrame:
    """Pairs (x, y) of documents in different components that share an element and pass the test of places.

    ``rows``: item, ``also``, doc_id, component, n, need, room. A pair passes where each one's need is at
    most the other's room. In such a pair one at least has a room as large as its own need, or each
    need would be below the other; only those lead the join. Elements without such a row, or within
    one component, and rows with less room than the least need of a leader, go before it.
    """
    key = ["item", *also]
    leads = F.col("room") >= F.col("need")
    groups = written(rows.groupBy(*key, "component").agg(F.min("need").alias("need"), F.max("room").alias("room"), F.min(F.when(leads, F.col("need"))).alias("lead")))
    open_ = groups.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("lead").alias("least")).where("lo < hi and least is not null").select(*key, "least")
    left = written(groups.join(open_, key).where("room >= least").drop("least"))
    x, y = (left.select(*key, *(F.col(c).alias(f"{s}_{c}") for c in ("component", "need", "room", "lead"))) for s in ("x", "y"))
    both = F.expr("x_need <= y_room and y_need <= x_room and x_component <> y_component and (y_lead is null or x_component < y_component)")
    meet = written(x.where("x_lead is not null").join(y, key).where(both).select(*key, "x_component", "y_component"))
    x, y = (rows.select(*key, *(F.col(c).alias(f"{s}_{c}") for c in ("component", "doc_id", "n", "need", "room"))) for s in ("x", "y"))
    pairs = meet.join(x, [*key, "x_component"]).join(y, [*key, "y_component"]).where("x_need <= y_room and y_need <= x_room").where(_could_reach("x_n", "y_n"))
    return pairs.select(F.least("x_doc_id", "y_doc_id").alias("x"), F.greatest("x_doc_id", "y_doc_id").alias("y"))


def _rest(several: DataFrame, centres: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of documents in different components that meet in a table and may reach the similarity.

    All pairs of a table would grow with the square of its size, so two exact filters find those
    that count. Sets x and y reach the similarity iff they differ in at most (|x| + |y|) / 7 elements.

    With the same pivot p, let E(x) be the elements in which x and p differ. x and y then differ in
    |E(x)| + |E(y)| - 2 |E(x) & E(y)|, which bounds from below how many of their differences from
    the pivot they share. One of the two isn't linked with the pivot, or they were in one
    component, and so the bound is positive: documents that were edited apart share none of their
    rarest differences and never meet.

    With different pivots, x and y share one of the rarest |x| - ceil(0.75 |x|) + 1 shingles of each.
    """
    open_ = written(_undecided(several, centres, groups))
    own = open_.join(sets, "doc_id").withColumn("n", F.size("items"))
    pivots = sets.join(open_.select(F.col("pivot").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("pivot"), F.col("items").alias("pivot_items"))
    apart = own.join(pivots, "pivot").select("doc_id", "component", "pivot", "n", F.size("pivot_items").alias("p"), F.concat(F.array_except("items", "pivot_items"), F.array_except("pivot_items", "items")).alias("items"))
    apart = apart.withColumn("e", F.size("items")).withColumn("linked", 7 * F.col("e") <= F.col("n") + F.col("p"))
    # the least number of shared differences with any document that isn't linked to the pivot, or of one that isn't
    least = F.when(F.col("linked"), F.floor((7 * F.col("e") + F.col("p") - F.col("n")) / 14) + 1).otherwise(F.ceil((7 * F.col("e") - F.col("n") - F.col("p")) / 14))
    # differences from two pivots are elements of two kinds
    tagged = apart.withColumn("items", F.transform("items", lambda x: F.struct("pivot", x.alias("item"))))
    edits = _rarest_first(tagged, ["doc_id", "component", "n", "e", "linked", "p"], "e", F.col("e") - F.greatest(F.lit(1), least) + 1)
    # of the elements that two documents share, at most 1 + e - at follow from a place on
    near = _met(edits.select("item", "doc_id", "component", "n", *_test(7 * F.col("e") - F.col("n"), 14 * (1 + F.col("e") - F.col("at")))), [])
    # the same for shingles, where the pivots may differ
    places = F.col("n") - F.ceil(F.col("n") * SIMILARITY_PERCENT / 100).cast("int") + 1
    prefixes = _rarest_first(own, ["doc_id", "component", "n"], "n", places)
    far = _met(prefixes.select("item", "doc_id", "component", "n", *_test(SIMILARITY_PERCENT * F.col("n"), (100 + SIMILARITY_PERCENT) * (1 + F.col("n") - F.col("at")))), [])
    return near.unionByName(far).distinct()


def _test(need: Column, most: Column) -> tuple[Column, Column]:
    """A pair passes if both places leave as much as both need: min(most) >= need + need, each one's need at most the other's room."""
    return need.cast("long").alias("need"), (most - need).cast("long").alias("room")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    copies, linked = links(docs)
    groups = connected_components(linked, "x", "y").select(F.col("id").alias("first"), "component")
    out = copies.join(groups, "first", "left")
    component = F.coalesce("component", "first", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least doc_id; all columns stay."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
