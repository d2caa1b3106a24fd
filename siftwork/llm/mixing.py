"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash, the first 60 bits of a digest of its doc_id; a source takes the documents whose hash is below its
threshold, plus whole repetitions. Thresholds come from sums of sizes by source and hash bucket:
the bucket in which the budget ends is refined by the next bits of the hash, and only its
documents take part, until a bucket holds one hash. No rows are sorted, and a larger budget
always takes a superset.

Defined results: a null source is a source of its own, after all others; documents without words
have size 0, are never counted and take 0; equal doc_ids, null ones too, have equal hashes and go in or stay out
together; an empty table gives an empty result. ``mix`` gives its own columns alone, whatever others the
input has; ``mixing_stage`` gives all of the input's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import table, word_count, written

WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2.0
_BITS, _ROUNDS = 12, 5


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources share ``budget`` times all sizes by weight; none gets over ``most`` times its size, and
    the excess goes to the others by weight until none is above. Sorted by the level at which each
    source is full, the final level follows from running sums, in one pass over one row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("w", weight).withColumn("full", F.col("source_size") * F.lit(most)).withColumn("level", F.col("full") / F.col("w"))
    before = one.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) * F.lit(budget) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("reach", level).withColumn("common", F.max(F.when(F.col("reach") <= F.col("level"), F.col("reach"))).over(one))
    return levelled.select("source", "source_size", F.when(F.col("common").isNull() | (F.col("level") <= F.col("common")), F.col("full")).otherwise(F.col("common") * F.col("w")).alias("target"))


def _bucket(bits_done: int):
    """The next bits of the hash, as a number; the hash is taken as unsigned by flipping its sign."""
    return F.shiftrightunsigned(F.shiftleft(F.col("hash"), bits_done), 64 - _BITS)


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): take ``whole`` repetitions, and one more where the hash is at most ``below``.

    ``below`` null: no more. ``sized`` has source, size, hash of documents with words.
    """
    state = written(
        goals.withColumn("whole", F.floor(F.try_divide("target", "source_size") + F.lit(1e-12)))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", F.coalesce("whole", F.lit(0)).cast("long").alias("whole"), F.coalesce("left", F.lit(0.0)).alias("left"), F.lit(0).cast("long").alias("prefix"))
    )
    rows = sized
    for k in range(_ROUNDS):
        done = k * _BITS
        named = state.select(F.col("source").alias("s"), "prefix")
        if k:
            inside = rows.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("hash", 64 - done) == F.col("prefix"))).drop("s", "prefix")
        else:
            inside = rows
        sums = inside.groupBy("source", _bucket(done).alias("bucket")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("upto", F.sum("size").over(order))
        ends = running.join(state.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("taken"),
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "size"))).alias("edge"),
            F.max("bucket").alias("last"),
        )
        moved = state.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        # without an edge all of the bucket's rest is taken: the prefix goes past its last bucket
        bucket = F.coalesce(F.col("edge.bucket"), F.col("last") + 1, F.lit(0))
        prefix = F.shiftleft("prefix", _BITS) + bucket if k else bucket
        state = written(moved.select("source", "source_size", "target", "whole", (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"), prefix.alias("prefix"), F.col("edge.size").alias("edge_size")))
    # the last bucket is taken if that comes nearer to the target
    last = F.when(2 * F.col("left") > F.col("edge_size"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select("source", "source_size", "target", "whole", last.alias("below"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each document."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    short = F.conv(F.substring(digest, 1, _BITS * _ROUNDS // 4), 16, 10).cast("long")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), short.alias("short")))
    rows = sized.where("size > 0").select("source", "size", F.shiftleft("short", 64 - _BITS * _ROUNDS).alias("hash"))
    goals = written(targets(sized.select("source", "size"), weights, budget, most))
    ends = thresholds(rows, goals)
    found = sized.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.when(F.col("short") <= F.col("below"), 1).otherwise(0), F.lit(int(most)))).otherwise(0)
    return found.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents as often as it takes them, those that it doesn't take left out."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    flat = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    copies = mix(docs.select("doc_id", "source", "text")).where("copies > 0").select(F.col("doc_id").alias("taken_id"), "copies").distinct()
    repeated = flat.join(copies, F.col(names["doc_id"]).eqNullSafe(F.col("taken_id")))
    again = repeated.select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*(F.col(n).alias(c) for c, n in names.items()))
