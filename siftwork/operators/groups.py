"""Duplicate links and the groups they make: same source, same checksum, hash within a radius."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.exprs import group_id, hash_halves
from siftwork.operators.graph import connected_components
from siftwork.sources.shared import materialized, scratch


def equal_value_links(manifest: DataFrame, column: str, key: str = "sample_id", fold_case: bool = False) -> DataFrame:
    """x, y: each row and the least row of its value. A star for each value, never all pairs.

    This join and those below merge: each side grows with the rows, and its compressed file is far smaller
    than the table that a broadcast would build in the driver.
    """
    value = F.lower(F.col(column)) if fold_case else F.col(column)
    rows = manifest.select(F.col(key).alias("y"), value.alias("v")).where("v is not null and v <> ''")
    least = materialized(rows.groupBy("v").agg(F.min("y").alias("x"), F.count("*").alias("n")).where("n > 1").select("v", "x"))
    return rows.join(least.hint("merge"), "v").where("x <> y").select("x", "y")


#: Most keys for each hash: more agreeing bands make fewer candidates, but more keys.
MOST_KEYS = 84


def band_masks(radius: int) -> list[int]:
    """Masks over 64 bits such that hashes within ``radius`` bits agree on all bits of one mask at least.

    Of radius + c bands, differing bits touch ``radius`` at most, so some c agree: a mask for each choice of c.
    """
    c = max((c for c in range(1, min(radius, 64 - radius) + 1) if math.comb(radius + c, c) <= MOST_KEYS), default=1)
    n = radius + c
    edges = [64 * i // n for i in range(n + 1)]
    bands = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bands, c)]


def hash_pairs(manifest: DataFrame, radius: int, column: str = "perceptual_hash") -> DataFrame:
    """a, b (a < b), distance: distinct hashes of 16 hex digits within ``radius`` bits.

    An equality join on (mask, bits under it) finds them all; at radius 4 a mask has 32 bits, so
    that candidates don't grow with the square of the hashes until there are billions. Equal hashes are
    one value here, so a frequent hash costs one row for each mask. The join merges: Spark takes a side's size
    from the file of hashes, before each becomes a row for each mask, and would broadcast it through the driver.
    """
    if not 0 <= radius <= 63:
        raise ValueError("radius must be from 0 to 63")
    name = F.lower(F.col(column))
    hashes = manifest.select(name.alias("h")).where(r"h rlike '\\A[0-9a-f]{16}\\z'").distinct()
    hi, lo = hash_halves(F.col("h"))
    bits = materialized(hashes.select((F.shiftleft(hi, 32).bitwiseOR(lo)).alias("bits")))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*(F.lit(signed(m)).cast("long") for m in band_masks(radius)))
    rows = bits.select("bits", F.posexplode(masks).alias("i", "mask")).select("i", F.col("bits").bitwiseAND(F.col("mask")).alias("part"), "bits")
    left, right = (rows.select("i", "part", F.col("bits").alias(c)) for c in ("x", "y"))
    # unsigned order, which is that of the digits
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int")
    near = left.join(right.hint("merge"), ["i", "part"]).where(unsigned("x") < unsigned("y")).where(distance <= radius).select("x", "y", distance.alias("distance")).distinct()
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return near.select(digits("x").alias("a"), digits("y").alias("b"), "distance")


def duplicate_links(manifest: DataFrame, radius: int = 4) -> DataFrame:
    """x, y: links whose closure joins all rows that share a source or a checksum, or have hashes within the radius."""
    same = equal_value_links(manifest, "source_group_id").unionByName(equal_value_links(manifest, "content_checksum", fold_case=True)).unionByName(equal_value_links(manifest, "perceptual_hash", fold_case=True))
    least = manifest.select(F.lower("perceptual_hash").alias("h"), "sample_id").groupBy("h").agg(F.min("sample_id").alias("s"))
    pairs = hash_pairs(manifest, radius)
    first, second = (least.select(F.col("h").alias(h), F.col("s").alias(s)).hint("merge") for h, s in (("a", "x"), ("b", "y")))
    near = pairs.join(first, "a").join(second, "b")
    return same.unionByName(near.select("x", "y")).distinct()


def split_groups(manifest: DataFrame, radius: int = 4) -> DataFrame:
    """``manifest`` with split_group_id, from the least sample_id of each group."""
    with scratch(manifest.sparkSession) as keep:
        keys = materialized(manifest.select("sample_id", "source_group_id", "content_checksum", "perceptual_hash"))
        found = keep(connected_components(duplicate_links(keys, radius), "x", "y").select(F.col("id").alias("__id"), "component"))
    joined = manifest.join(found.hint("merge"), F.col("sample_id") == F.col("__id"), "left")
    return joined.withColumn("split_group_id", group_id(F.coalesce("component", "sample_id"))).drop("__id", "component")
