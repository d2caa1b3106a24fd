"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftwork.sources.shared import materialized, scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(id, component) for every vertex of ``edges``; component is the least id that can be reached.

    Each round takes the least label among a vertex and its neighbours (map-side combined, so that a
    hub costs one row for each map task), moves what has that label's owner as label along, and then
    jumps labels over labels, which halves long chains. A round is one job; it is written to shared
    storage, so a lost executor costs one round at most, and counts its moves while it is written.
    Joins merge: labels grow with the vertices, and as a broadcast each round's would go through the driver.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    with scratch(edges.sparkSession) as keep:
        both = materialized(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        label = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("l"))
        label = materialized(label)
        for _ in range(max_rounds):
            seen = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("n")).hint("merge"), "b").groupBy("a").agg(F.min("n").alias("n"))
            hooked = label.join(seen.hint("merge"), "a").select("a", F.col("l").alias("was"), F.least("l", "n").alias("l"))
            # what a root's members have seen moves the root itself
            lowered = hooked.where("l < was").groupBy(F.col("was").alias("a")).agg(F.min("l").alias("low"))
            moved = hooked.join(lowered.hint("merge"), "a", "left").select("a", "was", F.least("l", F.coalesce("low", "l")).alias("l"))
            jump = label.select(F.col("a").alias("l"), F.col("l").alias("far"))
            after = moved.join(jump.hint("merge"), "l", "left").select("a", "was", F.least("l", F.coalesce("far", "l")).alias("l"))
            moves = Observation()
            label = materialized(after.observe(moves, F.count_if(F.col("l") != F.col("was")).alias("n")).select("a", "l"))
            if not moves.get["n"]:
                return keep(label.select(F.col("a").alias("id"), F.col("l").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
