"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import cut

MOST_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it can reach) of every node in ``edges`` (u, v longs).

    Each round moves the neighbours of a node to the smallest of them; rounds are few (logarithmic in the longest
    chain) and each is written to the shared folder. A node's neighbours are never gathered, only their minimum is.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = tuple(now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = cut(small)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
