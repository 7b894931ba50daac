"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (summed up before the shuffle) and a join, so no
node's neighbours are ever gathered in one place and no edge leaves Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) of the nodes of ``edges`` (u long, v long)."""
    now = scratch.put(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.put(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        centre = low.select(F.col("u").alias("c"), "m")
        small = large.join(centre, large["u"] == centre["c"]).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(now, large)
        now = new
        if (row["n"], row["h"]) == state:
            # every edge now leads from a node to its component's smallest
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = (row["n"], row["h"])
    raise RuntimeError("components did not settle")
