"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, salted_join


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """edges: (u, v) of one ordered type. Returns (node, root), root being the smallest
    node of its component, for every node that has an edge to another one. Nothing is
    collected; each round is written to the shared folder and the one before dropped. Hubs
    are reduced by partial aggregation and dealt over several tasks in the joins."""
    made = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal made
        made += 1
        out = scratch.stored(df, f"{name}-{made}")
        if made > 1:
            scratch.drop(f"{name}-{made - 1}")
        return out

    now = keep(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"], ["v"]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"], ["v"]).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
