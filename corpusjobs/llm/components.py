"""Connected components of an edge table by alternating large and small stars; links stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, the component being its smallest node.

    Each round hangs the larger neighbours of a node to its smallest neighbour, then the smaller ones;
    the rounds end when a round changes nothing, after a number in the order of log^2 of the nodes.
    Edges with a null end or from a node to itself don't count; repeated ones count once.
    """
    pairs = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u > v").distinct())

    def seen(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"] or 0

    before = seen(pairs)
    while before[0]:
        both = pairs.unionAll(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = seen(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select("v", "v").distinct())
