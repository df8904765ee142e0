"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import stage, unstage


def _star(edges: DataFrame, smaller: bool) -> DataFrame:
    """One step: each node's (larger, or smaller) neighbours are linked to the
    least node near it. A hub's rows are only joined and aggregated, never
    gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both.where("v < u") if smaller else both
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    if smaller:
        out = near.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        out = near.join(least, "u").where("v > u").select(F.col("v").alias("x"), "m")
    return out.where("x <> m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is
    its least node. Large-star and small-star steps alternate until nothing
    changes, which takes about log(n) rounds; every round is written out."""
    now = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = now.agg(F.count("*"), mark).first()
    while before[0]:
        after = stage(_star(_star(now, False), True), "edges")
        state = after.agg(F.count("*"), mark).first()
        unstage(now)
        now = after
        if state == before:
            break
        before = state
    # a star forest: every node hangs on its component's least node
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
