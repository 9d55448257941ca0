"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.scratch import Scratch


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars: each u has one v, which is no u itself."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
            .unionAll(edges.select("v", F.lit(0), F.lit(1))))
    return ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups + downs > 1 and ups > 0").agg(
        F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """edges (a long, b long) -> (node, label): label is the smallest node reachable.

    Nodes without an edge to another node are absent.  Every round joins the
    edges with each node's smallest neighbour, a partial minimum, so a hub costs
    one row per task and the optimiser may split it in the join.  Each round's
    edges are written to the shared folder; when they are stars nothing moves any more.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        # large star: larger neighbours move to the smallest of u and its neighbours, one row an edge
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours move to the smallest
        least = _least(large)
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
                 .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        after = scratch.keep(small)
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
