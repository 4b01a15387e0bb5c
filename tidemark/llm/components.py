"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the smallest node that it reaches) of every node of edges (a, b, longs, not null).

    Alternates two steps until nothing changes: each node links its larger neighbours to
    its smallest one, then its smaller neighbours. Each has one edge per edge at most, so a hub's
    links are spread again at once. Takes about the logarithm of the longest path; more
    than ``rounds`` raises. Edges may repeat or join a node to itself. No edges: no rows.
    """
    every = common.cut_lineage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))  # asked twice
    e = common.cut_lineage(every.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.distinct()
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        e = small.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = common.cut_lineage(e.select(F.col("x.*")).toDF("a", "b").where("a <> b").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return roots.union(every.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("label")))
