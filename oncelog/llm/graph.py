"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MAX_ROUNDS = 60


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates hooking each node's larger neighbours to its smallest one with hooking
    its smaller neighbours there, until the edges are stars. Each round is a group-by
    over edges that are distinct, written to the shared folder; neither a component nor
    a list of neighbours is gathered anywhere. The side of least neighbours is written
    before it is joined, so that Spark can split the edges of a large centre.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # large star: larger neighbours of a node meet its smallest
        near = both(edges)
        least = work.write(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = work.write(near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        work.drop(least, edges)
        # small star: a node and its smaller neighbours meet the smallest of them
        least = work.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        small = work.write(small.select(F.explode(F.array("x", "a")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        work.drop(least, large)
        # stars: no node stands on both sides, and none has two centres
        mixed = small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        twice = small.groupBy("a").count().where("count > 1").select("a")
        done = mixed.select("a").unionAll(twice).limit(1).count() == 0
        edges = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    centres = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = work.write(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(centres), "components")
    work.drop(edges)
    return out
