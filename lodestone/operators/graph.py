"""Connected components as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph as (id, component), component being the smallest id reachable.

    edges: columns a, b (longs; self loops and repeats allowed). Only nodes that occur in edges come out. Each
    round is a large-star step, then a small-star step (Kiveris et al. 2014, "Connected Components in MapReduce and
    Beyond"): every node hangs its neighbours on the smallest of them. A logarithmic number of rounds suffices on
    long chains too. Minima are pre-aggregated before they are shuffled; the join that hands a minimum to a hub's
    neighbours is an equi-join of two plain tables, so that Spark can broadcast the minima or split a hub's partition.
    """
    loops = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "large")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = scratch.table(small.where("u <> v").distinct(), "edges")
        # fixed point: every edge joins a node to a root, no root has an edge of its own and no node has two roots
        roots = new.select(F.col("v").alias("u")).distinct()
        done = new.join(roots, "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty()
        scratch.drop(e, large, low, least)
        e = new
        if done:
            break
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return found.union(loops).groupBy("id").agg(F.min("component").alias("component"))
