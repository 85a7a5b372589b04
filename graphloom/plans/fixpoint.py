"""Semi-naive loops: level-wise traversal, reachability, layering and shortest paths as DataFrame steps.

Adjacency is kept for all levels as it comes, not dealt by its near end: a hub's edges stay in many tasks. A frontier is
broadcast to it while it is small; a large one is joined by shuffle, where a hub's rows are split at run time. Every
level's new nodes are checkpointed; a level's edges stay lazy and are read once, in the result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.materialize import cut, offered


@contextmanager
def kept(df: DataFrame):
    """df held for the time of a loop; lost parts are computed again from its lineage."""
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()


def levels(adjacency: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node, level: the least number of steps from start (column node) along adjacency (near, far); start is level 0."""
    visited = cut(start.select("node", F.lit(0).alias("level")).distinct())
    frontier, level = visited, 0
    rows = frontier.count()
    with kept(adjacency.select("near", "far")) as hops:
        while rows and (depth is None or level < depth):
            level += 1
            reached = hops.join(offered(frontier.select(F.col("node").alias("near")), rows), "near").select(F.col("far").alias("node")).distinct()
            frontier = cut(reached.join(visited.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level")))
            rows = frontier.count()
            if rows:
                visited = visited.unionByName(frontier)
                if level % 8 == 0:
                    visited = cut(visited)
    return visited


def longest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: the longest path from node down to a node without edges (near depends on far); 0 on or above a cycle.

    Leaves are peeled in rounds: each node counts the nodes it waits for, and a round takes those that became ready off
    the counts. Edges are read, never written again. Nodes that wait for ever get level 0.
    """
    nodes = nodes.select("node").distinct()
    with kept(edges.select("near", "far").where("near <> far").distinct()) as hops:
        waits = hops.groupBy(F.col("near").alias("node")).agg(F.count("*").alias("n"))
        state = cut(nodes.join(waits, "node", "left").select("node", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
        done, level = None, 0
        while True:
            ready = state.where("n = 0").select("node")
            rows = ready.count()
            if not rows:
                break
            now = ready.withColumn("level", F.lit(level))
            done = now if done is None else done.unionByName(now)
            met = hops.join(offered(ready.withColumnRenamed("node", "far"), rows), "far").groupBy(F.col("near").alias("node")).agg(F.count("*").alias("less"))
            state = cut(state.where("n > 0").join(met, "node", "left").select("node", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))
            level += 1
            if level % 16 == 0:
                done = cut(done)
    never = state.where("n > 0").select("node", F.lit(0).alias("level"))
    return never if done is None else done.unionByName(never)
