"""Ranking by structure and history: PageRank importance and churn hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators.lookup import edge_filter, ranked
from graphloom.plans.materialize import cut, offered

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def passed_on(start: DataFrame, share: DataFrame, n: int, rounds: int) -> DataFrame:
    """node, v0, v1 .. : a value (v0) of each node and what comes of it when it is passed along the shares once, twice ..

    A round passes all values on at once and puts the first in front again, so each step of the plan is read by one
    other only and a checkpoint is needed for several rounds. Sums are made before the shuffle: a hub is one row of each
    task. Edges aren't dealt beforehand, so the rows of a node with many can be split at run time.
    """
    state = start
    for k in range(1, rounds + 1):
        met = share.join(offered(state.withColumnRenamed("node", "near"), n), "near")
        got = met.groupBy(F.col("far").alias("node")).agg(*(F.sum(F.col("share") * F.col(f"v{i}")).alias(f"v{i + 1}") for i in range(k)))
        state = start.join(offered(got, n), "node", "left").na.fill(0.0)
    return cut(state)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, damping: float = DAMPING, every: int = 5) -> DataFrame:
    """node, score. edges: near, far, one row for each edge that counts; both ends must be nodes.

    Rank of nodes without edges is spread over all. Rounds end when no score changes by the tolerance (None: never),
    which is looked at after every few rounds. These run as one job: what is spread in a round is the same for all nodes,
    so the scores after some rounds are a sum of the scores and of ones, passed along the edges, with weights that follow
    from what the nodes without edges have got of each.
    """
    nodes = cut(nodes.select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    out = edges.groupBy(F.col("near").alias("node")).agg(F.count("*").alias("out"))
    share = edges.groupBy("near", "far").agg(F.count("*").alias("k")).join(out.withColumnRenamed("node", "near"), "near")
    share = cut(share.select("near", "far", (F.col("k") / F.col("out")).alias("share")))
    ones = passed_on(nodes.withColumn("v0", F.lit(1.0)), share, n, every - 1).withColumnsRenamed({f"v{i}": f"w{i}" for i in range(every)})
    ends = nodes.join(share.select(F.col("near").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(True).alias("dangling"))
    ones = cut(ones.join(ends, "node", "left").na.fill(False))
    state, done = ones.withColumn("score", F.lit(1.0 / n)), 0
    while done < rounds:
        some = min(every, rounds - done)
        done += some
        values = passed_on(state.select("node", F.col("score").alias("v0")), share, n, some)
        block = cut(ones.join(values, "node"))
        names = [f"w{i}" for i in range(every)] + [f"v{i}" for i in range(some + 1)]
        at_ends = block.where("dangling").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names)).first()
        constant: list[float] = []

        def weights(i: int) -> dict[str, float]:
            """Of the scores after i rounds of the block."""
            return {f"w{j}": constant[i - 1 - j] * damping**j for j in range(i)} | {f"v{i}": damping**i}  # noqa: B023

        for i in range(some):
            lost = sum(w * at_ends[c] for c, w in weights(i).items())
            constant.append((1 - damping) / n + damping * lost / n)
        last, before = (sum((F.lit(w) * F.col(c) for c, w in weights(i).items()), F.lit(0.0)) for i in (some, some - 1))
        state = cut(block.select("node", last.alias("score"), F.abs(last - before).alias("change")))
        if tolerance is not None and state.agg(F.max("change")).first()[0] < tolerance:
            break
    return state.select("node", "score")


def importance(g: Graph, top: int | None = 20, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """qualified_name, score, rank: PageRank over calls, references and satisfies between code that is neither test nor
    generated. Edges of several types between two symbols count each."""
    nodes = g.symbols.where(~F.col("is_test") & ~F.col("is_generated")).select(F.col("qualified_name").alias("node")).distinct()
    edges = edge_filter(g.edges, ("calls", "references", "satisfies")).select(F.col("from_ref").alias("near"), F.col("to_ref").alias("far"))
    edges = edges.join(nodes.withColumnRenamed("node", "near"), "near", "left_semi").join(nodes.withColumnRenamed("node", "far"), "far", "left_semi")
    rows = pagerank(nodes, edges, rounds, tolerance)
    if top:
        rows = ranked(rows.orderBy(F.col("score").desc(), "node").limit(top), F.col("score").desc(), F.col("node"))
    return rows.withColumnRenamed("node", "qualified_name")


def hotspots(g: Graph, top: int | None = 20, min_complexity: int = 1, min_churn: int = 1) -> DataFrame:
    """qualified_name, complexity, churn_count, risk, rank: complexity times ln(churn + 1); ties by name."""
    rows = g.symbols.where(~F.col("is_test") & ~F.col("is_generated") & (F.col("complexity") >= min_complexity) & (F.col("churn_count") >= min_churn))
    rows = rows.select("qualified_name", "complexity", "churn_count", (F.col("complexity") * F.log1p("churn_count")).alias("risk"))
    if top:
        rows = ranked(rows.orderBy(F.col("risk").desc(), "qualified_name").limit(top), F.col("risk").desc(), F.col("qualified_name"))
    return rows
