"""Degrees, PageRank, triangles, clustering and constraint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.scalars import one_row, safe_div
from ringsight.graph import FraudGraph
from ringsight.operators.blocks import block_triangles
from ringsight.operators.temporal import degree_counts, endpoints
from ringsight.session import cut_lineage


def undirected_degree(und: DataFrame, name: str = "degree") -> DataFrame:
    return und.groupBy("node").agg(F.count(F.lit(1)).alias(name))


HOT_NODE = 10_000


def wide_stats(graph: FraudGraph, rows: DataFrame, aggs: list[Column], hot_node: int = HOT_NODE) -> DataFrame:
    """``rows(node, ..)`` of edge ends, aggregated per node into columns that take far more room than a row.

    A partial aggregate per task and node would be larger than the rows it stands for, in memory and in the
    shuffle. So the rows go to their node first; only nodes with more than ``hot_node`` edges are aggregated
    partially where their rows lie.
    """
    ends = undirected_degree(endpoints(graph.edges), "d")
    hot = cut_lineage(ends.where(F.col("d") > hot_node).select("node"))
    rows = rows.where(F.col("node").isNotNull())
    if hot.isEmpty():
        return rows.repartition("node").groupBy("node").agg(*aggs)
    ordinary = rows.join(hot, "node", "left_anti").repartition("node").groupBy("node").agg(*aggs)
    return ordinary.unionByName(rows.join(hot, "node", "left_semi").groupBy("node").agg(*aggs))


def triangles(edges: DataFrame) -> DataFrame:
    """Every undirected triangle once: ``(a, b, c)`` and which of the six directed edges exist.

    Edges point from the lower (degree, id) to the higher end. A node then keeps at most
    sqrt(2|E|) out-edges, however many it had, so no edge has more paths than that behind it.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = edges.where(F.col("src") != F.col("dst")).groupBy(low.alias("x"), high.alias("y")).agg(
        F.max(F.col("src") < F.col("dst")).alias("xy"), F.max(F.col("src") > F.col("dst")).alias("yx")
    )
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(degree.withColumnsRenamed({"node": "x", "d": "dx"}), "x").join(
        degree.withColumnsRenamed({"node": "y", "d": "dy"}), "y"
    )
    keep = (F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))
    swap = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    # Written once: its three uses are dealt to blocks, where the paths a -> b -> c meet the pairs a -> c.
    oriented = cut_lineage(ranked.select(
        swap("x", "y").alias("u"), swap("y", "x").alias("v"),
        (swap("xy", "yx").cast("int") + 2 * swap("yx", "xy").cast("int")).alias("x"),
    ))
    directed = {}
    for p, q in ("ab", "bc", "ac"):
        directed[p + q], directed[q + p] = F.col(p + q).bitwiseAND(1) > 0, F.col(p + q).bitwiseAND(2) > 0
    return block_triangles(oriented).withColumns(directed)


def directed_triangle_counts(edges: DataFrame) -> DataFrame:
    """Per s: pairs (t, u) with s->t, t->u and s->u over distinct nodes, ``(node, n)``."""
    def both(s: str, t: str, u: str) -> Column:
        def chain(p: str, q: str, r: str) -> Column:
            return F.col(p + q) & F.col(q + r) & F.col(p + r)

        return chain(s, t, u).cast("bigint") + chain(s, u, t).cast("bigint")

    counts = triangles(edges).select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), both("a", "b", "c").alias("n")),
        F.struct(F.col("b").alias("node"), both("b", "a", "c").alias("n")),
        F.struct(F.col("c").alias("node"), both("c", "a", "b").alias("n")),
    )))
    return counts.where(F.col("n") > 0).groupBy("node").agg(F.sum("n").alias("n"))


def triangle_corners(edges: DataFrame) -> DataFrame:
    """Each triangle as its six ordered corner pairs ``(node, nbr)``."""
    pair = lambda p, q: F.struct(F.col(p).alias("node"), F.col(q).alias("nbr"))
    return triangles(edges).select(F.inline(F.array(
        pair("a", "b"), pair("a", "c"), pair("b", "a"), pair("b", "c"), pair("c", "a"), pair("c", "b")
    )))


def degrees(graph: FraudGraph) -> DataFrame:
    """G1: directed and undirected degrees, their logs, share of the maximum, centrality."""
    directed = degree_counts(graph.edges, "out_degree", "in_degree").withColumnRenamed("node", "node_id")
    und = undirected_degree(graph.neighbours(), "total_degree").withColumnRenamed("node", "node_id")
    d = graph.attach(directed, und).fillna(0)
    top = one_row(d.agg(
        F.max("out_degree").alias("out_degree"), F.max("in_degree").alias("in_degree"), F.count(F.lit(1)).alias("n")
    ))
    return d.withColumns({
        **{f"{c}_log": F.log1p(F.col(c)) for c in ("out_degree", "in_degree", "total_degree")},
        **{f"{c}_norm": F.col(c) / (top[c] + 1e-8) for c in ("out_degree", "in_degree")},
        "degree_centrality": safe_div(F.col("total_degree"), top["n"] - 1),
    })


def pagerank(
    graph: FraudGraph, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6
) -> DataFrame:
    """Power iteration on the row-normalised undirected adjacency; no dangling correction."""
    und = graph.neighbours()
    n = graph.nodes.agg(F.count(F.lit(1)).cast("double")).first()[0]
    # The edge side carries 1/degree of its start and is written once; a step writes node rows only.
    links = cut_lineage(und.join(undirected_degree(und), "node").select(
        F.col("node").alias("node_id"), "nbr", (1.0 / F.col("degree")).alias("weight")
    ))
    rank = cut_lineage(graph.ids().withColumn("rank", F.lit(1.0 / n)))
    for _ in range(iterations):
        sent = rank.join(links, "node_id").groupBy(F.col("nbr").alias("node_id")).agg(
            F.sum(F.col("rank") * F.col("weight")).alias("received")
        )
        step = cut_lineage(rank.join(sent, "node_id", "left").select(
            "node_id", F.col("rank").alias("old"),
            (F.lit((1 - damping) / n) + damping * F.coalesce("received", F.lit(0.0))).alias("rank"),
        ))
        moved = step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = step.select("node_id", "rank")
        if moved is None or moved < tolerance:
            break
    return rank.select("node_id", F.col("rank").alias("pagerank"), F.log1p("rank").alias("pagerank_log"))


def _loops(edges: DataFrame) -> DataFrame:
    looped = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node")).distinct()
    return looped.withColumn("loop", F.lit(1))


def clustering_coefficient(graph: FraudGraph) -> DataFrame:
    """Links among the neighbours over the possible links, for every node.

    A self loop makes the node its own neighbour, linked to all the others.
    """
    k = undirected_degree(graph.neighbours(), "k")
    closed = triangle_corners(graph.edges).groupBy("node").agg((F.count(F.lit(1)) / 2).alias("closed"))
    d = k.join(closed, "node", "left").join(_loops(graph.edges), "node", "left").fillna(0, ["closed", "loop"])
    links = F.col("closed") + F.col("loop") * (F.col("k") - 1)
    value = safe_div(2 * links, F.col("k") * (F.col("k") - 1))
    return graph.attach(d.select(F.col("node").alias("node_id"), value.alias("clustering_coeff"))).fillna(0)


def second_order_walks(graph: FraudGraph) -> DataFrame:
    """Number of walks of length two, the sum of the neighbours' degrees."""
    und = graph.neighbours()
    d = undirected_degree(und).withColumnRenamed("node", "nbr")
    sums = und.join(d, "nbr").groupBy(F.col("node").alias("node_id")).agg(F.sum("degree").alias("second_neighbors"))
    return graph.attach(sums).fillna(0).withColumn("second_neighbors_log", F.log1p("second_neighbors"))


def neighbour_degree_stats(graph: FraudGraph) -> DataFrame:
    """Mean, max, min and population std of the neighbours' degrees."""
    und = graph.neighbours()
    d = undirected_degree(und).withColumnRenamed("node", "nbr")
    stats = und.join(d, "nbr").groupBy(F.col("node").alias("node_id")).agg(
        F.avg("degree").alias("neighbor_degree_mean"), F.max("degree").alias("neighbor_degree_max"),
        F.min("degree").alias("neighbor_degree_min"), F.stddev_pop("degree").alias("neighbor_degree_std"),
    )
    return graph.attach(stats).fillna(0)


def constraint(graph: FraudGraph) -> DataFrame:
    """Sum over neighbours q and common neighbours j of 1/(d_i d_q); 1 for isolated nodes."""
    d = undirected_degree(graph.neighbours(), "d")
    common = triangle_corners(graph.edges).groupBy("node", "nbr").agg(F.count(F.lit(1)).alias("n"))
    shared = common.join(d.withColumnsRenamed({"node": "nbr", "d": "dq"}), "nbr").groupBy("node").agg(
        F.sum(F.col("n") / F.col("dq")).alias("s")
    )
    rows = d.join(shared, "node", "left").join(_loops(graph.edges), "node", "left").fillna(0, ["s", "loop"])
    # A self loop is a neighbour q = i that shares all the other neighbours.
    own = F.col("loop") * (F.col("d") - 1) / F.col("d")
    value = rows.select(F.col("node").alias("node_id"), ((F.col("s") + own) / F.col("d")).alias("constraint"))
    return graph.attach(value).fillna(1.0)
