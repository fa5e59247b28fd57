"""Fraud-business features: anomalies of degree, time, diversity and risk around a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ringsight.functions.scalars import safe_div
from ringsight.graph import FraudGraph
from ringsight.operators.enhanced import SIDES, _integer_std, linked_counts, type_counts
from ringsight.operators.structure import directed_triangle_counts
from ringsight.operators.temporal import degree_counts, per_node


def degree_anomaly(graph: FraudGraph) -> DataFrame:
    """B1: in/(out+1), imbalance, isolated and one-way flags over the nodes that have an edge."""
    d = degree_counts(graph.edges, "o", "i")
    o, i = F.col("o"), F.col("i")
    return per_node(graph, d.select(
        "node", (i / (o + 1)).alias("biz_degree_ratio"), F.abs(o - i).alias("biz_degree_imbalance"),
        ((o == 0) & (i == 0)).cast("int").alias("biz_isolated_node"),
        ((o == 0) | (i == 0)).cast("int").alias("biz_one_way_node"),
    ))


def time_concentration(graph: FraudGraph) -> DataFrame:
    """B2: edges, active days, span, and edges per day of span and per active day."""
    stats = graph.edges.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("biz_total_trans"), F.countDistinct("ts").alias("biz_active_days"),
        (F.max("ts") - F.min("ts")).alias("biz_time_span"),
    )
    return per_node(graph, stats.withColumns({
        "biz_trans_concentration": F.col("biz_total_trans") / (F.col("biz_time_span") + 1),
        "biz_daily_intensity": F.col("biz_total_trans") / (F.col("biz_active_days") + 1),
    }))


def diversity(graph: FraudGraph) -> DataFrame:
    """Distinct edge types and distinct partners per source."""
    pairs = graph.edges.select("src", "dst").distinct()
    partners = pairs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("biz_unique_partners"))
    return per_node(graph, type_counts(graph, "biz_edge_type_diversity").join(partners, "node"))


def second_hop_fraud(graph: FraudGraph) -> DataFrame:
    """Fraud edges one hop away and two hops away, for every node.

    The second hop is the sum of the neighbours' own fraud-edge counts over the edges, so no pair
    is expanded. Edges are counted per (node, neighbour) first.
    """
    links = linked_counts(graph, F.col("label") == 1, {"out": "out", "in": "in"})
    parts = []
    for side, (key, other) in SIDES.items():
        parts.append(links.select(F.col("node").alias("node_id"), F.col(side).alias(f"biz_first_hop_fraud_{side}")))
        pairs = graph.edges.groupBy(F.col(key).alias("node_id"), F.col(other).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        second = pairs.join(links, "node").groupBy("node_id").agg(F.sum(F.col("n") * F.col(side)).alias(f"biz_second_hop_fraud_{side}"))
        parts.append(second)
    return graph.attach(*parts).fillna(0)


def time_gap_stats(graph: FraudGraph) -> DataFrame:
    """Mean, sample std, max and min of the gaps between consecutive out-edges."""
    # One row per (source, day): edges of the same day add zero gaps, so only days are ordered.
    days = graph.edges.groupBy("src", "ts").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("src").orderBy("ts"))
    days = days.withColumn("gap", gap.cast("bigint"))
    total, size, squares = F.sum("gap"), F.sum("n") - 1, F.sum(F.col("gap") * F.col("gap"))
    repeated = F.max("n") > 1
    return per_node(graph, days.groupBy(F.col("src").alias("node")).agg(
        F.try_divide(total.cast("double"), size).alias("biz_time_gap_mean"),
        _integer_std(size, total, squares).alias("biz_time_gap_std"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("biz_time_gap_max"),
        F.when(repeated, 0).otherwise(F.min("gap")).alias("biz_time_gap_min"),
    ))


def triangle_count(graph: FraudGraph) -> DataFrame:
    """Directed triangles s->t->u with s->u, counted for s on all distinct edges."""
    counts = directed_triangle_counts(graph.edges)
    return per_node(graph, counts.withColumnRenamed("n", "biz_triangle_count"))


def background_links(graph: FraudGraph) -> DataFrame:
    """Edges to and from background nodes (labels 2 and 3)."""
    names = {"out": "biz_bg_conn_out", "in": "biz_bg_conn_in"}
    return per_node(graph, linked_counts(graph, F.col("label").isin(2, 3), names))


def risk_accumulation(graph: FraudGraph) -> DataFrame:
    """Out-edges, last day, distinct fraud targets and their ratio over the edges plus one."""
    fraud = graph.labelled(F.col("label") == 1).select(F.col("node_id").alias("dst"), F.lit(1).alias("hit"))
    pairs = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    stats = pairs.join(fraud, "dst", "left").groupBy(F.col("src").alias("node")).agg(
        F.sum("n").alias("biz_total_transactions"), F.max("ts").alias("biz_last_activity"),
        F.count("hit").alias("biz_cumulative_fraud_conn"),
    )
    ratio = safe_div(F.col("biz_cumulative_fraud_conn"), F.col("biz_total_transactions") + 1)
    return per_node(graph, stats.withColumn("biz_fraud_conn_ratio", ratio))
