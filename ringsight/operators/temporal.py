"""Degree, time-window, type-ratio and risk features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.scalars import safe_div
from ringsight.graph import FraudGraph

WINDOWS = (7, 15, 30)
EDGE_TYPES = tuple(range(11))  # always given a column; other types of the edges get theirs after them


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge twice, once per end: ``(node, nbr, is_out, columns..)``.

    Out- and in-statistics then need one scan and one shuffle on ``node``.
    """
    def side(node: str, nbr: str, out: bool) -> Column:
        return F.struct(
            F.col(node).alias("node"), F.col(nbr).alias("nbr"), F.lit(out).alias("is_out"),
            *[F.col(c) for c in columns],
        )

    return edges.select(F.inline(F.array(side("src", "dst", True), side("dst", "src", False))))


def last_day(edges: DataFrame) -> Column:
    return edges.agg(F.max("ts")).scalar()


def per_node(graph: FraudGraph, stats: DataFrame) -> DataFrame:
    """Rows keyed by ``node`` onto all node ids; nodes without edges get 0."""
    names = [c for c in stats.columns if c != "node"]
    return graph.attach(stats.withColumnRenamed("node", "node_id")).fillna(0, names)


def edge_types(graph: FraudGraph) -> list[int]:
    """The published types and those of the edges; edge types are few, so their list reaches the driver."""
    found = graph.edges.where("edge_type is not null").select("edge_type").distinct().collect()
    return [*EDGE_TYPES, *sorted({r.edge_type for r in found} - set(EDGE_TYPES))]


def time_window_counts(graph: FraudGraph, windows=WINDOWS) -> DataFrame:
    """Edges of the last w days, leaving and entering."""
    recent = endpoints(graph.edges, "ts").withColumn("age", last_day(graph.edges) - F.col("ts"))
    out, age = F.col("is_out"), F.col("age")
    aggs = [F.count_if(out & (age < w)).alias(f"td_{w}") for w in windows]
    aggs += [F.count_if(~out & (age < w)).alias(f"td_in_{w}") for w in windows]
    return per_node(graph, recent.where(age < max(windows)).groupBy("node").agg(*aggs))


def type_window_counts(graph: FraudGraph, windows=WINDOWS, types: list[int] | None = None) -> DataFrame:
    """Out-edges of each type in the last w days; ``types`` as of ``edge_types`` if not given."""
    types = edge_types(graph) if types is None else types
    age = last_day(graph.edges) - F.col("ts")
    recent = graph.edges.select(F.col("src").alias("node"), "edge_type", age.alias("age"))
    aggs = [
        F.count_if((F.col("edge_type") == t) & (F.col("age") < w)).alias(f"td_type{t}_{w}")
        for t in types for w in windows
    ]
    return per_node(graph, recent.where(F.col("age") < max(windows)).groupBy("node").agg(*aggs))


def degree_counts(edges: DataFrame, out_name: str, in_name: str) -> DataFrame:
    return endpoints(edges).groupBy("node").agg(
        F.count_if("is_out").alias(out_name), F.count_if(~F.col("is_out")).alias(in_name)
    )


def degree_features(graph: FraudGraph) -> DataFrame:
    """D3: out, in and total degree, their ratio and imbalance."""
    d = per_node(graph, degree_counts(graph.edges, "out_degree", "in_degree"))
    out, inn = F.col("out_degree"), F.col("in_degree")
    return d.withColumns({
        "total_degree": out + inn,
        "degree_ratio": safe_div(out, inn),
        "degree_imbalance": F.abs(out - inn),
    })


def temporal_features(graph: FraudGraph) -> DataFrame:
    """Active days, last active day and days since, per direction."""
    # (node, direction, day) first: the distinct count of a hot node is then spread over its days.
    days = endpoints(graph.edges, "ts").groupBy("node", "is_out", "ts").agg(F.lit(1).alias("one"))
    out = F.col("is_out")
    stats = days.groupBy("node").agg(
        F.count_if(out).alias("active_days_out"),
        F.count_if(~out).alias("active_days_in"),
        F.max(F.when(out, F.col("ts"))).alias("last_active_out"),
        F.max(F.when(~out, F.col("ts"))).alias("last_active_in"),
    )
    end = last_day(graph.edges)
    return per_node(graph, stats).withColumns({
        "inactive_days_out": end - F.col("last_active_out"),
        "inactive_days_in": end - F.col("last_active_in"),
    })


def type_ratio_7d(graph: FraudGraph, types: list[int] | None = None, days: int = 7) -> DataFrame:
    """Share of each edge type among the last week's edges, per direction; ``types`` as of ``edge_types`` if not given."""
    types = edge_types(graph) if types is None else types
    age = last_day(graph.edges) - F.col("ts")
    recent = endpoints(graph.edges, "edge_type", "ts").where(age < days)
    out = F.col("is_out")
    aggs = []
    for label, mine in (("", out), ("in_", ~out)):
        all_mine = F.count_if(mine)
        for t in types:
            share = safe_div(F.count_if(mine & (F.col("edge_type") == t)), all_mine)
            aggs.append(share.alias(f"td_type_ratio_{label}7d_{t}"))
    return per_node(graph, recent.groupBy("node").agg(*aggs))


def risk_neighbours(graph: FraudGraph) -> DataFrame:
    """Sum, max and mean of neighbours' labels, training split only (others count as 0)."""
    known = graph.labelled(F.col("label") != 0).select(
        F.col("node_id").alias("nbr"), F.col("label").cast("bigint").alias("risk")
    )
    # (node, neighbour) counts before the join: parallel edges are summed on the map side.
    pairs = endpoints(graph.edges).groupBy("node", "nbr", "is_out").agg(F.count(F.lit(1)).alias("n"))
    labelled = pairs.join(known, "nbr", "left").withColumn("risk", F.coalesce("risk", F.lit(0)))
    aggs = []
    for label, mine in (("out", F.col("is_out")), ("in", ~F.col("is_out"))):
        weighted = F.sum(F.when(mine, F.col("risk") * F.col("n")).otherwise(0))
        size = F.sum(F.when(mine, F.col("n")).otherwise(0))
        aggs += [
            weighted.alias(f"risk_nei_{label}_sum"),
            F.max(F.when(mine, F.col("risk")).otherwise(0)).alias(f"risk_nei_{label}_max"),
            safe_div(weighted, size).alias(f"risk_nei_{label}_mean"),
        ]
    return per_node(graph, labelled.groupBy("node").agg(*aggs))
