"""Edge-column statistics, time cycles, activity, second hops and fraud links per node."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.functions.scalars import safe_div
from ringsight.graph import EDGE_COLUMNS, FraudGraph
from ringsight.operators.structure import wide_stats
from ringsight.operators.temporal import degree_counts, endpoints, per_node
from ringsight.operators.twohop import HUB_THRESHOLD, two_hop, union_sums

SIDES = {"out": ("src", "dst"), "in": ("dst", "src")}


def degrees_by_count(graph: FraudGraph) -> DataFrame:
    """M1: out- and in-degree with zero fill."""
    return per_node(graph, degree_counts(graph.edges, "fea_outdgree", "fea_indgree"))


def timestamp_gaps(edges: DataFrame, key: str, name: str = "ts_diff") -> DataFrame:
    """M2: days since the previous edge of the same ``key``; equal rows carry a count ``copies``.

    Order inside a key: day, then the whole row. Only the first edge of a (key, day) can have a
    gap, so the window runs over days per key and never over the edges of a hot key.
    """
    rows = edges.groupBy(*EDGE_COLUMNS).agg(F.count(F.lit(1)).alias("copies"))
    order = [c for c in EDGE_COLUMNS if c not in (key, "ts")]
    days = rows.groupBy(key, "ts").agg(F.min(F.struct(*order)).alias("_first"))
    previous = F.lag("ts").over(Window.partitionBy(key).orderBy("ts"))
    days = days.withColumn("_gap", F.col("ts") - previous)
    joined = rows.join(days, [key, "ts"])
    opens = F.struct(*order) == F.col("_first")
    part = lambda gap, n: F.struct(gap.cast("bigint").alias(name), n.alias("copies"))
    zero, one = F.lit(0), F.lit(1).cast("bigint")
    split = F.when(opens, F.array(part(F.col("_gap"), one), part(zero, F.col("copies") - 1))).otherwise(
        F.array(part(zero, F.col("copies")))
    )
    return joined.withColumn("_part", F.explode(split)).select(
        *EDGE_COLUMNS, f"_part.{name}", "_part.copies"
    ).where(F.col("copies") > 0)


def _integer_std(n: Column, s: Column, ss: Column) -> Column:
    """Sample std from the count, sum and sum of squares of integers; exact zero for constants."""
    n, s, ss = n.cast("double"), s.cast("double"), ss.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(n * ss - s * s, F.lit(0.0)) / (n * (n - 1))))


def histogram_stats(counts: DataFrame, stems: dict[str, str]) -> DataFrame:
    """M3 + M4 from ``(node, column, value, n)``: one row per distinct value, however hot the node."""
    v, n = F.col("value"), F.col("n")
    aggs = []
    for column, stem in stems.items():
        mine = (F.col("column") == column) & v.isNotNull()
        size, s = F.sum(F.when(mine, n)), F.sum(F.when(mine, v * n))
        high, low = F.max(F.when(mine, v)), F.min(F.when(mine, v))
        aggs += [
            F.try_divide(s.cast("double"), size).alias(f"{stem}_mean"),
            high.alias(f"{stem}_max"), low.alias(f"{stem}_min"),
            _integer_std(size, s, F.sum(F.when(mine, v * v * n))).alias(f"{stem}_std"),
            F.count_if(mine).alias(f"{stem}_nunique"),
            (high - low).alias(f"{stem}_range"),
            F.max_by(v, F.when(mine, F.struct(n, -v))).alias(f"{stem}_mode"),
        ]
    return counts.groupBy("node").agg(*aggs)


def edge_column_stats(graph: FraudGraph, modes_only: bool = False) -> DataFrame:
    """M3/M4: statistics of edge type and time gap, per source and per target."""
    parts = []
    for side, (key, other) in SIDES.items():
        suffix = "target" if side == "out" else "source"
        gaps = timestamp_gaps(graph.edges, other)
        long = gaps.select(F.col(key).alias("node"), "copies", F.inline(F.array(
            F.struct(F.lit("type").alias("column"), F.col("edge_type").cast("bigint").alias("value")),
            F.struct(F.lit("gap").alias("column"), F.col("ts_diff").alias("value")),
        )))
        counts = long.groupBy("node", "column", "value").agg(F.sum("copies").alias("n"))
        stats = histogram_stats(counts, {
            "type": f"fea_{side}_edge_type", "gap": f"fea_{side}_edge_timestamp_diff_1_{suffix}",
        })
        if modes_only:
            stats = stats.select("node", *[c for c in stats.columns if c.endswith("_mode")])
        parts.append(stats.withColumnRenamed("node", "node_id"))
    return graph.attach(*parts).fillna(0)


def endpoint_feature_stats(graph: FraudGraph, mode: str = "neighbour") -> DataFrame:
    """M5: max, min, mean and sample std of a feature over the edges of a node.

    ``neighbour`` takes the other end's feature; ``as_written`` the node's own (its std is 0),
    which some frozen feature lists were built on.
    """
    names = graph.feature_names
    stats = [("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_samp)]

    def column(side: str, i: int, stat: str) -> str:
        return f"fea_{side}_neighbor_fea_x_{i}_{stat}"

    if mode == "as_written":
        linked = graph.attach(degree_counts(graph.edges, "out", "in").withColumnRenamed("node", "node_id"))
        rows = linked.join(graph.features(), "node_id")
        return rows.select("node_id", *[
            F.when(F.col(side) > 0, F.lit(0.0) if stat == "std" else F.col(name)).otherwise(0.0)
            .alias(column(side, i, stat))
            for side in SIDES for i, name in enumerate(names) for stat, _ in stats
        ])
    near = endpoints(graph.edges).join(graph.features().withColumnRenamed("node_id", "nbr"), "nbr")
    aggs = [
        how(F.when(F.col("is_out") == F.lit(side == "out"), F.col(name))).alias(column(side, i, stat))
        for side in SIDES for i, name in enumerate(names) for stat, how in stats
    ]
    return per_node(graph, wide_stats(graph, near, aggs))


def time_cycles(graph: FraudGraph) -> DataFrame:
    """M6: weekly and monthly cycle of the out-edges and their density over days."""
    def cycle(length: int, how) -> Column:
        return how(2 * math.pi * F.pmod(F.col("ts") - 1, F.lit(length)) / F.lit(float(length)))

    waves = {
        f"enh_time_{trig}_{name}": cycle(length, how)
        for name, length in (("week", 7), ("month", 30)) for trig, how in (("sin", F.sin), ("cos", F.cos))
    }
    stats = graph.edges.groupBy(F.col("src").alias("node")).agg(
        F.count("ts").alias("enh_time_total_count"), F.countDistinct("ts").alias("enh_time_unique_days"),
        *[f(w).alias(f"{n}_{s}") for n, w in waves.items() for s, f in (("mean", F.avg), ("std", F.stddev_samp))],
    )
    density = F.col("enh_time_total_count") / (F.col("enh_time_unique_days") + 1)
    return per_node(graph, stats.withColumn("enh_time_density", density))


def degree_group(graph: FraudGraph) -> DataFrame:
    """M7: total degree, in/(out+1), imbalance and balance ratio."""
    d = per_node(graph, degree_counts(graph.edges, "enh_out_degree", "enh_in_degree"))
    out, inn = F.col("enh_out_degree"), F.col("enh_in_degree")
    return d.withColumns({
        "enh_total_degree": out + inn,
        "enh_degree_ratio": inn / (out + 1),
        "enh_degree_imbalance": F.abs(out - inn),
        "enh_degree_balance_ratio": F.abs(out - inn) / (out + inn + 1),
    })


def hops(edges: DataFrame, side: str, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct first-hop (u, v) and second-hop (v, w) pairs along one direction."""
    key, other = SIDES[side]
    pairs = edges.select(key, other).distinct()
    start = pairs if first is None else first.select(key, other).distinct()
    return (
        start.select(F.col(key).alias("u"), F.col(other).alias("v")),
        pairs.select(F.col(key).alias("v"), F.col(other).alias("w")),
    )


def second_hop_count(graph: FraudGraph, threshold: int = HUB_THRESHOLD) -> DataFrame:
    """M8: distinct nodes two steps away, along and against the edges; exact for hubs too."""
    parts = [
        union_sums(two_hop(*hops(graph.edges, side), threshold), None, ["n"]).select(
            F.col("u").alias("node_id"), F.col("n").alias(f"enh_second_hop_{side}_count")
        )
        for side in SIDES
    ]
    return graph.attach(*parts).fillna(0)


def second_hop_hub(graph: FraudGraph, degree: int = 50) -> DataFrame:
    """M9: M8 for the nodes with more than ``degree`` edges on that side, 0 for all others."""
    parts = []
    for side, (key, _) in SIDES.items():
        hubs = graph.edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > degree).select(key)
        near, far = hops(graph.edges, side, graph.edges.join(hubs, key, "left_semi"))
        union = union_sums(two_hop(near, far, HUB_THRESHOLD), None, ["n"])
        parts.append(union.select(F.col("u").alias("node_id"), F.col("n").alias(f"enh_second_hop_{side}_count")))
    return graph.attach(*parts).fillna(0)


def interaction_pattern(graph: FraudGraph) -> DataFrame:
    """Distinct targets, edges and distinct types per source."""
    # One row per (source, target) and per (source, type): no distinct list per node is built.
    pairs = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    stats = pairs.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("enh_unique_targets"), F.sum("n").alias("enh_total_interactions")
    )
    return per_node(graph, stats.join(type_counts(graph, "enh_unique_edge_types"), "node"))


def type_counts(graph: FraudGraph, name: str) -> DataFrame:
    """Distinct edge types of each source."""
    return graph.edges.select("src", "edge_type").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias(name))


def activity_span(graph: FraudGraph) -> DataFrame:
    """First, last and number of active days, their span and the daily rate."""
    stats = graph.edges.groupBy(F.col("src").alias("node")).agg(
        F.min("ts").alias("enh_first_activity"), F.max("ts").alias("enh_last_activity"),
        F.countDistinct("ts").alias("enh_active_days"), F.count(F.lit(1)).alias("_n"),
    )
    stats = stats.withColumns({
        "enh_activity_span": F.col("enh_last_activity") - F.col("enh_first_activity"),
        "enh_daily_activity_rate": F.col("_n") / (F.col("enh_active_days") + 1),
    }).drop("_n")
    return per_node(graph, stats)


def linked_counts(graph: FraudGraph, marked: Column, names: dict[str, str]) -> DataFrame:
    """Edges to (``out``) and from (``in``) the nodes that satisfy ``marked``."""
    targets = graph.labelled(marked).select(F.col("node_id").alias("nbr"))
    hits = endpoints(graph.edges).join(targets, "nbr", "left_semi")
    return hits.groupBy("node").agg(
        F.count_if("is_out").alias(names["out"]), F.count_if(~F.col("is_out")).alias(names["in"])
    )


def fraud_neighbours(graph: FraudGraph) -> DataFrame:
    """Edges to and from label-1 nodes, and their ratio over the out-edges plus one."""
    links = linked_counts(graph, F.col("label") == 1, {"out": "enh_fraud_neighbors_out", "in": "enh_fraud_neighbors_in"})
    size = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = graph.attach(links.withColumnRenamed("node", "node_id"), size).fillna(0)
    return rows.withColumns({
        f"enh_fraud_neighbor_ratio_{side}": safe_div(F.col(f"enh_fraud_neighbors_{side}"), F.col("_n") + 1)
        for side in SIDES
    }).drop("_n")
