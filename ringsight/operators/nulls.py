"""Missing-value patterns of a node, of its neighbours, and along the feature order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.scalars import is_missing, mean_of, one_row, pop_std_of, total
from ringsight.graph import FraudGraph
from ringsight.operators.temporal import degree_counts, endpoints, last_day, per_node


def null_flags(graph: FraudGraph, null_value: float = -1.0) -> list[Column]:
    return [is_missing(F.col(c), null_value).cast("double") for c in graph.feature_names]


def null_ratio(graph: FraudGraph, null_value: float = -1.0) -> Column:
    return mean_of(null_flags(graph, null_value))


def null_pattern(graph: FraudGraph, null_value: float = -1.0, front: int = 8) -> DataFrame:
    """Count and share of missing features, key flags, front/back shares, mean and std."""
    flags = null_flags(graph, null_value)
    share = mean_of(flags)
    return graph.nodes.select(
        "node_id",
        total(flags).alias("null_count"),
        share.alias("null_ratio"),
        *[flag.alias(f"f{i}_is_null") for i, flag in enumerate(flags[:5])],
        mean_of(flags[:front]).alias("front_feature_null_ratio"),
        (mean_of(flags[front:]) if flags[front:] else F.lit(0.0)).alias("back_feature_null_ratio"),
        share.alias("null_pattern_mean"),
        F.sqrt(share * (1 - share)).alias("null_pattern_std"),
    )


def _neighbour_ratio(graph: FraudGraph, edges: DataFrame, null_value: float) -> DataFrame:
    ratio = graph.nodes.select(F.col("node_id").alias("nbr"), null_ratio(graph, null_value).alias("ratio"))
    pairs = endpoints(edges).groupBy("node", "nbr", "is_out").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(ratio, "nbr")


def _weighted_mean(mine: Column, value: Column) -> Column:
    size = F.sum(F.when(mine, F.col("n")).otherwise(0))
    return F.try_divide(F.sum(F.when(mine, value * F.col("n")).otherwise(0.0)), size)


def neighbour_null(graph: FraudGraph, null_value: float = -1.0, high: float = 0.5) -> DataFrame:
    """Mean, max and share above one half of the neighbours' missing ratio."""
    rows = _neighbour_ratio(graph, graph.edges, null_value)
    ratio, aggs = F.col("ratio"), []
    for label, mine in (("out", F.col("is_out")), ("in", ~F.col("is_out"))):
        aggs += [
            _weighted_mean(mine, ratio).alias(f"{label}_nei_null_ratio_mean"),
            F.max(F.when(mine, ratio)).alias(f"{label}_nei_null_ratio_max"),
            _weighted_mean(mine, (ratio > high).cast("double")).alias(f"{label}_nei_high_null_ratio"),
        ]
    return per_node(graph, rows.groupBy("node").agg(*aggs))


def recent_neighbour_null(graph: FraudGraph, window: int = 30, null_value: float = -1.0) -> DataFrame:
    """Mean missing ratio of the neighbours met in the last ``window`` days."""
    recent = graph.edges.where(last_day(graph.edges) - F.col("ts") < window)
    rows = _neighbour_ratio(graph, recent, null_value)
    aggs = [
        _weighted_mean(mine, F.col("ratio")).alias(f"{label}_recent_{window}d_null_mean")
        for label, mine in (("out", F.col("is_out")), ("in", ~F.col("is_out")))
    ]
    return per_node(graph, rows.groupBy("node").agg(*aggs))


def null_risk(graph: FraudGraph, null_value: float = -1.0, degree_cap: float = 1000.0) -> DataFrame:
    """U4: missing ratio, key-feature flag, degree-weighted ratio and z-score of the ratio."""
    flags = null_flags(graph, null_value)
    base = graph.nodes.select(
        "node_id", mean_of(flags).alias("null_risk_basic"),
        F.greatest(*flags[:5]).alias("key_feature_null_risk"),
    )
    degrees = degree_counts(graph.edges, "o", "i").select(
        F.col("node").alias("node_id"), (F.col("o") + F.col("i")).alias("_degree")
    )
    ratio = F.col("null_risk_basic")
    spread = one_row(base.agg(F.avg(ratio).alias("mean"), F.stddev_pop(ratio).alias("std")))
    weight = F.least(F.coalesce("_degree", F.lit(0)) / F.lit(degree_cap), F.lit(1.0))
    return base.join(degrees, "node_id", "left").select(
        *base.columns,
        (ratio * weight).alias("degree_weighted_null_risk"),
        F.when(spread["std"] > 0, F.try_divide(ratio - spread["mean"], spread["std"]))
        .otherwise(0.0).alias("null_anomaly_score"),
    )


def null_interaction(graph: FraudGraph, null_value: float = -1.0, cuts: tuple[int, int] = (6, 12)) -> DataFrame:
    """Joint missing flags of the first three features and spread over three feature groups."""
    flags = null_flags(graph, null_value)
    a, b, c = flags[:3]
    thirds = [flags[: cuts[0]], flags[cuts[0] : cuts[1]], flags[cuts[1] :]]
    groups = [mean_of(g) for g in thirds if g]
    return graph.nodes.select(
        "node_id",
        (a * b).alias("f0_f1_null_both"),
        (a * c).alias("f0_f2_null_both"),
        (b * c).alias("f1_f2_null_both"),
        (a * b * c).alias("f0_f1_f2_null_all"),
        pop_std_of(groups).alias("null_group_diversity"),
    )


def null_sequence(graph: FraudGraph, null_value: float = -1.0) -> DataFrame:
    """Runs, changes, positions and densities of missing flags along the feature order."""
    flags = null_flags(graph, null_value)
    n, third = len(flags), len(flags) // 3
    # The flags as one 0/1 text; its runs of 1 are the missing streaks.
    text = F.concat(*[f.cast("int").cast("string") for f in flags])
    streaks = F.filter(F.split("bits", "0+"), lambda s: F.length(s) > 0)
    lengths = F.transform("streaks", lambda s: F.length(s))
    count = F.size("streaks")
    changes = total([F.abs(b - a) for a, b in zip(flags, flags[1:])])

    def density(part: list[Column]) -> Column:
        return mean_of(part) if part else F.lit(0.0)

    first = F.instr("bits", "1")
    last = F.instr(F.reverse("bits"), "1")
    rows = graph.nodes.withColumn("bits", text).withColumn("streaks", streaks)
    return rows.select(
        "node_id",
        count.alias("seq_streak_count"),
        F.coalesce(F.array_max(lengths), F.lit(0)).alias("seq_max_streak"),
        F.when(count > 0, total(flags) / count).otherwise(0.0).alias("seq_avg_streak"),
        changes.alias("seq_changes"),
        (changes / F.lit(float(n - 1))).alias("seq_volatility"),
        F.when(first > 0, (first - 1) / F.lit(float(n))).otherwise(-1.0).alias("seq_first_missing_pos"),
        F.when(last > 0, (n - last) / F.lit(float(n))).otherwise(-1.0).alias("seq_last_missing_pos"),
        density(flags[:third]).alias("seq_density_front"),
        density(flags[third : 2 * third]).alias("seq_density_middle"),
        density(flags[2 * third :]).alias("seq_density_back"),
    )


def isnull_flags(graph: FraudGraph, null_value: float = -1.0) -> DataFrame:
    """One flag per feature, their sum and ratio."""
    flags = null_flags(graph, null_value)
    return graph.nodes.select(
        "node_id",
        *[f.alias(f"isnull_fea_x_{i}") for i, f in enumerate(flags)],
        total(flags).alias("isnull_fea_sum"),
        mean_of(flags).alias("isnull_fea_ratio"),
    )
