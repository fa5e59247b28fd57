"""Neighbour-type counts, homophily and type risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.scalars import safe_div, total
from ringsight.graph import FraudGraph
from ringsight.operators.temporal import endpoints

# Label -> node type.
LABEL_TYPES = {0: 0, 1: 0, -100: 0, 2: 1, 3: 2}
TYPES = (0, 1, 2)


def node_type(label: Column) -> Column:
    """Foreground labels to type 0, background labels 2 and 3 to types 1 and 2."""
    chain = F.lit(0)
    for value, kind in LABEL_TYPES.items():
        if kind:
            chain = F.when(label == value, F.lit(kind)).otherwise(chain)
    return chain


def node_type_map(graph: FraudGraph) -> DataFrame:
    return graph.nodes.select("node_id", node_type(F.col("label")).alias("node_type"))


def type_crosstab(graph: FraudGraph) -> DataFrame:
    """Y2: neighbours of each type, leaving and entering."""
    kinds = node_type_map(graph).select(F.col("node_id").alias("nbr"), "node_type")
    pairs = endpoints(graph.edges).groupBy("node", "nbr", "is_out").agg(F.count(F.lit(1)).alias("n"))
    typed = pairs.join(kinds, "nbr")
    aggs = [
        F.sum(F.when(mine & (F.col("node_type") == t), F.col("n")).otherwise(0)).alias(f"{side}_type_{t}_cnt")
        for side, mine in (("out", F.col("is_out")), ("in", ~F.col("is_out")))
        for t in TYPES
    ]
    counts = typed.groupBy(F.col("node").alias("node_id")).agg(*aggs)
    names = [c for c in counts.columns if c != "node_id"]
    return node_type_map(graph).join(counts, "node_id", "left").fillna(0, names)


def _ratio(side: str, t: int) -> Column:
    degree = total([F.col(f"{side}_type_{k}_cnt") for k in TYPES])
    return safe_div(F.col(f"{side}_type_{t}_cnt"), degree)


def type_ratios(counts: DataFrame) -> DataFrame:
    """Share of each neighbour type."""
    return counts.withColumns({
        f"{side}_type_{t}_ratio": _ratio(side, t) for side in ("out", "in") for t in TYPES
    })


def main_type(counts: DataFrame) -> DataFrame:
    """Most frequent neighbour type; ties go to the lowest type."""
    def pick(side: str) -> Column:
        cols = [F.col(f"{side}_type_{t}_cnt") for t in TYPES]
        return F.array_position(F.array(*cols), F.greatest(*cols)).cast("int") - 1

    return counts.withColumns({f"{side}_main_type": pick(side) for side in ("out", "in")})


def same_type_ratio(ratios: DataFrame) -> DataFrame:
    """Share of neighbours of the node's own type."""
    def own(side: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{side}_type_{t}_ratio") for t in TYPES]), F.col("node_type") + 1)

    return ratios.withColumns({f"{side}_same_ratio": own(side) for side in ("out", "in")})


def type_risk(ratios: DataFrame) -> DataFrame:
    """Background-type share, its propagation by out-degree, and in/out imbalance."""
    out_degree = total([F.col(f"out_type_{t}_cnt") for t in TYPES])
    return ratios.withColumns({
        "out_risk_ratio": F.col("out_type_2_ratio"),
        "in_risk_ratio": F.col("in_type_2_ratio"),
        "risk_propagation": out_degree * F.col("out_type_2_ratio"),
        "type_imbalance": total(
            [F.abs(F.col(f"out_type_{t}_ratio") - F.col(f"in_type_{t}_ratio")) for t in TYPES]
        ),
    })


def type_features(graph: FraudGraph) -> DataFrame:
    return type_risk(same_type_ratio(main_type(type_ratios(type_crosstab(graph)))))
