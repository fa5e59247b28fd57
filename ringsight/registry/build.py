"""The end-to-end build: families written and taken up again, joined on the node."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.plans.families import build_features
from ringsight.registry import features
from ringsight.registry.base import NODES, Registry, settled
from ringsight.registry.tables import scratch
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def resumed_build(spark, folder):
    """A first run makes two families, a second one takes them and adds the others."""
    graph, out = order_graph(spark, folder), scratch(spark, "families")
    build_features(graph, ["node", "degree"], out)
    table = build_features(graph, ["node", "degree", "windows", "risk"], out)
    # Families are stored as floats: neighbouring floats of one ratio are the same to five decimals.
    return table.select("node_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in table.columns if c != "node_id"])


OWN = settled([NODES], "select node_id, " + ", ".join(f"cast(f{i} as float) as fea_x_{i}" for i in range(10)) + " from nodes")
PARTS = [features.ORACLES[q] for q in (
    "d3_degree_features", "d4_temporal_features", "d1_time_window_counts", "d2_type_window_counts", "d5_type_ratio_7d", "d6_risk_neighbours",
)]
R.add("e2e_resumed_build", resumed_build, f"select node_id, round(columns(* exclude (node_id))::double, 5) from ({OWN})" + "".join(f" join ({sql}) using (node_id)" for sql in PARTS))
