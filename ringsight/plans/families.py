"""Feature families by name, and the end-to-end run: build, write, join, select."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ringsight.functions.scalars import finalize
from ringsight.graph import FraudGraph
from ringsight.operators import (
    anomaly, business, cluster, columns, cross, derived, embed, enhanced, hops, mixed, neighbours, nodetypes, nulls, spectral,
    structure, temporal,
)
from ringsight.operators.splits import select_features
from ringsight.session import cut_lineage
from ringsight.sources.sinks import concat_features, write_features

Family = Callable[[FraudGraph], DataFrame]


def node_features(graph: FraudGraph) -> DataFrame:
    """The node's own features under the names the cross features and frozen lists use."""
    names = graph.feature_names
    return graph.features().toDF("node_id", *[f"fea_x_{i}" for i in range(len(names))])


def _side_by_side(*families: Family) -> Family:
    return lambda graph: graph.attach(*[family(graph) for family in families])


def _hop(name: str) -> Family:
    return lambda graph: hops.hop_features(graph, name)


def _on_matrix(*ops: Callable[[DataFrame], DataFrame]) -> Family:
    return lambda graph: graph.attach(*[op(graph.features()) for op in ops])


def _on_scaled(*ops: Callable[[DataFrame, list[str]], DataFrame]) -> Family:
    def run(graph: FraudGraph) -> DataFrame:
        scaled = spectral.scaled(graph)
        return graph.attach(*[op(scaled.features(), scaled.feature_names) for op in ops])

    return run


def _on_features(*ops: Callable[[DataFrame, list[str]], DataFrame]) -> Family:
    """Operators on the node's own features; of columns that several give, the first copy stays."""
    def run(graph: FraudGraph) -> DataFrame:
        rows, names = graph.features(), graph.feature_names
        return concat_features([graph.ids(), *[op(rows, names) for op in ops]], keep_first=True)

    return run


FAMILIES: dict[str, Family] = {
    "node": node_features,
    **{name: _hop(name) for name in hops.BUILDERS},
    "degree": _side_by_side(temporal.degree_features, temporal.temporal_features),
    "windows": _side_by_side(temporal.time_window_counts, temporal.type_window_counts, temporal.type_ratio_7d),
    "risk": temporal.risk_neighbours,
    "nulls": _side_by_side(
        nulls.null_pattern, nulls.neighbour_null, nulls.recent_neighbour_null, nulls.null_risk, nulls.null_interaction,
        nulls.null_sequence, nulls.isnull_flags,
    ),
    "node_types": nodetypes.type_features,
    "edge_stats": _side_by_side(enhanced.degrees_by_count, enhanced.edge_column_stats, enhanced.endpoint_feature_stats),
    "enhanced": _side_by_side(
        enhanced.time_cycles, enhanced.degree_group, enhanced.second_hop_count, enhanced.interaction_pattern,
        enhanced.activity_span, enhanced.fraud_neighbours,
    ),
    "business": _side_by_side(
        business.degree_anomaly, business.time_concentration, business.diversity, business.second_hop_fraud,
        business.time_gap_stats, business.triangle_count, business.background_links, business.risk_accumulation,
    ),
    "base_columns": _on_matrix(
        columns.log_shift, columns.sqrt_clip, columns.decile_bucket, columns.zscore, columns.minmax, columns.interactions,
        columns.poly2, columns.rank_pct, columns.kbins,
    ),
    "structure": _side_by_side(
        structure.degrees, structure.pagerank, structure.clustering_coefficient, structure.second_order_walks,
        structure.neighbour_degree_stats, structure.constraint,
    ),
    "neighbours": _side_by_side(
        neighbours.one_hop, neighbours.two_hop_features, neighbours.degree_correlation, neighbours.neighbour_distribution,
        neighbours.in_out_difference,
    ),
    "neighbour_bins": _side_by_side(neighbours.bin_one_hop, neighbours.bin_distribution, neighbours.bin_cross_feature),
    "riskstat": neighbours.riskstat,
    "spectral": _side_by_side(
        spectral.approximate_eigenvectors, spectral.laplacian_smoothness, spectral.neighbour_smoothness_diff,
        spectral.degree_pca, spectral.chebyshev, spectral.degree_gap, spectral.spectral_response,
    ),
    "embedding": _side_by_side(
        embed.adjacency_svd, spectral.fast_laplacian_approx, embed.feature_embedding, embed.degree_embedding,
        embed.neighbour_embedding, embed.gcn_embedding, embed.random_walk_stats,
    ),
    "clusters": lambda graph: cluster.kmeans_family(graph, spectral.scaled(graph)),
    "anomaly": lambda graph: graph.attach(
        _on_scaled(anomaly.isolation_forest, anomaly.local_outlier_factor, anomaly.mahalanobis)(graph),
        anomaly.column_scores(graph), anomaly.neighbour_feature_diff(graph),
    ),
    "mixed": _on_scaled(
        mixed.polynomial, mixed.pca_components, mixed.ica_components, mixed.random_projection, mixed.selection_scores,
        mixed.bootstrap_stability, mixed.pseudo_importance, mixed.row_stats, mixed.complexity,
    ),
    "moments": _on_features(anomaly.column_moments),
    "combined": lambda graph: anomaly.combined_anomaly(anomaly.column_scores(graph)),
    "diffusion": lambda graph: _side_by_side(spectral.diffusion, spectral.attention, spectral.graph_smoothness)(spectral.scaled(graph)),
    "wavelets": _side_by_side(spectral.beta_wavelet),
    "filters": _side_by_side(spectral.bernstein_basis),
    "derived_pairs": _on_features(derived.pair_derived),
    "derived_anomaly": _on_features(derived.anomaly_derived),
    "derived_shape": _on_features(derived.embedding_shape, derived.embedding_model),
    "derived_stats": _on_features(derived.stats_of_stats),
    "derived_interactions": _on_features(derived.interaction_derived),
    "derived_bins": _on_features(derived.binning_derived),
    "derived_order": _on_features(derived.rolling, derived.lags, derived.local_trend),
    "derived_importance": _on_features(derived.importance_derived),
}

MANIFEST = "name string, inputs string, columns string, rows bigint"


def stored(graph: FraudGraph) -> FraudGraph:
    """The graph read back from the checkpoint folder, so that families do not redo its source query."""
    return FraudGraph(cut_lineage(graph.nodes), cut_lineage(graph.edges), graph.label_splits)


def fingerprint(graph: FraudGraph) -> str:
    """Names the rows of a graph whatever their order: counts and two sums of hashes per table."""
    parts = [f"labels of {graph.label_splits}"]
    for table in (graph.nodes, graph.edges):
        names = sorted(table.columns)
        each = F.xxhash64(*[F.col(c) for c in names]).cast("decimal(20,0)")
        other = F.xxhash64(F.lit(1), *[F.col(c) for c in names]).cast("decimal(20,0)")
        row = table.agg(F.count(F.lit(1)), F.sum(each), F.sum(other)).first()
        parts.append(f"{','.join(names)} {row[0]} {row[1]} {row[2]}")
    return "; ".join(parts)


def _finished(spark: SparkSession, out: str, name: str, inputs: str) -> DataFrame | None:
    """The family as an earlier run wrote it, if its manifest names the same inputs and the rows and columns are there."""
    try:
        entry = spark.read.schema(MANIFEST).json(f"{out}/manifest/{name}").first()
        family = spark.read.parquet(f"{out}/{name}")
    except AnalysisException:  # not written
        return None
    same = entry is not None and entry.inputs == inputs and entry.columns == family.schema.simpleString()
    return family if same and entry.rows == family.count() else None


def built_family(graph: FraudGraph, name: str, out: str, inputs: str) -> DataFrame:
    """Read a finished family back, or build it, write it, and then its manifest: a run cut off before leaves none."""
    spark = graph.nodes.sparkSession
    found = _finished(spark, out, name, inputs)
    if found is not None:
        return found
    write_features(finalize(FAMILIES[name](graph)), f"{out}/{name}")
    family = spark.read.parquet(f"{out}/{name}")
    entry = spark.createDataFrame([(name, inputs, family.schema.simpleString(), family.count())], MANIFEST)
    entry.coalesce(1).write.mode("overwrite").json(f"{out}/manifest/{name}")
    return family


def build_features(
    graph: FraudGraph, families: Iterable[str], out: str | None = None, keep: list[str] | None = None,
    cross_family: str | None = None,
) -> DataFrame:
    """Build families, join them on the node id, add cross features and keep the listed columns.

    With ``out`` every family is first written as its own Parquet folder with a manifest (inputs, columns,
    rows), and the join reads only the kept columns. A later run over the same graph into the same
    folder takes the families that are finished and builds the others; other rows are built anew.
    """
    graph = stored(graph)
    if out:
        inputs = fingerprint(graph)
        parts = [built_family(graph, name, out, inputs) for name in families]
    else:
        parts = [finalize(FAMILIES[name](graph)) for name in families]
    table = concat_features([graph.ids(), *parts], keep_first=True)
    if cross_family:
        table = cross.cross_features(table, cross_family)
    if keep is not None:
        table, _ = select_features(table, keep)
    return finalize(table)
