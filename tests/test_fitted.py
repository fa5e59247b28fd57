"""Iterative and fitted operators against numpy, up to sign."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.functions.linear import correlation, pca, project
from ringsight.operators import anomaly, cluster, embed, hops, mixed, model, spectral
from ringsight.plans.families import FAMILIES, build_features


def adjacency(nodes, edges):
    a = np.zeros((len(nodes), len(nodes)))
    for _, s, d, _, _ in edges:
        a[s, d] = a[d, s] = 1
    return a


def matrix(df, columns=None):
    rows = df.orderBy("node_id").toPandas()
    return rows[columns or [c for c in rows.columns if c != "node_id"]].to_numpy(dtype=float)


def test_laplacian_eigenvectors(random_graph):
    graph, nodes, edges = random_graph
    a = adjacency(nodes, edges)
    d = 1 / np.sqrt(a.sum(1) + 1e-8)
    lap = np.eye(len(a)) - d[:, None] * a * d[None, :]
    got = matrix(spectral.laplacian_eigenvectors(graph, k=2, iterations=12, extra=8))
    # Invariants: unit length, orthogonal, and the smallest non-trivial Rayleigh quotients.
    np.testing.assert_allclose(got.T @ got, np.eye(2), atol=1e-6)
    want = np.sort(np.linalg.eigvalsh(lap))[1:3]
    np.testing.assert_allclose(np.sort(np.diag(got.T @ lap @ got)), want, atol=2e-2)


def test_adjacency_svd(random_graph):
    graph, nodes, edges = random_graph
    got = matrix(embed.adjacency_svd(graph, k=3))
    want = np.linalg.svd(adjacency(nodes, edges), compute_uv=False)[:3]
    np.testing.assert_allclose(np.linalg.norm(got, axis=0), want, rtol=1e-2)


def test_every_product_and_family_is_written_before_the_next(random_graph, monkeypatch):
    graph, steps = random_graph[0], []
    noted = lambda name, f: lambda *a, **k: steps.append(name) or f(*a, **k)
    for module in (spectral, hops):
        monkeypatch.setattr(module, "cut_lineage", noted("written", module.cut_lineage))
    monkeypatch.setattr(spectral, "with_propagated", noted("made", spectral.with_propagated))
    links = spectral.symmetric_links(graph.neighbours())
    spectral.leading_subspace(links, graph.ids(), 3, 2, 1.0)
    assert "made made" not in " ".join(steps) and steps.count("made") == 4
    steps.clear()
    monkeypatch.setattr(hops, "neighbour_stats", noted("made", hops.neighbour_stats))
    hops.all_hop_features(graph, 3, names=("directed_1hop_out", "directed_1hop_in"))
    assert steps.count("made") == 2 and "made made" not in " ".join(steps) and steps[-1] == "written"


def test_unused_shuffles_are_dropped_now_and_then(spark, monkeypatch):
    from types import SimpleNamespace

    from ringsight import session

    calls = []
    fake = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(1)))))
    monkeypatch.setattr(session, "_collected", [time.monotonic() - 2 * session.PAUSE])
    session.drop_unused(fake)
    session.drop_unused(fake)
    assert len(calls) == 1
    asked = []
    monkeypatch.setattr(session, "drop_unused", asked.append)
    assert session.cut_lineage(spark.range(3)).count() == 3 and len(asked) == 1


def test_largest_rows_put_only_those_around_the_cut_in_order(spark, monkeypatch):
    rng = np.random.RandomState(9)
    data = [(i, int(rng.randint(0, 50)), float(v)) for i, v in enumerate(rng.randint(0, 400, 3000) / 8)]
    frame = spark.createDataFrame(data, "start long, node long, mass double")
    ordered, whole = sorted(data, key=lambda r: (-r[2], r[0], r[1])), spectral.with_position
    sizes = []
    monkeypatch.setattr(spectral, "with_position", lambda rows, *a: sizes.append(rows.count()) or whole(rows, *a))
    for n in (0, 1, 700, 2999, 3000, 9000):
        got = spectral._largest(frame, "mass", ["start", "node"], n).collect()
        assert sorted(map(tuple, got)) == sorted(ordered[:n])
    assert max(sizes) < 100


def test_ppr_without_pruning_is_the_truncated_series(random_graph):
    graph, nodes, edges = random_graph
    a = adjacency(nodes, edges)
    np.fill_diagonal(a, 1)
    t = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    series = sum(0.05 * 0.95**k * np.linalg.matrix_power(t, k) for k in range(4))
    got = spectral.ppr_augment(graph, mean_degree=len(nodes), steps=3, prune=0.0).toPandas()
    want = series / series.sum(axis=0, keepdims=True)
    for src, dst, w in got.itertuples(index=False):
        assert w == pytest.approx(want[src, dst], abs=1e-9)
    assert len(got) == (series > 0).sum()


def test_pca_correlation_and_projection(random_graph):
    graph, nodes, _ = random_graph
    x = np.array([n[1:5] for n in nodes])
    np.testing.assert_allclose(correlation(graph.nodes, graph.feature_names), np.corrcoef(x.T), atol=1e-9)
    got = matrix(pca(graph.features(), graph.feature_names, 2, "p"))
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(centred @ vt[:2].T), atol=1e-8)
    wide = np.random.RandomState(0).normal(size=(4, 60))
    np.testing.assert_allclose(matrix(project(graph.features(), graph.feature_names, wide, "w")), x @ wide, atol=1e-9)


def test_mahalanobis(random_graph):
    graph, nodes, _ = random_graph
    x = np.array([n[1:5] for n in nodes])
    inverse = np.linalg.pinv(np.cov(x.T) + 1e-6 * np.eye(4))
    away = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), inverse, x - x.mean(0)))
    got = matrix(anomaly.mahalanobis(graph.features(), graph.feature_names)).ravel()
    np.testing.assert_allclose(got, away / away.max(), rtol=1e-6)


@pytest.fixture(scope="module")
def with_outlier(spark):
    rng = np.random.RandomState(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)] + [(300, 9.0, -9.0, 9.0)]
    return spark.createDataFrame(rows, "node_id long, a double, b double, c double")


def test_isolation_forest_and_lof_rank_the_outlier_first(with_outlier):
    names = ["a", "b", "c"]
    for op, score in ((anomaly.isolation_forest, "isolation_forest_score"), (anomaly.local_outlier_factor, "lof_score")):
        scored = op(with_outlier, names)
        assert scored.orderBy(F.desc(score)).first()["node_id"] == 300
        low, high = scored.agg(F.min(score), F.max(score)).first()
        assert low == pytest.approx(0.0) and high == pytest.approx(1.0, abs=1e-6)


def test_lof_against_brute_force(with_outlier):
    names, k = ["a", "b", "c"], 10
    rows = with_outlier.orderBy("node_id").toPandas()
    x = rows[names].to_numpy()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    reach = np.take_along_axis(d, near, 1).max(1)
    dense = 1 / (np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(1) + 1e-10)
    raw = dense[near].mean(1) / dense
    want = (raw - raw.min()) / (raw.max() - raw.min() + 1e-8)
    got = matrix(anomaly.local_outlier_factor(with_outlier, names, k=k)).ravel()
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_ica_separates_independent_sources(spark):
    rng = np.random.RandomState(0)
    s = np.column_stack([rng.uniform(-1, 1, 800), np.sign(rng.normal(size=800)) * rng.exponential(size=800)])
    x = s @ np.array([[1.0, 0.5], [0.4, 1.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node_id long, a double, b double")
    got = matrix(mixed.ica_components(df, ["a", "b"], k=2))
    match = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert match.max(axis=1).min() > 0.97


def test_nearest_centres(random_graph):
    graph, nodes, _ = random_graph
    x = np.array([n[1:5] for n in nodes])
    centres = x[:3]
    got = cluster.nearest_centres(graph.features(), graph.feature_names, centres, "k").orderBy("node_id").toPandas()
    away = np.sort(np.linalg.norm(x[:, None] - centres[None], axis=2), axis=1)
    np.testing.assert_allclose(got[["k_min_dist", "k_second_min_dist"]].to_numpy(), away[:, :2], atol=1e-9)


def test_default_types_are_the_most_frequent(random_graph):
    graph, _, _ = random_graph
    got = hops.hop_features(graph, "directed_1hop_out")
    made = {int(c.split("_type_")[1].split("_")[0]) for c in got.columns if "_type_" in c}
    top = {r["edge_type"] for r in hops.top_types(hops.directed_1hop_out(hops.Samples(graph.edges), graph)).collect()}
    assert made == top and got.count() == graph.nodes.count()


def test_train_save_load_predict(spark, tmp_path):
    rng = np.random.RandomState(2)
    rows = [(i, int(v[0] + 0.3 * rng.normal() > 0.5), *map(float, v)) for i, v in enumerate(rng.normal(size=(400, 3)))]
    table = spark.createDataFrame(rows, "node_id long, label int, a double, b double, c double")
    ensemble, held = model.train_cv(table, ["a", "b", "c"], model.BoostSettings(iterations=10, folds=3, learning_rate=0.3))
    assert held.count() == 400 and held.select("node_id").distinct().count() == 400
    summary = model.cv_metrics(held).first()
    assert summary["auc_mean"] > 0.85 and summary["folds"] == 3
    assert model.feature_importance(ensemble).first()["feature"] == "a"
    ensemble.save(str(tmp_path / "model"))
    again = model.Ensemble.load(str(tmp_path / "model"))
    first = model.ensemble_predict(ensemble, table).orderBy("node_id").toPandas()
    second = model.ensemble_predict(again, table).orderBy("node_id").toPandas()
    np.testing.assert_allclose(first["p"], second["p"])
    np.testing.assert_allclose(first["p"], first[["p_fold_1", "p_fold_2", "p_fold_3"]].mean(axis=1))


def test_families_keep_one_finite_row_per_node(spark, tmp_path):
    from ringsight.sources.warehouse import order_graph

    graph = order_graph(spark, "/root/testdata/sf0.001")
    keep = ["out_degree", "last_active_out", "active_window_span", "undirected_1hop_timestamp_min", "absent"]
    table = build_features(graph, ["node", "degree", "risk", "undirected_1hop"], str(tmp_path), keep, "dgraph")
    assert table.columns == ["node_id", *keep[:-1]]
    rows = table.toPandas()
    assert len(rows) == graph.nodes.count() == rows["node_id"].nunique()
    assert np.isfinite(rows.to_numpy(dtype=float)).all()
    np.testing.assert_allclose(rows["active_window_span"], rows["last_active_out"] - rows["undirected_1hop_timestamp_min"])
    assert set(FAMILIES) >= {"degree", "undirected_1hop", "spectral", "mixed"}


def test_supervised_bins_find_rare_fraud(spark):
    """1 % fraud below a value and 20 % above it gives a cut there; a constant column gives one bin."""
    from pyspark.sql import functions as F

    from ringsight.operators.columns import best_cuts, supervised_bins

    rows = [(i, float(i % 100), 1.0, int(i % 500 < 5 if i % 100 < 50 else i % 5 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "node_id long, a double, b double, fraud int")
    coded = supervised_bins(df, "fraud", ["a", "b"], F.lit(True))
    assert {"a_bin_1", "b_bin_0"} <= set(coded.columns) and "b_bin_1" not in coded.columns
    first = coded.where("a <= 49").select([c for c in coded.columns if c.startswith("a_bin")]).distinct().collect()
    later = coded.where("a > 49").select([c for c in coded.columns if c.startswith("a_bin")]).distinct().collect()
    assert not set(first) & set(later)
    # The first cut has the largest gain of all.
    assert best_cuts([1.0, 2.0, 3.0, 4.0], [10, 20, 30, 40], [0, 0, 10, 20], 2, 0.01) == [2.0]


def test_cluster_density_uses_all_points(spark):
    import itertools
    import math

    from ringsight.operators.cluster import cluster_density

    points = [(i, float(i * i % 17), float(i % 5)) for i in range(1500)]
    df = spark.createDataFrame(points, "node_id long, x double, y double")
    got = cluster_density(df, ["x", "y"], df.selectExpr("node_id", "0 as cluster"), "t").first()["t_cluster_density"]
    square = [(a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 for a, b in itertools.combinations(points, 2)]
    assert abs(got - math.sqrt(sum(square) / len(square))) < 1e-9


def test_repeated_columns_get_free_names(spark):
    from ringsight.sources.sinks import concat_features

    df = spark.createDataFrame([(1, 1, 2)], "node_id long, f1 int, f1_1 int")
    out = concat_features([df.select("node_id", "f1"), df.select("node_id", "f1"), df.select("node_id", "f1_1")])
    assert len(set(out.columns)) == 4 and out.columns[:2] == ["node_id", "f1"]
