"""Exact two-hop statistics, all types, builds that resume, and card windows of a hot card, next to plain code."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.operators import neighbours, temporal, transactions
from ringsight.plans.families import build_features, fingerprint


def two_hops(nodes, edges):
    near = {n[0]: set() for n in nodes}
    for _, a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near, {u: set().union(*[near[v] for v in vs]) if vs else set() for u, vs in near.items()}


@pytest.mark.parametrize("threshold", [3, 5000])
def test_two_hop_statistics(random_graph, threshold):
    graph, nodes, edges = random_graph
    x = {n[0]: np.array(n[1:5]) for n in nodes}
    near, far = two_hops(nodes, edges)
    got = {r.node_id: r for r in neighbours.two_hop_features(graph, threshold=threshold).collect()}
    beyond = {r.node_id: r for r in neighbours.exclusive_two_hop_features(graph, threshold=threshold).collect()}
    assert set(got) == set(beyond) == set(x)
    for u in x:
        rows = np.array([x[w] for w in far[u]]) if far[u] else np.zeros((1, 4))
        want = [rows.mean(0), rows.max(0), rows.min(0), rows.std(0), rows.sum(0)]
        for i in range(4):
            mine = [got[u][f"orig_n2_{s}_feat{i}"] for s in ("mean", "max", "min", "std", "sum")]
            np.testing.assert_allclose(mine, [w[i] for w in want], atol=1e-9)
            rest = [x[w][i] for w in far[u] - near[u] - {u}]
            np.testing.assert_allclose(beyond[u][f"orig_n2_mean_feat{i}"], np.mean(rest) if rest else 0.0, atol=1e-9)


def test_sampled_forms_need_both_numbers(random_graph):
    with pytest.raises(ValueError):
        neighbours.exclusive_two_hop_features(random_graph[0], k1=5)


def test_edge_types_beyond_the_published_ones(spark, random_graph):
    graph, _, edges = random_graph
    odd = replace(graph, edges=graph.edges.withColumn("edge_type", F.when(F.col("edge_id") == 0, 77).otherwise(F.col("edge_type"))))
    columns = temporal.type_window_counts(odd).columns
    assert "td_type77_7" in columns and "td_type10_7" in columns
    assert temporal.type_window_counts(odd, windows=(10**6,)).agg(F.sum("td_type77_1000000")).first()[0] == 1


def test_build_resumes_from_its_manifest(spark, random_graph, tmp_path):
    graph, out = random_graph[0], str(tmp_path / "out")
    stamp = lambda name: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out" / name).iterdir())
    first = build_features(graph, ["node", "degree"], out)
    columns, rows, before = first.columns, first.count(), stamp("degree")
    again = build_features(graph, ["node", "degree", "risk"], out)
    assert stamp("degree") == before and again.count() == rows and again.columns[: len(columns)] == columns
    # A family whose manifest is missing, or whose graph has other rows, is built anew.
    for p in (tmp_path / "out" / "manifest" / "degree").iterdir():
        p.rename(tmp_path / p.name)
    build_features(graph, ["degree"], out)
    second = stamp("degree")
    assert second != before
    fewer = replace(graph, edges=graph.edges.where("edge_id > 3"))
    assert fingerprint(fewer) != fingerprint(graph) == fingerprint(replace(graph, edges=graph.edges.repartition(3)))
    build_features(fewer, ["degree"], out)
    assert stamp("degree") != second


def test_windows_of_a_hot_card(spark):
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(300):
        card = 1 if rng.random() < 0.8 else rng.randint(2, 5)
        at = start + dt.timedelta(seconds=rng.choice([0, 10, 11, 60, 3600, 10**6, 4 * 10**7]) * rng.randint(0, 3))
        rows.append((i, card, rng.randint(0, 3), at, round(rng.uniform(1, 900), 4), round(rng.uniform(1, 900), 4), 0))
    df = spark.createDataFrame(rows, "row_id long, card_id long, loc_cty int, time_stamp timestamp, amt_grant double, amt_purch double, is_fraud int")
    spans = [10, 3600, 10**8]
    got = {(r.row_id, r.county, r.span): r for r in transactions.card_location_windows(df.repartition(6), spans).collect()}
    places = {(r[1], r[2]) for r in rows}
    want = 0
    for i, card, _, at, *_ in rows:
        for county in [c for k, c in places if k == card]:
            for span in spans:
                mine = [r for r in rows if r[1] == card and r[2] == county and 0 <= (at - r[3]).total_seconds() <= span]
                r, want = got[i, county, span], want + 1
                assert r.num == len(mine)
                np.testing.assert_allclose([r.total_grant, r.total_purch], [sum(m[4] for m in mine), sum(m[5] for m in mine)], atol=1e-6)
                np.testing.assert_allclose(r.avg_grant, np.mean([m[4] for m in mine]) if mine else 0.0, atol=1e-6)
    assert len(got) == want
