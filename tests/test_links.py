"""Weighted links, weighted paths and bottom-k samples in blocks, against plain Python."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.graph import FraudGraph
from ringsight.operators import blocks, links, neighbours, samples, spectral, structure
from ringsight.operators.temporal import endpoints

IDS = [None, -5, 2**40, 2**62, *range(20)]


def draw(rng, n):
    return [(IDS[a], IDS[b]) for a, b in rng.randint(0, len(IDS), size=(n, 2))]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("parts, held", [(1, False), (2, True), (4, False)])
def test_link_sums(spark, parts, held):
    rng = np.random.RandomState(5)
    rows = [(a, b, float(w)) for (a, b), w in zip(draw(rng, 200), rng.randint(1, 9, 200) / 8)]
    values = [(i, float(k) if k % 3 else None, None if k < 18 else 1.0) for k, i in enumerate(IDS[:-3])] + [(7, 2.5, None)]
    packed = links.pack_links(spark.createDataFrame(rows, "node long, nbr long, weight double"), parts)
    packed = packed.held() if held else packed
    signals = spark.createDataFrame(values, "node_id long, x double, y double")
    sums = links.link_sums(packed, signals, ["x", "y"])
    got = {r.node_id: (r.x, r.y) for r in sums.collect()}
    if held:
        plan = sums._jdf.queryExecution().executedPlan().toString()
        # The links stay where they are.
        assert "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[1].split("InMemoryRelation")[0]
        packed.drop()
    want = defaultdict(lambda: [[], []])
    for a, b, w in rows:
        for i, *xs in values:
            if b is not None and i == b:
                for side, x in zip(want[a], xs):
                    side.append(None if x is None else w * x)
    assert set(got) == set(want)
    for a, sides in want.items():
        for have, side in zip(got[a], sides):
            some = [x for x in side if x is not None]
            assert have == (pytest.approx(sum(some)) if some else None)


@pytest.mark.parametrize("parts", [1, 4])
def test_link_differences(spark, parts):
    rng = np.random.RandomState(6)
    rows = sorted(set(draw(rng, 150)), key=str)
    s = {i: float(v) for i, v in zip(IDS[1:-4], rng.normal(size=20))}
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "node long, nbr long, weight double")
    values = spark.createDataFrame([*s.items(), (19, None)], "node_id long, s double")
    got = {r.node_id: (r.apart, r.n) for r in links.link_differences(links.pack_links(frame, parts), values, "s").collect()}
    want = defaultdict(list)
    for a, b in rows:
        if a in s and b in s:
            want[a].append(abs(s[a] - s[b]))
    assert got == {a: (pytest.approx(sum(x)), len(x)) for a, x in want.items()}


def test_links_and_ppr_steps_are_not_shuffled_as_rows(random_graph):
    graph = random_graph[0]
    packed = links.pack_links(spectral.symmetric_links(graph.neighbours()))
    found = exchanges(spectral.propagate(packed, graph.features(), graph.feature_names))
    assert found and not [line for line in found if "nbr" in line]
    front = graph.nodes.select(F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.lit(1.0).alias("x"))
    second = spectral.symmetric_links(graph.neighbours()).toDF("v", "w", "y")
    moved = exchanges(blocks.path_masses(front, spectral.cut_lineage(second), 0.5, 0.0))
    assert moved and all("block" in line for line in moved)


@pytest.mark.parametrize("parts, chunk", [(1, 1 << 20), (3, 1 << 20), (3, 7)])
def test_path_masses(spark, monkeypatch, parts, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    rng = np.random.RandomState(9)
    first = [(a, b, float(x)) for (a, b), x in zip(draw(rng, 90), rng.randint(1, 9, 90) / 8)]
    second = [(a, b, float(x)) for (a, b), x in zip(draw(rng, 90), rng.randint(1, 9, 90) / 8)]
    want = defaultdict(float)
    for u, v, x in first:
        for a, w, y in second:
            if v is not None and a == v:
                want[u, w] += 0.5 * x * y
    got = blocks.path_masses(
        spark.createDataFrame(first, "u long, v long, x double"), spark.createDataFrame(second, "v long, w long, y double"), 0.5, 0.2, parts
    ).collect()
    assert len(got) == len({(r.u, r.w) for r in got})
    assert {(r.u, r.w): r.mass for r in got} == {p: pytest.approx(m) for p, m in want.items() if m >= 0.2}


@pytest.mark.parametrize("parts, ranges, chunk", [(1, 64, 1 << 20), (3, 4, 1 << 20), (3, 3, 5)])
def test_sampled_end_stats(spark, monkeypatch, parts, ranges, chunk):
    monkeypatch.setattr(samples, "CHUNK", chunk)
    rng = np.random.RandomState(11)
    unique = lambda n: sorted(set(draw(rng, n)), key=str)
    first, second, without = unique(100), unique(140), unique(60)
    values = [(i, float(k * k) if k % 4 else None, k) for k, i in enumerate(IDS[:-3])] + [(7, 2.5, 1)]
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in IDS], "i long").select(
        "i", neighbours._hash_number("i").alias("h")).collect()}
    got = {r.u: r for r in samples.sampled_end_stats(
        spark.createDataFrame(first, "u long, v long"), spark.createDataFrame(second, "v long, w long"), neighbours._hash_number, 4,
        spark.createDataFrame(values, "w long, x double, k long"), ["x", "k"],
        spark.createDataFrame(without, "u long, w long"), parts, ranges,
    ).collect()}
    want = {}
    for u in {u for u, v in first if u is not None}:
        mids = {v for a, v in first if a == u and v is not None}
        ends = {w for v, w in second if v in mids and ((u, w) not in without or w is None)}
        chosen = sorted(ends, key=lambda w: (order[w], -(2**63) if w is None else w))[:4]
        rows = [r for r in values for w in chosen if w is not None and r[0] == w]
        if rows:
            want[u] = rows
    assert set(got) == set(want)
    for u, rows in want.items():
        for i in (0, 1):
            x = [r[1 + i] for r in rows if r[1 + i] is not None]
            r = got[u]
            assert (r[f"c{i}"] or 0) == len(x)
            if x:
                assert (r[f"s{i}"], r[f"h{i}"], r[f"l{i}"]) == (pytest.approx(sum(x)), max(x), min(x))
                spread = r[f"q{i}"] / len(x) - (r[f"d{i}"] / len(x)) ** 2
                assert max(0.0, spread) == pytest.approx(np.var(x), abs=1e-6)


def test_sampled_two_hops_write_no_paths(random_graph):
    graph = random_graph[0]
    for frame in (neighbours.two_hop_features(graph, k=5), neighbours.exclusive_two_hop_features(graph, 3, 5), neighbours.riskstat_sampled(graph, 3, 5)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(mid" not in plan and "dense_rank" not in plan


def test_wide_statistics_of_hot_and_ordinary_nodes(spark, random_graph):
    graph, nodes, edges = random_graph
    rows = endpoints(graph.edges.unionByName(graph.edges.limit(3).withColumn("src", F.lit(None).cast("long"))))
    aggs = [how("nbr").alias(name) for name, how in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("h", F.max))]
    want = {r[0]: r[1:] for r in rows.where("node is not null").groupBy("node").agg(*aggs).collect()}
    for hot_node in (0, 12, 10_000):
        got = [(r[0], *[None if v is None else pytest.approx(v) for v in r[1:]]) for r in structure.wide_stats(graph, rows, aggs, hot_node).collect()]
        assert len(got) == len(want) and all(want[r[0]] == r[1:] for r in got)
    # The rows are shuffled, not a partial aggregate per task and node.
    plan = structure.wide_stats(graph, rows, aggs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Aggregate" not in plan[plan.index("Exchange"):]


@pytest.mark.parametrize("ratio", [0.0, 0.05, 0.4, 1.0])
@pytest.mark.parametrize("kind", ["spread", "ties", "nulls"])
def test_pruning_orders_only_rows_around_the_cut(spark, random_graph, monkeypatch, ratio, kind):
    graph, _, edges = random_graph
    rng = np.random.RandomState(2)
    value = {
        "spread": lambda i: float(rng.normal()), "ties": lambda i: float(i % 2),
        "nulls": lambda i: (None, float("nan"), 1.0, -1.0)[i % 4],
    }[kind]
    rows = [(*e, value(i)) for i, e in enumerate(edges)] * (20 if kind == "spread" else 1)
    scored = spark.createDataFrame(rows, "edge_id long, src long, dst long, edge_type int, ts int, score double")
    ordered, place = [], spectral.with_position

    def seen(df, *rest):
        ordered.append(df.count())
        return place(df, *rest)

    monkeypatch.setattr(spectral, "edge_scores", lambda *_: scored)
    monkeypatch.setattr(spectral, "with_position", seen)
    whole = FraudGraph(graph.nodes, scored.drop("score"))
    got = [tuple(r) for r in spectral.heterophily_prune(whole, None, [], ratio).collect()]
    rank = lambda r: (0 if r[5] is None else 2 if r[5] != r[5] else 1, r[5] if r[5] is not None and r[5] == r[5] else 0.0, *r[:5])
    want = sorted(rows, key=rank)[int(np.floor(len(rows) * ratio)):]
    assert sorted(map(rank, got)) == sorted(map(rank, want))
    assert kind != "spread" or sum(ordered) < len(rows) / 20
