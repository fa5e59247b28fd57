"""Plans and blocks of the hop joins: what is shuffled stays proportional to the edges."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.operators import blocks, hops, neighbours, samples
from ringsight.operators.twohop import two_hop


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_paths_are_not_shuffled(random_graph):
    graph = random_graph[0]
    for name in ("undirected_2hop", "directed_2hop_out", "directed_2hop_in", "mixed_propagation", "transaction_chain"):
        pairs = hops.BUILDERS[name](hops.Samples(hops.cut_lineage(graph.edges), 3), graph)
        wide = [line for line in exchanges(pairs) if "hashpartitioning(node" in line and "nbr" in line.split("]")[0].split("),")[0]]
        assert not wide, name
        stats = exchanges(hops.neighbour_stats(hops.cut_lineage(pairs), graph, name, [0, 1]))
        assert all("ENSURE_REQUIREMENTS" not in line for line in stats if "hashpartitioning(node#" in line), name


def brute(first, second, without=()):
    out = defaultdict(lambda: defaultdict(int))
    for u, v in first:
        for a, w in second:
            if v is not None and v == a and ((u, w) not in without or None in (u, w)):
                out[u][w] += 1
    return out


@pytest.mark.parametrize("parts, chunk", [(1, 1 << 20), (3, 1 << 20), (3, 7)])
def test_blocks_against_brute_force(spark, monkeypatch, parts, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    rng = np.random.RandomState(3)
    ids = [None, -5, 2**40, 2**62, *range(20)]
    draw = lambda n: list({(ids[a], ids[b]) for a, b in rng.randint(0, len(ids), size=(n, 2))})
    first, second, without = draw(120), draw(120), draw(60)
    values = [(i, float(k) if k % 3 else None, k) for k, i in enumerate(ids[:-4])] + [(7, 2.5, 1)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    a, b, c = frame(first, "u long, v long"), frame(second, "v long, w long"), frame(without, "u long, w long")
    want = brute(first, second, set(without))
    got = blocks.block_pairs(a, b, c, "n", parts).collect()
    assert {(r.u, r.w): r.n for r in got} == {(u, w): n for u, ws in want.items() for w, n in ws.items()}
    assert len(got) == sum(map(len, want.values()))
    counts = {r.u: r.n for r in blocks.block_sums(a, b, None, ["n"], c, parts).collect()}
    assert counts == {u: len(ws) for u, ws in want.items()}
    sums = {r.u: (r.x, r.k) for r in blocks.block_sums(a, b, frame(values, "w long, x double, k long"), ["x", "k"], c, parts).collect()}
    for u, ws in want.items():
        rows = [r for r in values for w in ws if w is not None and r[0] == w]
        xs = [r[1] for r in rows if r[1] is not None]
        assert (u in sums) == bool(rows)
        if rows:
            assert sums[u] == (sum(xs) if xs else None, sum(r[2] for r in rows))


def test_blocks_with_more_cells_than_32_bits_count(spark):
    n = 50_000  # starts and ends of one block: 2.5 billion cells
    ids = spark.range(n)
    to = lambda shift, a, b: ids.select(F.col("id").alias(a), (F.col("id") + shift).alias(b))
    near = to(2, "u", "w").where("u % 1000 <> 999")
    left = [999 + 1000 * i for i in range(n // 1000)]
    first, second = to(1, "u", "v"), ids.select((F.col("id") + 1).alias("v"), (F.col("id") + 2).alias("w"))
    assert sorted(r.u for r in blocks.block_pairs(first, second, near, parts=1).collect()) == left
    assert sorted(r.u for r in blocks.block_sums(first, second, None, ["n"], near, 1).collect()) == left
    stats = samples.sampled_end_stats(first, second, lambda c: F.col(c), 3, ids.selectExpr("id as w", "id as x"), ["x"], near, 1, 1)
    assert sorted(r.u for r in stats.collect()) == [u for u in left if u + 2 < n]
    steps = first.toDF("u", "v").unionByName(second.toDF("u", "v")).distinct().unionByName(to(2, "u", "v")).withColumn("x", F.lit(1))
    found = blocks.block_triangles(steps, 1).select("a", "b", "c").collect()
    assert sorted(map(tuple, found)) == [(i, i + 1, i + 2) for i in range(n)]


def test_steps_are_written_once_for_all_blocks(spark):
    """Each packed step lies in one shuffle row, and a block is one partition with all rows of its two groups once."""
    parts = 5
    rows = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") * 7 % 2000).alias("v"))
    first = blocks._packed(rows, blocks.FIRST, parts * blocks.TURNS)
    second = blocks._packed(rows.toDF("v", "w"), blocks.SECOND, parts)
    crossed = blocks._crossed(first, second, parts)
    assert "explode" not in crossed._jdf.queryExecution().executedPlan().toString()
    sizes = crossed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("x_kind").alias("x"), F.count("y_kind").alias("y")).collect()
    assert len(sizes) == parts * parts
    assert sum(r.x for r in sizes) == parts * first.count() and sum(r.y for r in sizes) == parts * second.count()
    for group in (1, 7, 64, 211):
        keys = spark.createDataFrame([(k,) for k in blocks._partition_keys(group)], "k int").repartition(group, "k")
        assert [r.k for r in keys.select(F.spark_partition_id().alias("p"), "k").orderBy("p").collect()] == blocks._partition_keys(group)


def test_samples_write_second_steps_once(spark):
    rows = spark.createDataFrame([(i, i * 7 % 50) for i in range(50)], "u long, v long")
    values = rows.selectExpr("u as w", "u as x")
    stats = samples.sampled_end_stats(rows, rows.toDF("v", "w"), lambda c: F.col(c), 3, values, ["x"], rows.toDF("u", "w"), 4, 3)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    # The only thing made of a packed row is one row of the product.
    assert "explode" not in plan and "Generate" not in plan and "CartesianProduct" in plan
    assert {r.u: r.s0 for r in stats.collect()} == {u: u * 49 % 50 for u in range(50) if u * 49 % 50 != u * 7 % 50}


def test_pairs_over_two_steps_are_not_shuffled(random_graph):
    graph = random_graph[0]
    steps = graph.edges.select("src", "dst").distinct()
    hop = two_hop(steps.toDF("u", "v"), steps.toDF("v", "w"))
    assert not exchanges(hop.pairs()) or all("block" in line for line in exchanges(hop.pairs()))
    last = neighbours.khop_exclusive(graph, 2)
    assert not [line for line in exchanges(last) if "hashpartitioning(node" in line or "hashpartitioning(u" in line]


def test_neighbour_distribution_of_hot_and_ordinary_nodes(random_graph):
    graph, nodes, edges = random_graph
    near = defaultdict(set)
    for _, a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    x = {n[0]: np.array(n[1:5]) for n in nodes}
    for hot_node in (4, 10_000):
        got = neighbours.neighbour_distribution(graph, hot_node=hot_node).collect()
        assert len(got) == len(nodes)
        for r in got:
            rows = np.array([x[v] for v in near[r.node_id]]) if near[r.node_id] else np.zeros((1, 4))
            for i in range(4):
                lo, hi = np.quantile(rows[:, i], [0.25, 0.75])
                assert r[f"orig_feat{i}_neighbor_iqr"] == pytest.approx(hi - lo if len(rows) >= 3 else 0.0, abs=1e-9)
    plan = neighbours.neighbour_distribution(graph)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Expand" not in plan
