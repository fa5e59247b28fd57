"""Distributed order, windows and two-hop unions against brute force, with hot keys and tiny blocks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.functions.ordered import average_ranks, exact_quantiles, running_sums, with_position
from ringsight.functions.sampling import sample_k_per_key
from ringsight.operators import blocks, embed, neighbours, structure, transactions
from ringsight.operators.enhanced import hops, second_hop_count
from ringsight.operators.twohop import exclusive_sums, two_hop, union_sums


@pytest.fixture(scope="module")
def hot_rows(spark):
    """2000 rows, half of them under one key."""
    rng = np.random.RandomState(3)
    rows = [(i, "hot" if i % 2 else f"k{rng.randint(40)}", float(rng.randint(0, 50))) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, key string, v double").repartition(6), rows


def test_positions_split_a_hot_key(hot_rows):
    df, rows = hot_rows
    got = {r["id"]: r["pos"] for r in with_position(df, ["key"], ["v", "id"]).collect()}
    groups = defaultdict(list)
    for i, k, v in rows:
        groups[k].append((v, i))
    want = {i: p for members in groups.values() for p, (_, i) in enumerate(sorted(members))}
    assert got == want


def test_global_positions_and_running_sums(hot_rows):
    df, rows = hot_rows
    got = {r["id"]: (r["pos"], r["s"]) for r in running_sums(
        with_position(df, [], ["v", "id"]), [], ["v", "id"], {"s": F.col("v")}).collect()}
    done = 0.0
    for p, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[2], r[0]))):
        done += v
        assert got[i] == (p, done)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_quantiles_match_numpy(hot_rows, keys):
    df, rows = hot_rows
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["key"] if keys else None: r["q"] for r in exact_quantiles(df.select(*keys, F.col("v").alias("value")), keys, probs).collect()}
    groups = defaultdict(list)
    for _, k, v in rows:
        groups[k if keys else None].append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(values, probs), rtol=1e-12)


def test_average_ranks(hot_rows):
    df, rows = hot_rows
    got = {r["id"]: r["v"] for r in average_ranks(df, ["id"], ["v"]).collect()}
    values = np.array([r[2] for r in rows])
    for i, _, v in rows[:200]:
        below, same = (values < v).sum(), (values == v).sum()
        assert got[i] == below + (same + 1) / 2


def test_sample_never_exceeds_k_and_plans_a_group_limit(hot_rows):
    df, _ = hot_rows
    sample = sample_k_per_key(df, ["key"], ["id"], ["id"], 5)
    assert sample.groupBy("key").count().agg(F.max("count")).first()[0] == 5
    assert "WindowGroupLimit" in sample._jdf.queryExecution().toString()


def brute_two_hop(first, second):
    out = defaultdict(set)
    for u, v in first:
        for a, w in second:
            if v == a:
                out[u].add(w)
    return out


@pytest.mark.parametrize("threshold", [0, 2, 5, 1000])
def test_two_hop_union_with_and_without_hubs(random_graph, threshold):
    graph, nodes, edges = random_graph
    pairs = {(e[1], e[2]) for e in edges}
    want = brute_two_hop(pairs, pairs)
    hop = two_hop(*hops(graph.edges, "out"), threshold)
    assert {r["u"]: r["n"] for r in union_sums(hop, None, ["n"]).collect()} == {u: len(w) for u, w in want.items()}
    listed = defaultdict(set)
    rows = hop.pairs().collect()
    for r in rows:
        listed[r["u"]].add(r["w"])
    assert listed == want and len(rows) == sum(map(len, want.values()))


@pytest.mark.parametrize("threshold", [0, 3, 1000])
def test_exclusive_sums(random_graph, threshold):
    graph, nodes, edges = random_graph
    pairs = {(e[1], e[2]) for e in edges}
    reach = brute_two_hop(pairs, pairs)
    near = {(u, w) for u, w in pairs} | {(i, i) for i in range(len(nodes))}
    value = {n[0]: n[1] for n in nodes}
    want = {u: sum(value[w] for w in ws if (u, w) not in near) for u, ws in reach.items()}
    hop = two_hop(*hops(graph.edges, "out"), threshold)
    spark = graph.nodes.sparkSession
    got = exclusive_sums(hop, spark.createDataFrame(sorted(near), "u long, w long"),
                         graph.nodes.select(F.col("node_id").alias("w"), "f0"), ["f0"])
    got = {r["u"]: r["f0"] or 0.0 for r in got.collect()}
    for u, total in want.items():
        assert got.get(u, 0.0) == pytest.approx(total, abs=1e-9)


def test_second_hop_count_is_the_same_for_any_threshold(random_graph):
    graph, _, _ = random_graph
    ways = [sorted(map(tuple, second_hop_count(graph, t).collect())) for t in (1, 4, 5000)]
    assert ways[0] == ways[1] == ways[2]


def test_triangles_against_brute_force(random_graph):
    graph, nodes, edges = random_graph
    pairs = {(a, b) for _, a, b, _, _ in edges if a != b}
    want = defaultdict(int)
    for s, t in pairs:
        for u in range(len(nodes)):
            if (t, u) in pairs and (s, u) in pairs:
                want[s] += 1
    got = {r["node"]: r["n"] for r in structure.directed_triangle_counts(graph.edges).collect()}
    assert got == want


@pytest.mark.parametrize("parts", [1, 3])
def test_triangles_are_found_in_blocks_without_a_row_per_path(spark, monkeypatch, parts):
    monkeypatch.setattr(blocks, "CHUNK", 50)
    rng = np.random.RandomState(4)
    pairs = {tuple(sorted(map(int, p))) for p in rng.randint(0, 40, size=(300, 2)) if p[0] != p[1]}
    number = {p: 1 + sum(p) % 3 for p in pairs}
    steps = spark.createDataFrame([(a, b, x) for (a, b), x in number.items()], "u long, v long, x int")
    found = blocks.block_triangles(steps, parts)
    want = {
        (a, b, c, number[a, b], number[b, c], number[a, c])
        for a, b in pairs for c in range(40) if (b, c) in pairs and (a, c) in pairs
    }
    assert sorted(map(tuple, found.collect())) == sorted(want)
    texts = blocks.block_triangles(steps.select(*[F.format_string("%02d", c).alias(c) for c in "uv"], "x"))
    assert {(int(a), int(b), int(c), *x) for a, b, c, *x in texts.collect()} == want
    plan = structure.triangles(steps.select(F.col("u").alias("src"), F.col("v").alias("dst")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_walks_take_their_steps_from_pieces_of_neighbours(random_graph, monkeypatch):
    graph, _, _ = random_graph
    written, cut = [], embed.cut_lineage

    def kept(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(embed, "cut_lineage", kept)
    ways = []
    for size in (1, 4, 256):
        monkeypatch.setattr(embed, "PIECE", size)
        ways.append(sorted(map(tuple, embed.random_walk_stats(graph, walks=3, length=4).collect())))
    assert ways[0] == ways[1] == ways[2]
    sizes = [r.n for df in written if "next" in df.columns for r in df.select(F.size("next").alias("n")).collect()]
    assert max(sizes) > 4 and min(df.count() for df in written if "next" in df.columns) <= 40


def test_adjacency_is_split_and_comes_back(random_graph):
    graph, nodes, edges = random_graph
    parts = neighbours.adjacency_list(graph, chunk=4)
    want = {(a, b) for _, a, b, _, _ in edges} | {(b, a) for _, a, b, _, _ in edges} | {(n[0], n[0]) for n in nodes}
    assert {tuple(r) for r in neighbours.edge_list(parts).collect()} == want
    assert parts.where("part > 0").count() > 0


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.RandomState(5)
    rows = [
        (i, int(rng.randint(0, 400)), "S0" if i % 3 else f"S{rng.randint(5)}", f"T{rng.randint(6)}", float(rng.randint(1, 500)) / 4,
         f"L{95 + rng.randint(60)}", "abc"[rng.randint(3)], int(rng.randint(0, 3)))
        for i in range(300)
    ]
    schema = "row_id long, Time long, Source string, Target string, Amount double, Location string, Type string, Labels int"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize("keys", [[], ["Source"]])
def test_rolling_amounts_over_small_blocks(log, keys):
    df, rows = log
    lookbacks = [2, 15, 60]
    got = {r["row_id"]: r for r in transactions.rolling_amount(df, keys, lookbacks, at_least=1).collect()}
    for row in rows:
        for length in lookbacks:
            seen = [r for r in rows if row[1] - length <= r[1] <= row[1] and (not keys or r[2] == row[2])]
            amounts = np.array([r[4] for r in seen])
            g = got[row[0]]
            assert g[f"trans_at_num_{length}"] == len(seen)
            assert g[f"trans_at_totl_{length}"] == pytest.approx(amounts.sum())
            assert g[f"trans_at_std_{length}"] == pytest.approx(amounts.std(ddof=1) if len(seen) > 1 else 0.0, abs=1e-9)
            assert g[f"trans_at_bias_{length}"] == pytest.approx(row[4] - amounts.mean())
            for c, at in (("target", 3), ("location", 5), ("type", 6)):
                assert g[f"trans_{c}_num_{length}"] == len({r[at] for r in seen})


def test_sequence_edges_over_small_blocks(log):
    df, rows = log
    got = {tuple(r) for r in transactions.sequence_edges(df, block=3).collect()}
    want = set()
    for column, at in (("Source", 2), ("Target", 3), ("Location", 5), ("Type", 6)):
        groups = defaultdict(list)
        for r in rows:
            groups[r[at]].append((r[1], r[0]))
        for members in groups.values():
            order = [i for _, i in sorted(members)]
            want |= {(column, a, order[p + j]) for p, a in enumerate(order) for j in (1, 2) if p + j < len(order)}
    assert got == want


@pytest.mark.parametrize("as_written", [False, True])
def test_row_spans_and_entropy(log, as_written):
    df, rows = log
    known = [r for r in rows if r[7] != 2]
    spans = [1, 5, 20]

    def entropy(part):
        if not part:
            return 0.0
        sums = defaultdict(float)
        for r in part:
            sums[r[6]] += r[4]
        whole = sum(sums.values())
        return -sum(a / whole * np.log(1e-5 + a / whole) for a in sums.values())

    got = {(r["row_id"], r["span"]): r for r in transactions.span_2d(df, spans, as_written=as_written).collect()}
    for i, row in enumerate(known):
        for w in spans:
            window = known[i - w : i] if i >= w else []
            own = [r for r in window if r[2] == row[2]]
            both = (window + [row] if i >= w else []) if as_written else own + [row]
            g = got[(row[0], w)]
            assert g["number"] == len(own)
            assert g["total_amount"] == pytest.approx(sum(r[4] for r in own))
            assert g["entropy_delta"] == pytest.approx(entropy(own) - entropy(both), abs=1e-9)
