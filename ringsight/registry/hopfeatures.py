"""Sampled hop families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions.sampling import sample_k_per_key
from ringsight.graph import EDGE_COLUMNS
from ringsight.operators import hops
from ringsight.registry.base import EDGES, NODES, Registry, settle, settled
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

HASH = "md5(concat_ws('|','42',cast(edge_id as varchar)))"
PAIR_HASH = "md5(concat_ws('|','42',cast(node as varchar),cast(nbr as varchar)))"
WHOLE = "edge_id, src, dst, edge_type, ts"
TYPES = [0, 3, 4]


def top(key, k):
    return (f"(select *, row_number() over (partition by {key} order by {HASH}, {WHOLE}) as rk from edges) where rk <= {k}")


def out_cte(k):
    return f"out_k as (select src as node, dst as nbr, edge_id, edge_type, ts::double as ts from {top('src', k)})"


def in_cte(k):
    return f"in_k as (select dst as node, src as nbr, edge_id, edge_type, ts::double as ts from {top('dst', k)})"


def und_ctes(source, k):
    return [
        f"both_ways as (select src as node, dst as nbr, 0 as way, edge_id, edge_type, ts::double as ts from {source} "
        f"union all select dst, src, 1, edge_id, edge_type, ts from {source})",
        "firsts as (select * from (select *, row_number() over (partition by node, nbr order by way, edge_id, edge_type, ts) as r from both_ways) where r = 1)",
        f"und_k as (select * from (select *, row_number() over (partition by node order by {HASH}, edge_id, nbr) as rk from firsts) where rk <= {k})",
    ]


def two_ctes(first, second, k):
    return [
        "paths as (select a.node, b.nbr, a.edge_type, a.ts as ts1, b.ts as ts2, row_number() over (partition by a.node, b.nbr "
        f"order by a.edge_id, a.edge_type, a.ts, b.edge_id, b.ts) as r from {first} a join {second} b on a.nbr = b.node where a.node <> b.nbr)",
        f"two_k as (select * from (select node, nbr, edge_type, (ts1+ts2)/2 as ts, row_number() over (partition by node order by {PAIR_HASH}) as rk "
        f"from paths where r = 1) where rk <= {k})",
    ]


def stats_sql(ctes, pairs, prefix, types=TYPES):
    how = [("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")]
    cols = [f"{f}(f{i}) as {prefix}_f{i}_{s}" for i in range(10) for s, f in how]
    cols += [f"{f}(ts) as {prefix}_timestamp_{s}" for s, f in how]
    cols += [f"max(ts)-min(ts) as {prefix}_timestamp_range"]
    for t in types:
        cols += [f"{f}(ts) filter (edge_type={t}) as {prefix}_type_{t}_{s}" for s, f in how]
        cols += [f"count(*) filter (edge_type={t}) as {prefix}_type_{t}_count",
                 f"(max(ts) filter (edge_type={t}))-(min(ts) filter (edge_type={t})) as {prefix}_type_{t}_range"]
    cols += [f"{f}(gap) as {prefix}_interval_{s}" for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min"))]
    return settled(
        [EDGES, NODES] + ctes + [
            f"stepped as (select *, ts - lag(ts) over (partition by node order by ts) as gap from {pairs})",
            "stats as (select node, " + ", ".join(cols) + " from stepped p join (select * exclude (label, split) from nodes) n on n.node_id = p.nbr group by node)",
        ],
        "select n.node_id, stats.* exclude (node) from nodes n left join stats on stats.node = n.node_id")


def family(name, k=hops.K):
    return lambda spark, folder: settle(hops.hop_features(order_graph(spark, folder), name, k, TYPES))


def sampled(spark, folder):
    graph = order_graph(spark, folder)
    return sample_k_per_key(graph.edges, ["src"], ["edge_id"], EDGE_COLUMNS, hops.K)


def family_sql(k, chain_k):
    two = lambda ctes, a, b, name: stats_sql(ctes + two_ctes(a, b, k), "two_k", name)
    und = lambda ctes, source, name: stats_sql(ctes + und_ctes(source, k), "und_k", name)
    inner = "inner_edges as (select * from edges where src in (select n from {0}) and dst in (select n from {0}))"
    return {
        "directed_1hop_out": stats_sql([out_cte(k)], "out_k", "directed_1hop_out"),
        "directed_1hop_in": stats_sql([in_cte(k)], "in_k", "directed_1hop_in"),
        "undirected_1hop": und([], "edges", "undirected_1hop"),
        "directed_2hop_out": two([out_cte(k)], "out_k", "out_k", "directed_2hop_out"),
        "directed_2hop_in": two([in_cte(k)], "in_k", "in_k", "directed_2hop_in"),
        "undirected_2hop": two(und_ctes("edges", k), "und_k", "und_k", "undirected_2hop"),
        "mixed_propagation": two([out_cte(k), in_cte(k)], "out_k", "in_k", "mixed_propagation"),
        "recent_activity": und(
            ["recent as (select * from edges where ts >= (select quantile_cont(ts, 0.7) from edges))"],
            "recent", "recent_activity"),
        "risk_cluster": und(
            ["risky as (select node_id as n from nodes where f9 > (select quantile_cont(f9, 0.8) from nodes))",
             inner.format("risky")], "inner_edges", "risk_cluster"),
        "core_business": und(
            ["deg as (select src as n, count(*) as d from edges group by src)",
             "core as (select n from deg where d > (select quantile_cont(d, 0.8) from deg))", inner.format("core")],
            "inner_edges", "core_business"),
        "financial_hub": und(
            ["deg as (select n, count(*) as d from (select src as n from edges union all select dst from edges) group by n)",
             "hub as (select n from deg where d > (select quantile_cont(d, 0.85) from deg))",
             "touching as (select * from edges where src in (select n from hub) or dst in (select n from hub))"],
            "touching", "financial_hub"),
        "transaction_chain": stats_sql([out_cte(chain_k)] + [
            "chains as (select a.node, c.nbr, a.edge_type, (a.ts+b.ts+c.ts)/3 as ts, row_number() over (partition by a.node, c.nbr "
            "order by a.edge_id, a.edge_type, a.ts, b.edge_id, b.ts, c.edge_id, c.ts) as r from out_k a join out_k b on a.nbr = b.node "
            "join out_k c on b.nbr = c.node where a.node <> c.nbr)",
            f"chain_k as (select * from (select node, nbr, edge_type, ts, row_number() over (partition by node order by {PAIR_HASH}) as rk "
            f"from chains where r = 1) where rk <= {chain_k})"], "chain_k", "transaction_chain"),
    }


K, CHAIN_K = hops.K, 5
R.add("h0_sample_k_per_key", sampled, f"with {EDGES} select {WHOLE} from {top('src', K)}")
for number, (name, sql) in enumerate(family_sql(K, CHAIN_K).items(), start=1):
    R.add(f"h{number}_{name}", family(name, CHAIN_K if name == "transaction_chain" else K), sql)


def intervals(spark, folder):
    graph = order_graph(spark, folder)
    pairs = hops.undirected_1hop(hops.Samples(graph.edges), graph)
    times = pairs.groupBy(F.col("node").alias("node_id")).agg(F.array_sort(F.collect_list("ts")).alias("t"))
    return settle(times.select("node_id", *hops.interval_columns(F.col("t"), "undirected_1hop")))


R.add("n0a_interval_stats", intervals, settled([EDGES] + und_ctes("edges", K), """
  select node as node_id, avg(gap) as undirected_1hop_interval_mean, stddev_pop(gap) as undirected_1hop_interval_std,
   max(gap) as undirected_1hop_interval_max, min(gap) as undirected_1hop_interval_min from
   (select node, ts - lag(ts) over (partition by node order by ts) as gap from und_k) group by node"""))


def types_query(spark, folder):
    graph = order_graph(spark, folder)
    return hops.top_types(hops.undirected_1hop(hops.Samples(graph.edges), graph))


R.add("n0b_top_types", types_query, f"with {', '.join([EDGES] + und_ctes('edges', K))} select edge_type, count(*) as n "
      "from und_k group by edge_type order by n desc, edge_type limit 3")

SMALL_K = 5
R.add("n0c_build_all", lambda spark, folder: settle(hops.all_hop_features(order_graph(spark, folder), SMALL_K, TYPES)),
      "select * from " + " join ".join(
          f"({sql}) t{i}" + (" using (node_id)" if i else "") for i, sql in enumerate(family_sql(SMALL_K, SMALL_K).values())))
