"""Edge statistics, enhanced and business features, and graph structure."""

from __future__ import annotations

from ringsight.operators import business, enhanced, structure
from ringsight.registry.base import EDGES, ENDS, NODES, UND, Registry, div, settle, settled
from ringsight.registry.features import graph_query, on_nodes
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
BASE = [EDGES, NODES, ENDS]
HASH = "md5(concat_ws('|','42',cast(edge_id as varchar)))"
WHOLE = "edge_id, src, dst, edge_type, ts"

R.add("m1_degree", graph_query(enhanced.degrees_by_count),
      settled(BASE, on_nodes("sum(is_out) as fea_outdgree, sum(1-is_out) as fea_indgree")))


def gap_cte(key):
    rest = ", ".join(c for c in ("edge_id", "src", "dst", "edge_type") if c != key)
    return f"gaps_{key} as (select *, ts - lag(ts) over (partition by {key} order by ts, {rest}) as gap from edges)"


def gaps_query(spark, folder):
    graph = order_graph(spark, folder)
    gaps = enhanced.timestamp_gaps(graph.edges, "dst")
    return gaps.groupBy("src", "ts_diff").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n")


R.add("m2_ts_diff", gaps_query, f"with {EDGES}, {gap_cte('dst')} select src, gap as ts_diff, count(*) as n "
      "from gaps_dst group by src, gap")

MODE = {}
STATS = []
JOINS = []
for side, key, other, suffix in (("out", "src", "dst", "target"), ("in", "dst", "src", "source")):
    for col, stem in (("edge_type", f"fea_{side}_edge_type"), ("gap", f"fea_{side}_edge_timestamp_diff_1_{suffix}")):
        name = f"{side}_{col}"
        STATS.append(
            f"s_{name} as (select {key} as node, avg({col}) as {stem}_mean, max({col}) as {stem}_max, "
            f"min({col}) as {stem}_min, stddev_samp({col}) as {stem}_std, count(distinct {col}) as {stem}_nunique, "
            f"max({col})-min({col}) as {stem}_range from gaps_{other} group by {key})")
        STATS.append(
            f"m_{name} as (select node, v as {stem}_mode from (select {key} as node, {col} as v, "
            f"row_number() over (partition by {key} order by count(*) desc, {col}) as r from gaps_{other} "
            f"where {col} is not null group by {key}, {col}) where r = 1)")
        JOINS.append(name)
GAPPED = BASE + [gap_cte("dst"), gap_cte("src")] + STATS
R.add("m3_edge_col_stats", graph_query(enhanced.edge_column_stats), settled(GAPPED, "select node_id, " + ", ".join(
    f"s_{n}.* exclude (node), m_{n}.* exclude (node)" for n in JOINS) + " from nodes " + " ".join(
    f"left join s_{n} on s_{n}.node = node_id left join m_{n} on m_{n}.node = node_id" for n in JOINS)))
R.add("m4_mode", graph_query(lambda g: enhanced.edge_column_stats(g, modes_only=True)), settled(
    GAPPED, "select node_id, " + ", ".join(f"m_{n}.* exclude (node)" for n in JOINS) + " from nodes " + " ".join(
        f"left join m_{n} on m_{n}.node = node_id" for n in JOINS)))

R.add("m5_endpoint_feature_stats", graph_query(enhanced.endpoint_feature_stats), settled(
    BASE + ["near as (select e.node, e.is_out, " + ", ".join(f"f{i}" for i in range(10))
            + " from ends e join nodes n on n.node_id = e.nbr)"],
    on_nodes(", ".join(
        f"{how}(f{i}) filter (is_out={o}) as fea_{p}_neighbor_fea_x_{i}_{s}" for o, p in ((1, "out"), (0, "in"))
        for i in range(10) for s, how in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_samp"))),
        source="near")))
R.add("m5_endpoint_feature_stats_as_written",
      graph_query(lambda g: enhanced.endpoint_feature_stats(g, mode="as_written")),
      settled(BASE, "select node_id, " + ", ".join(
          f"case when {p} > 0 then {'0' if s == 'std' else f'f{i}'} else 0 end as fea_{p}_neighbor_fea_x_{i}_{s}"
          for p in ("o", "i") for i in range(10) for s in ("max", "min", "mean", "std")).replace("fea_o_", "fea_out_")
          .replace("fea_i_", "fea_in_")
          + " from nodes left join (select node, sum(is_out) as o, sum(1-is_out) as i from ends group by node) d on d.node = node_id"))

WAVES = ", ".join(
    f"{how}({t}(2*pi()*((ts-1)%{n})/{n}.0)) as enh_time_{t}_{p}_{s}" for p, n in (("week", 7), ("month", 30))
    for t in ("sin", "cos") for s, how in (("mean", "avg"), ("std", "stddev_samp")))
R.add("m6_time_cycle", graph_query(enhanced.time_cycles), settled(BASE, on_nodes(
    f"count(*) as enh_time_total_count, count(distinct ts) as enh_time_unique_days, {WAVES}, "
    "count(*)/(count(distinct ts)+1) as enh_time_density", source="edges", key="src")))

DEG = "(select n.node_id, coalesce(o,0) as o, coalesce(i,0) as i from nodes n left join (select node, sum(is_out) as o, sum(1-is_out) as i from ends group by node) d on d.node = n.node_id)"
R.add("m7_degree_group", graph_query(enhanced.degree_group), settled(BASE, f"""
  select node_id, o as enh_out_degree, i as enh_in_degree, o+i as enh_total_degree, i/(o+1) as enh_degree_ratio,
  abs(o-i) as enh_degree_imbalance, abs(o-i)/(o+i+1) as enh_degree_balance_ratio from {DEG}"""))

PAIR = "pairs as (select distinct src, dst from edges)"
R.add("m8_second_hop_count", graph_query(enhanced.second_hop_count), settled(BASE + [PAIR], """
  select node_id, a.n as enh_second_hop_out_count, b.n as enh_second_hop_in_count from nodes
  left join (select p.src as u, count(distinct q.dst) as n from pairs p join pairs q on p.dst = q.src group by 1) a on a.u = node_id
  left join (select p.dst as u, count(distinct q.src) as n from pairs p join pairs q on p.src = q.dst group by 1) b on b.u = node_id"""))


def hub_cte(key, degree):
    return f"hub_{key} as (select src, dst from (select *, count(*) over (partition by {key}) as n from edges) where n > {degree})"


R.add("m9_second_hop_hub", graph_query(enhanced.second_hop_hub), settled(
    BASE + [PAIR, hub_cte("src", 50), hub_cte("dst", 50)], """
  select node_id, a.n as enh_second_hop_out_count, b.n as enh_second_hop_in_count from nodes
  left join (select p.src as u, count(distinct q.dst) as n from hub_src p join pairs q on p.dst = q.src group by 1) a on a.u = node_id
  left join (select p.dst as u, count(distinct q.src) as n from hub_dst p join pairs q on p.src = q.dst group by 1) b on b.u = node_id"""))

R.add("m10_interaction_pattern", graph_query(enhanced.interaction_pattern), settled(BASE, on_nodes(
    "count(distinct dst) as enh_unique_targets, count(*) as enh_total_interactions, "
    "count(distinct edge_type) as enh_unique_edge_types", source="edges", key="src")))
R.add("m11_activity_span", graph_query(enhanced.activity_span), settled(BASE, on_nodes(
    "min(ts) as enh_first_activity, max(ts) as enh_last_activity, count(distinct ts) as enh_active_days, "
    "max(ts)-min(ts) as enh_activity_span, count(*)/(count(distinct ts)+1) as enh_daily_activity_rate",
    source="edges", key="src")))


def linked(cond, out, inn):
    return (f"links as (select node, sum(is_out) as {out}, sum(1-is_out) as {inn} from ends "
            f"where nbr in (select node_id from nodes where split='train' and {cond}) group by node)")


SIZE = "sizes as (select src, count(*) as n from edges group by src)"
R.add("m12_fraud_neighbours", graph_query(enhanced.fraud_neighbours), settled(
    BASE + [linked("label=1", "o", "i"), SIZE], """
  select node_id, o as enh_fraud_neighbors_out, i as enh_fraud_neighbors_in,
    coalesce(o,0)/(coalesce(n,0)+1) as enh_fraud_neighbor_ratio_out, coalesce(i,0)/(coalesce(n,0)+1) as enh_fraud_neighbor_ratio_in
  from nodes left join links on links.node = node_id left join sizes on sizes.src = node_id"""))

# --- business -------------------------------------------------------------------------------
R.add("b1_degree_anomaly", graph_query(business.degree_anomaly), settled(BASE, f"""
  select node_id, i/(o+1) as biz_degree_ratio, abs(o-i) as biz_degree_imbalance, 0 as biz_isolated_node,
   (o+i > 0 and (o=0 or i=0))::int as biz_one_way_node from {DEG}"""))
R.add("b2_time_concentration", graph_query(business.time_concentration), settled(BASE, on_nodes(
    "count(*) as biz_total_trans, count(distinct ts) as biz_active_days, max(ts)-min(ts) as biz_time_span, "
    "count(*)/(max(ts)-min(ts)+1) as biz_trans_concentration, count(*)/(count(distinct ts)+1) as biz_daily_intensity",
    source="edges", key="src")))
R.add("b3_diversity", graph_query(business.diversity), settled(BASE, on_nodes(
    "count(distinct edge_type) as biz_edge_type_diversity, count(distinct dst) as biz_unique_partners",
    source="edges", key="src")))


def second_fraud(key, other, side):
    fan = f"fan_{side} as (select {key} as v, count(*) as hits from edges where {other} in (select node_id from nodes where split='train' and label=1) group by {key})"
    far = f"far_{side} as (select h.{key} as u, sum(hits) as hits from edges h join fan_{side} f on f.v = h.{other} group by h.{key})"
    return [fan, far]


R.add("b4_second_hop_fraud", graph_query(business.second_hop_fraud), settled(
    BASE + second_fraud("src", "dst", "out") + second_fraud("dst", "src", "in"), """
  select node_id, a.hits as biz_first_hop_fraud_out, b.hits as biz_first_hop_fraud_in,
    fo.hits as biz_second_hop_fraud_out, fi.hits as biz_second_hop_fraud_in from nodes
    left join fan_out a on a.v = node_id left join fan_in b on b.v = node_id
    left join far_out fo on fo.u = node_id left join far_in fi on fi.u = node_id"""))
R.add("b5_time_gap_stats", graph_query(business.time_gap_stats), settled(BASE + [
    "steps as (select src, ts - lag(ts) over (partition by src order by ts) as gap from edges)"], on_nodes(
    "avg(gap) as biz_time_gap_mean, stddev_samp(gap) as biz_time_gap_std, max(gap) as biz_time_gap_max, "
    "min(gap) as biz_time_gap_min", source="steps", key="src")))
R.add("b6_triangle_count", graph_query(business.triangle_count), settled(
    BASE + ["simple as (select distinct src, dst from edges where src <> dst)"], """
  select node_id, n as biz_triangle_count from nodes left join (select p.src, count(*) as n from simple p
    join simple q on p.dst = q.src join simple r on r.src = p.src and r.dst = q.dst group by p.src) s on s.src = node_id"""))
R.add("b7_background_links", graph_query(business.background_links), settled(
    BASE + [linked("label in (2,3)", "biz_bg_conn_out", "biz_bg_conn_in")],
    "select node_id, links.* exclude (node) from nodes left join links on links.node = node_id"))
R.add("b8_risk_accumulation", graph_query(business.risk_accumulation), settled(
    BASE + ["flagged as (select e.*, case when n.split='train' then n.label end as label from edges e join nodes n on n.node_id = e.dst)"], on_nodes(
        "count(*) as biz_total_transactions, max(ts) as biz_last_activity, "
        "count(distinct dst) filter (label=1) as biz_cumulative_fraud_conn, "
        "count(distinct dst) filter (label=1)/(count(*)+1) as biz_fraud_conn_ratio", source="flagged", key="src")))

# --- structure ------------------------------------------------------------------------------
UNDS = BASE + [UND, "udeg as (select node, count(*) as d from und group by node)"]
R.add("g1_degrees", graph_query(structure.degrees), settled(UNDS, """
  select node_id, o as out_degree, i as in_degree, d as total_degree, ln(1+o) as out_degree_log, ln(1+i) as in_degree_log,
    ln(1+d) as total_degree_log, o/(max(o) over () + 1e-8) as out_degree_norm, i/(max(i) over () + 1e-8) as in_degree_norm,
    d/(count(*) over () - 1) as degree_centrality
  from (select x.*, coalesce(d,0) as d from """ + DEG + " x left join udeg on udeg.node = x.node_id)"))

STEPS = ["pr0 as (select node_id, 1.0/(select count(*) from nodes) as r, false as done from nodes)",
         "links as (select node, nbr, 1.0/d as w from und join udeg using (node))"]
for k in range(1, 21):
    STEPS.append(f"""pr{k} as materialized (select p.node_id, case when p.done then p.r else t.r end as r,
      p.done or (sum(abs(t.r - p.r)) over () < 1e-6) as done from pr{k-1} p join (select q.node_id,
      0.15/(select count(*) from nodes) + 0.85*coalesce(s,0) as r from pr{k-1} q left join (select nbr, sum(r*w) as s
      from links join pr{k-1} z on z.node_id = links.node group by nbr) u on u.nbr = q.node_id) t on t.node_id = p.node_id)""")
R.add("g2_pagerank", graph_query(structure.pagerank), settled(
    UNDS + STEPS, "select node_id, r as pagerank, ln(1+r) as pagerank_log from pr20"))
R.add("g3_clustering_coeff", graph_query(structure.clustering_coefficient), settled(UNDS, f"""
  select node_id, {div('2*links', 'd*(d-1)')} as clustering_coeff from nodes left join udeg on udeg.node = node_id
  left join (select p.node, count(*) as links from und p join und q on p.node = q.node and p.nbr < q.nbr
    join und r on r.node = p.nbr and r.nbr = q.nbr group by p.node) s on s.node = node_id"""))
R.add("g4_second_order_walks", graph_query(structure.second_order_walks), settled(UNDS, """
  select node_id, s as second_neighbors, ln(1+coalesce(s,0)) as second_neighbors_log from nodes left join
   (select u.node, sum(d) as s from und u join udeg e on e.node = u.nbr group by u.node) x on x.node = node_id"""))
R.add("g5_neighbour_degree_stats", graph_query(structure.neighbour_degree_stats), settled(UNDS, """
  select node_id, x.* exclude (node) from nodes left join (select u.node, avg(d) as neighbor_degree_mean,
    max(d) as neighbor_degree_max, min(d) as neighbor_degree_min, stddev_pop(d) as neighbor_degree_std
    from und u join udeg e on e.node = u.nbr group by u.node) x on x.node = node_id"""))
R.add("g6_constraint", graph_query(structure.constraint), settled(UNDS, """
  select node_id, case when d is null then 1 else coalesce(s,0) end as "constraint" from nodes left join udeg on udeg.node = node_id
  left join (select p.node, sum(1.0/(di.d*dq.d)) as s from und p join und q on q.node = p.nbr
     join und r on r.node = p.node and r.nbr = q.nbr join udeg di on di.node = p.node join udeg dq on dq.node = p.nbr
     where q.nbr <> p.node and q.nbr <> p.nbr group by p.node) x on x.node = node_id"""))
