"""Degree, window, risk, missing-value and neighbour-type queries."""

from __future__ import annotations

from ringsight.operators import nodetypes, nulls, temporal
from ringsight.registry.base import EDGES, ENDS, GAPPED, NODES, Registry, div, settle, settled
from ringsight.sources.warehouse import order_graph, with_gaps

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

LAST = "(select max(ts) from edges)"
BASE = [EDGES, NODES, ENDS]


def graph_query(op, gaps=False):
    def run(spark, folder):
        graph = order_graph(spark, folder)
        return settle(op(with_gaps(graph) if gaps else graph))

    return run


def on_nodes(aggs: str, source: str = "ends", key: str = "node", extra: str = "", where: str = "") -> str:
    """SQL: aggregate ``source`` per node, left-join on all nodes."""
    w = f"where {where}" if where else ""
    return (
        f"select n.node_id, s.* exclude ({key}){extra} from nodes n left join "
        f"(select {key}, {aggs} from {source} {w} group by {key}) s on n.node_id = s.{key}"
    )


R.add("d1_time_window_counts", graph_query(temporal.time_window_counts), settled(BASE, on_nodes(
    ", ".join(f"count(*) filter (is_out=1 and ts >= {LAST}-{w}+1) as td_{w}, "
              f"count(*) filter (is_out=0 and ts >= {LAST}-{w}+1) as td_in_{w}" for w in (7, 15, 30)))))

R.add("d2_type_window_counts", graph_query(temporal.type_window_counts), settled(BASE, on_nodes(
    ", ".join(f"count(*) filter (is_out=1 and edge_type={t} and ts >= {LAST}-{w}+1) as td_type{t}_{w}"
              for t in range(11) for w in (7, 15, 30)))))

R.add("d3_degree_features", graph_query(temporal.degree_features), settled(BASE, f"""
  select node_id, o as out_degree, i as in_degree, o+i as total_degree, {div('o', 'i')} as degree_ratio,
    abs(o-i) as degree_imbalance from (select n.node_id, coalesce(o,0) as o, coalesce(i,0) as i
    from nodes n left join (select node, sum(is_out) as o, sum(1-is_out) as i from ends group by node) s
    on s.node = n.node_id)"""))

R.add("d4_temporal_features", graph_query(temporal.temporal_features), settled(BASE, f"""
  select node_id, active_days_out, active_days_in, last_active_out, last_active_in,
    {LAST} - coalesce(last_active_out,0) as inactive_days_out, {LAST} - coalesce(last_active_in,0) as inactive_days_in
  from nodes left join (select node, count(distinct ts) filter (is_out=1) as active_days_out,
    count(distinct ts) filter (is_out=0) as active_days_in, max(ts) filter (is_out=1) as last_active_out,
    max(ts) filter (is_out=0) as last_active_in from ends group by node) s on s.node = node_id"""))

R.add("d5_type_ratio_7d", graph_query(temporal.type_ratio_7d), settled(BASE, on_nodes(
    ", ".join(div(f"count(*) filter (is_out={o} and edge_type={t})", f"count(*) filter (is_out={o})")
              + f" as td_type_ratio_{p}7d_{t}" for o, p in ((1, ""), (0, "in_")) for t in range(11)),
    where=f"ts >= {LAST} - 6")))

R.add("d6_risk_neighbours", graph_query(temporal.risk_neighbours), settled(
    BASE + ["risky as (select e.*, case when n.split='train' then n.label else 0 end as risk "
            "from ends e join nodes n on e.nbr = n.node_id)"],
    on_nodes(", ".join(
        f"sum(risk) filter (is_out={o}) as risk_nei_{p}_sum, max(risk) filter (is_out={o}) as risk_nei_{p}_max, "
        f"avg(risk) filter (is_out={o}) as risk_nei_{p}_mean" for o, p in ((1, "out"), (0, "in"))), source="risky")))

# --- missing values -------------------------------------------------------------------------
FLAGS = [f"(f{i} = -1)::int" for i in range(10)]


def share(parts):
    return f"(({' + '.join(parts)}) / {float(len(parts))})"


GAPS = BASE + [GAPPED]
RATIO = share(FLAGS)

R.add("u1_null_pattern", graph_query(nulls.null_pattern, gaps=True), settled(GAPS, f"""
  select node_id, {'+'.join(FLAGS)} as null_count, {RATIO} as null_ratio,
    {', '.join(f'{FLAGS[i]} as f{i}_is_null' for i in range(5))},
    {share(FLAGS[:8])} as front_feature_null_ratio, {share(FLAGS[8:])} as back_feature_null_ratio,
    {RATIO} as null_pattern_mean, sqrt({RATIO}*(1-{RATIO})) as null_pattern_std from gapped"""))

NEAR = f"near as (select e.*, r.ratio from ends e join (select node_id, {RATIO} as ratio from gapped) r on r.node_id = e.nbr)"

R.add("u2_neighbour_null", graph_query(nulls.neighbour_null, gaps=True), settled(GAPS + [NEAR], on_nodes(
    ", ".join(f"avg(ratio) filter (is_out={o}) as {p}_nei_null_ratio_mean, max(ratio) filter (is_out={o}) as "
              f"{p}_nei_null_ratio_max, avg((ratio>0.5)::int) filter (is_out={o}) as {p}_nei_high_null_ratio"
              for o, p in ((1, "out"), (0, "in"))), source="near")))

R.add("u3_recent_neighbour_null", graph_query(nulls.recent_neighbour_null, gaps=True), settled(
    GAPS + [NEAR], on_nodes(
        ", ".join(f"avg(ratio) filter (is_out={o}) as {p}_recent_30d_null_mean"
                  for o, p in ((1, "out"), (0, "in"))), source="near", where=f"ts >= {LAST} - 29")))

R.add("u4_null_risk", graph_query(nulls.null_risk, gaps=True), settled(GAPS, f"""
  select node_id, ratio as null_risk_basic, key_feature_null_risk,
    ratio * least(coalesce(d,0)/1000.0, 1.0) as degree_weighted_null_risk,
    {div('ratio - avg(ratio) over ()', 'stddev_pop(ratio) over ()')} as null_anomaly_score
  from (select node_id, {RATIO} as ratio, greatest({', '.join(FLAGS[:5])}) as key_feature_null_risk from gapped) g
  left join (select node, count(*) as d from ends group by node) s on s.node = node_id"""))

G1, G2 = share(FLAGS[:6]), share(FLAGS[6:])
R.add("u5_null_interaction", graph_query(lambda g: nulls.null_interaction(g, cuts=(6, 10)), gaps=True), settled(GAPS, f"""
  select node_id, {FLAGS[0]}*{FLAGS[1]} as f0_f1_null_both, {FLAGS[0]}*{FLAGS[2]} as f0_f2_null_both,
    {FLAGS[1]}*{FLAGS[2]} as f1_f2_null_both, {FLAGS[0]}*{FLAGS[1]}*{FLAGS[2]} as f0_f1_f2_null_all,
    abs({G1}-{G2})/2 as null_group_diversity from gapped"""))

BITS = "||".join(f"({f})::varchar" for f in FLAGS)
STREAKS = "list_filter(string_split_regex(bits, '0+'), lambda s: len(s) > 0)"
CHANGES = "+".join(f"abs({b}-{a})" for a, b in zip(FLAGS, FLAGS[1:]))
R.add("u6_null_sequence", graph_query(nulls.null_sequence, gaps=True), settled(GAPS, f"""
  select node_id, len(st) as seq_streak_count, coalesce(list_max(list_transform(st, lambda s: len(s))),0) as seq_max_streak,
    case when len(st) > 0 then ones / len(st)::double else 0 end as seq_avg_streak, ch as seq_changes,
    ch / 9.0 as seq_volatility,
    case when instr(bits,'1')>0 then (instr(bits,'1')-1)/10.0 else -1 end as seq_first_missing_pos,
    case when instr(bits,'1')>0 then (10-instr(reverse(bits),'1'))/10.0 else -1 end as seq_last_missing_pos,
    fr as seq_density_front, mi as seq_density_middle, ba as seq_density_back
  from (select *, {STREAKS} as st from (select node_id, {BITS} as bits, {CHANGES} as ch, {'+'.join(FLAGS)} as ones,
    {share(FLAGS[:3])} as fr, {share(FLAGS[3:6])} as mi, {share(FLAGS[6:])} as ba from gapped))"""))

R.add("u7_isnull_flags", graph_query(nulls.isnull_flags, gaps=True), settled(GAPS, f"""
  select node_id, {', '.join(f'{f} as isnull_fea_x_{i}' for i, f in enumerate(FLAGS))},
    {'+'.join(FLAGS)} as isnull_fea_sum, {RATIO} as isnull_fea_ratio from gapped"""))

# --- neighbour types ------------------------------------------------------------------------
KIND = "case label when 2 then 1 when 3 then 2 else 0 end"
TYPED = BASE + [
    f"typed as (select e.node, e.is_out, {KIND} as k from ends e join nodes n on n.node_id = e.nbr)",
    "counts as (select n.node_id, " + f"{KIND} as node_type, " + ", ".join(
        f"coalesce(s.{p}_type_{t}_cnt,0) as {p}_type_{t}_cnt" for p in ("out", "in") for t in range(3))
    + " from nodes n left join (select node, " + ", ".join(
        f"count(*) filter (is_out={o} and k={t}) as {p}_type_{t}_cnt"
        for o, p in ((1, "out"), (0, "in")) for t in range(3))
    + " from typed group by node) s on s.node = n.node_id)",
    "ratios as (select *, " + ", ".join(
        div(f"{p}_type_{t}_cnt", f"{p}_type_0_cnt+{p}_type_1_cnt+{p}_type_2_cnt") + f" as {p}_type_{t}_ratio"
        for p in ("out", "in") for t in range(3)) + " from counts)",
]
MAIN = ", ".join(
    f"case when {p}_type_0_cnt >= greatest({p}_type_1_cnt,{p}_type_2_cnt) then 0 "
    f"when {p}_type_1_cnt >= {p}_type_2_cnt then 1 else 2 end as {p}_main_type" for p in ("out", "in"))
SAME = ", ".join(
    f"case node_type when 0 then {p}_type_0_ratio when 1 then {p}_type_1_ratio else {p}_type_2_ratio end "
    f"as {p}_same_ratio" for p in ("out", "in"))

R.add("y1_node_type_map", graph_query(nodetypes.node_type_map),
      settled(BASE, f"select node_id, {KIND} as node_type from nodes"))
R.add("y2_type_crosstab", graph_query(nodetypes.type_crosstab), settled(TYPED, "select * from counts"))
R.add("y3_type_ratios", graph_query(lambda g: nodetypes.type_ratios(nodetypes.type_crosstab(g))),
      settled(TYPED, "select * from ratios"))
R.add("y4_main_type", graph_query(lambda g: nodetypes.main_type(nodetypes.type_crosstab(g))),
      settled(TYPED, f"select *, {MAIN} from counts"))
R.add("y5_same_type_ratio",
      graph_query(lambda g: nodetypes.same_type_ratio(nodetypes.type_ratios(nodetypes.type_crosstab(g)))),
      settled(TYPED, f"select *, {SAME} from ratios"))
R.add("y6_type_risk", graph_query(nodetypes.type_features), settled(TYPED, f"""
  select *, {MAIN}, {SAME}, out_type_2_ratio as out_risk_ratio, in_type_2_ratio as in_risk_ratio,
    (out_type_0_cnt+out_type_1_cnt+out_type_2_cnt)*out_type_2_ratio as risk_propagation,
    {' + '.join(f'abs(out_type_{t}_ratio-in_type_{t}_ratio)' for t in range(3))} as type_imbalance from ratios"""))
