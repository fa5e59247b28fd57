"""Column-wise features and neighbour aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import columns, neighbours
from ringsight.registry.base import EDGES, NODES, UND, Registry, div, settle, settled
from ringsight.registry.features import graph_query
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
F10 = range(10)
BASE = [EDGES, NODES]


def matrix(op):
    return lambda spark, folder: settle(op(order_graph(spark, folder).features()))


def per_column(form: str, suffix: str, count=F10) -> str:
    return "select node_id, " + ", ".join(
        f"{form.format(x=f'f{i}')} as feature_{i}_{suffix}" for i in count) + " from nodes"


R.add("c1_log_shift", matrix(columns.log_shift), settled([NODES], per_column(
    "case when min({x}) over () <= 0 then ln(1 + {x} - min({x}) over () + 1e-6) else ln(1+{x}) end", "log")))
R.add("c2_sqrt_clip", matrix(columns.sqrt_clip), settled([NODES], per_column("sqrt(greatest({x}, 0))", "sqrt")))
DECILES = "[" + ",".join(str(i / 10) for i in range(1, 10)) + "]"
R.add("c3_decile_bucket", matrix(columns.decile_bucket), settled(
    [NODES, "q as (select " + ", ".join(f"quantile_cont(f{i}, {DECILES}) as q{i} from_" .replace(" from_", "") for i in F10) + " from nodes)"],
    "select node_id, " + ", ".join(f"len(list_filter(q{i}, lambda e: f{i} >= e)) as feature_{i}_bucket" for i in F10) + " from nodes, q"))
R.add("c4_zscore", matrix(columns.zscore), settled([NODES], per_column(
    "({x} - avg({x}) over ())/(stddev_pop({x}) over () + 1e-8)", "standardized")))
R.add("c5_minmax", matrix(columns.minmax), settled([NODES], per_column(
    "({x} - min({x}) over ())/(case when max({x}) over () = min({x}) over () then 1 else max({x}) over () - min({x}) over () end)", "normalized")))
R.add("c6_interactions", matrix(columns.interactions), settled([NODES], "select node_id, " + ", ".join(
    f"f{i}*f{j} as interaction_{i}_{j}" for i in F10 for j in (i + 1, i + 2) if j < 10) + " from nodes"))
R.add("c7_poly2", matrix(columns.poly2), settled([NODES], per_column("{x}*{x}", "poly2")))
R.add("c8_rank_pct", matrix(columns.rank_pct), settled([NODES], per_column(
    "(rank() over (order by {x}) + (count(*) over (partition by {x}) - 1)/2.0)/(select count(*) from nodes)", "rank")))

STEPS = "[0,0.2,0.4,0.6,0.8,1]"
BIN_CTES = [
    "e0 as (select " + ", ".join(f"list_sort(list_distinct(quantile_cont(f{i}, {STEPS}))) as e{i}" for i in F10) + " from nodes)",
    "bins as (select node_id, " + ", ".join(
        f"len(list_filter(e{i}[2:len(e{i})-1], lambda e: f{i} >= e)) as bin_{i}" for i in F10) + " from nodes, e0)",
]
R.add("c9_kbins", matrix(columns.kbins), settled([NODES] + BIN_CTES, "select * from bins"))


def fitted_on_train(spark, folder):
    nodes = order_graph(spark, folder)
    names = nodes.feature_names
    fitted = columns.fit_bins(nodes.nodes.where("split = 'train'").select("node_id", *names), strategy="uniform")
    return settle(columns.apply_bins(nodes.nodes.where("split <> 'train'").select("node_id", *names), fitted))


UNIFORM = ", ".join("list_sort(list_distinct([" + ",".join(
    f"min(f{i})+(max(f{i})-min(f{i}))*{s}" for s in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) + f"])) as e{i}" for i in F10)
R.add("c9_kbins_uniform_fit_apply", fitted_on_train, settled(
    [NODES, f"e0 as (select {UNIFORM} from nodes where split = 'train')"], "select node_id, " + ", ".join(
        f"len(list_filter(e{i}[2:len(e{i})-1], lambda e: f{i} >= e)) as bin_{i}" for i in F10)
    + " from nodes, e0 where split <> 'train'"))


def supervised(spark, folder):
    graph = order_graph(spark, folder)
    nodes = graph.nodes.withColumn("fraud", (F.col("label") == 1).cast("int"))
    return settle(columns.supervised_bins(nodes, "fraud", graph.feature_names, F.col("split") == "train"))


R.add("c10_supervised_bins", supervised)
R.add("p15_winsorize", matrix(columns.winsorize), settled(
    [NODES, "q as (select " + ", ".join(f"quantile_cont(f{i}, [0.01,0.99]) as q{i}" for i in F10) + " from nodes)"],
    "select node_id, " + ", ".join(f"least(greatest(f{i}, q{i}[1]), q{i}[2]) as f{i}" for i in F10) + " from nodes, q"))
R.add("p19_outlier_to_null", matrix(columns.outlier_to_null), settled([NODES], "select node_id, " + ", ".join(
    f"case when abs(f{i}) > 1e6 then null else f{i} end as f{i}" for i in F10) + " from nodes"))

# --- neighbour aggregation --------------------------------------------------------------------
PAIR_HASH = "md5(concat_ws('|','42',cast(node as varchar),cast(nbr as varchar)))"
NBR_HASH = "md5(concat_ws('|','42',cast(nbr as varchar)))"
HOW = (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop"), ("sum", "sum"))


def near(source, k=None, name="near"):
    if k is None:
        return f"{name} as (select node, nbr from {source})"
    return (f"{name} as (select node, nbr from (select *, row_number() over (partition by node order by {PAIR_HASH}, nbr) as rk "
            f"from {source}) where rk <= {k})")


def grouped(ctes, aggs, pairs, values="nodes", key="node_id"):
    return settled(ctes, f"select n.node_id, s.* exclude (node) from nodes n left join (select p.node, {aggs} from {pairs} p "
                         f"join {values} v on v.{key} = p.nbr group by p.node) s on s.node = n.node_id")


UNDS = BASE + [UND]
R.add("a1_nbr_agg_1hop", graph_query(neighbours.one_hop), grouped(UNDS + [near("und")], ", ".join(
    f"{h}(f{i}) as orig_n1_{s}_feat{i}" for i in F10 for s, h in HOW), "near"))
HOP2 = "hop2 as (select distinct a.node, b.nbr from und a join und b on a.nbr = b.node)"
FIRST = "picked as (select node, nbr from (select *, row_number() over (partition by node order by {h}, nbr) as rk from {t}) where rk <= {k})"
R.add("a2_nbr_agg_2hop", graph_query(neighbours.two_hop_features), grouped(
    UNDS + [HOP2], ", ".join(f"{h}(f{i}) as orig_n2_{s}_feat{i}" for i in F10 for s, h in HOW), "hop2"))
BEYOND = ("hop2 as (select distinct a.node, b.nbr from near a join {src} b on a.nbr = b.node where a.node <> b.nbr "
          "and not exists (select 1 from near c where c.node = a.node and c.nbr = b.nbr))")
R.add("a2_nbr_agg_2hop_exclusive", graph_query(neighbours.exclusive_two_hop_features), grouped(
    UNDS + [near("und"), BEYOND.format(src="und")], ", ".join(f"avg(f{i}) as orig_n2_mean_feat{i}" for i in F10), "hop2"))
R.add("a2_nbr_agg_2hop_sampled", graph_query(lambda g: neighbours.two_hop_features(g, k=500, first=5)), grouped(
    UNDS + [HOP2, FIRST.format(h=NBR_HASH, t="hop2", k=500)], ", ".join(
        f"{h}(f{i}) as orig_n2_{s}_feat{i}" for i in range(5) for s, h in HOW), "picked"))
R.add("a2_nbr_agg_2hop_exclusive_sampled", graph_query(lambda g: neighbours.exclusive_two_hop_features(g, 50, 500, 5)), grouped(
    UNDS + [near("und", 50), BEYOND.format(src="und"), FIRST.format(h=NBR_HASH, t="hop2", k=500)], ", ".join(
        f"avg(f{i}) as orig_n2_mean_feat{i}" for i in range(5)), "picked"))
UDEG = "udeg as (select node, count(*) as d from und group by node)"
R.add("a3_degree_correlation", graph_query(neighbours.degree_correlation), settled(UNDS + [UDEG], "select node_id, " + ", ".join(
    f"coalesce(m{i}, f{i})*coalesce(dm,0) as orig_feat{i}_degree_corr, f{i}-coalesce(dm,0) as orig_feat{i}_degree_diff, "
    f"f{i}/(coalesce(dm,0)+1e-8) as orig_feat{i}_feat_degree_ratio" for i in F10)
    + " from nodes left join (select u.node, avg(d) as dm, " + ", ".join(f"avg(f{i}) as m{i}" for i in F10)
    + " from und u join udeg g on g.node = u.nbr join nodes v on v.node_id = u.nbr group by u.node) s on s.node = node_id"))
MOM = ("near_means as (select p.node, count(*) as n, " + ", ".join(f"avg(f{i}) as m{i}" for i in F10)
       + " from near p join nodes v on v.node_id = p.nbr group by p.node)")
R.add("a4_nbr_distribution", graph_query(neighbours.neighbour_distribution), settled(
    UNDS + [near("und"), MOM], "select k.node_id, s.* exclude (node) from nodes k left join (select p.node, " + ", ".join(
        f"case when max(n) >= 3 and max(f{i}) > min(f{i}) then avg((f{i}-m{i})**3)/(avg((f{i}-m{i})**2)**1.5) else 0 end as orig_feat{i}_neighbor_skew, "
        f"case when max(n) >= 3 and max(f{i}) > min(f{i}) then avg((f{i}-m{i})**4)/(avg((f{i}-m{i})**2)**2)-3 else 0 end as orig_feat{i}_neighbor_kurt, "
        f"case when max(n) >= 3 then quantile_cont(f{i},0.75)-quantile_cont(f{i},0.25) else 0 end as orig_feat{i}_neighbor_iqr"
        for i in F10) + " from near p join near_means using (node) join nodes v on v.node_id = p.nbr group by p.node) s on s.node = k.node_id"))
INS = "ins as (select distinct dst as node, src as nbr from edges)"
OUTS = "outs as (select distinct src as node, dst as nbr from edges)"
R.add("a5_in_out_difference", graph_query(neighbours.in_out_difference), settled(
    BASE + [INS, OUTS, near("ins", name="near_in"), near("outs", name="near_out")] + [
        f"means_{d} as (select p.node, " + ", ".join(f"avg(f{i}) as {d}{i}" for i in F10)
        + f" from near_{d} p join nodes v on v.node_id = p.nbr group by p.node)" for d in ("in", "out")],
    "select node_id, " + ", ".join(
        f"coalesce(in{i},f{i})-coalesce(out{i},f{i}) as orig_feat{i}_in_out_diff, "
        f"coalesce(in{i},f{i})/(coalesce(out{i},f{i})+1e-8) as orig_feat{i}_in_out_ratio" for i in F10)
    + " from nodes left join means_in a on a.node = node_id left join means_out b on b.node = node_id"))

BINS = UNDS + BIN_CTES
A6 = ", ".join(f"{h}(bin_{i}) as bin_n1_{s}_feat{i}" for i in F10 for s, h in HOW + (("count", "count"),))
R.add("a6_bin_nbr_agg", graph_query(neighbours.bin_one_hop), grouped(BINS + [near("und")], A6, "near", "bins"))
CELL = "count(*) filter (bin_{i}={b})/count(*)::double"
ENT = "case when count(*) < 2 then 0 else " + " + ".join(
    "(case when count(*) filter (bin_{i}=" + str(b) + ") > 0 then -(count(*) filter (bin_{i}=" + str(b)
    + ")/count(*)::double)*ln(count(*) filter (bin_{i}=" + str(b) + ")/count(*)::double + 1e-10) else 0 end)" for b in range(5)) + " end"
MODE = "case " + " ".join(
    "when count(*) filter (bin_{i}=" + str(b) + ") >= greatest(" + ",".join("count(*) filter (bin_{i}=" + str(c) + ")" for c in range(5))
    + f") then {b}" for b in range(5)) + " end"
R.add("a7_bin_distribution", graph_query(neighbours.bin_distribution), grouped(BINS, ", ".join(
    ", ".join(CELL.format(i=i, b=b) + f" as bin_n1_box{b}_ratio_feat{i}" for b in range(5))
    + ", " + MODE.format(i=i) + f" as bin_n1_mode_feat{i}, " + ENT.format(i=i) + f" as bin_n1_entropy_feat{i}"
    for i in F10), "und", "bins"))
MS = ",".join(f"bin_n1_mean_feat{i}" for i in F10)
R.add("a8_bin_cross_feature", graph_query(neighbours.bin_cross_feature), settled(
    BINS + [near("und"), f"agg as (select p.node, {A6} from near p join bins v on v.node_id = p.nbr group by p.node)"], f"""
  select node_id, ({MS.replace(',', '+')})/10.0 as bin_all_mean, ({'+'.join(f'bin_n1_std_feat{i}' for i in F10)})/10.0 as bin_all_std,
   greatest({MS}) as bin_all_max, least({MS}) as bin_all_min, greatest({MS})-least({MS}) as bin_all_range
  from nodes left join agg on agg.node = node_id"""))


def grouped_mean(spark, folder):
    graph = order_graph(spark, folder)
    scores = graph.nodes.select("node_id", (F.col("f9") / (F.col("f3") + 1)).alias("p"))
    return settle(neighbours.grouped_neighbour_mean(graph, scores))


R.add("a9_grouped_nbr_mean", grouped_mean, grouped(
    BASE + ["scores as (select *, f9/(f3+1) as p from nodes)", "ins as (select dst as node, src as nbr from edges)"], ", ".join(
        f"coalesce(sum(f{i}) filter ({c}),0)/(count(*) filter ({c})+1e-8) as {g}_group_mean_feat{i}"
        for g, c in (("low", "p <= 0.3"), ("high", "p > 0.7")) for i in F10), "ins", "scores"))

RISKS = BASE + [INS, """base as (select n.node_id, coalesce(d,0) as degree, coalesce(r,0) as riskstat from nodes n
  left join (select dst, count(*) as d from edges group by dst) a on a.dst = n.node_id
  left join (select p.src, count(*) as r from (select distinct src, dst from edges) p join nodes q on q.node_id = p.dst
    where q.label = 1 and q.split = 'train' group by p.src) b on b.src = n.node_id)"""]
RISK_OUT = "select node_id, " + ", ".join(
    f"({c} - avg({c}) over ())/(case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end) as \"{c}\""
    for c in ("degree", "riskstat", '"1hop_degree"', '"2hop_degree"', '"1hop_riskstat"', '"2hop_riskstat"')).replace('""', '"') + """
  from (select b.*, coalesce(o.d,0) as "1hop_degree", coalesce(t.d,0) as "2hop_degree", coalesce(o.r,0) as "1hop_riskstat",
   coalesce(t.r,0) as "2hop_riskstat" from base b
   left join (select p.node, sum(degree) as d, sum(riskstat) as r from {one} p join base q on q.node_id = p.nbr group by p.node) o on o.node = b.node_id
   left join (select p.node, sum(degree) as d, sum(riskstat) as r from {two} p join base q on q.node_id = p.nbr group by p.node) t on t.node = b.node_id)"""
TWO_IN = ("hop2 as (select distinct a.node, b.nbr from ins a join ins b on a.nbr = b.node where a.node <> b.nbr "
          "and not exists (select 1 from ins c where c.node = a.node and c.nbr = b.nbr))")
R.add("a10_riskstat", graph_query(neighbours.riskstat), settled(RISKS + [TWO_IN], RISK_OUT.format(one="ins", two="hop2")))
R.add("a11_riskstat_sampled", graph_query(lambda g: neighbours.riskstat_sampled(g, 20, 50)), settled(
    RISKS + [near("ins", 20), BEYOND.format(src="ins"), FIRST.format(h=NBR_HASH, t="hop2", k=50)],
    RISK_OUT.format(one="near", two="picked")))

SUMMARY = "count(*) as pairs, sum(nbr) as nbr_sum, min(nbr) as nbr_min, max(nbr) as nbr_max"


def summary(pairs, *keys):
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("nbr").alias("nbr_sum"), F.min("nbr").alias("nbr_min"), F.max("nbr").alias("nbr_max"))


def khood(k, where, risk=False):
    return lambda spark, folder: summary(neighbours.k_neighbours(order_graph(spark, folder), k, where, risk), "node")


def total_of(pairs, ctes, key="node"):
    sums = SUMMARY.replace("sum(nbr)", "cast(sum(nbr) as bigint)")
    return f"with {', '.join(ctes)} select {key}, {sums} from {pairs} group by {key}"


R.add("a12_k_neighbours_1hop_in", khood(1, "in"), total_of("ins", BASE + [INS]))
R.add("a12_k_neighbours_2hop_in", khood(2, "in"), total_of("hop2", BASE + [INS, TWO_IN]))
R.add("a12_k_neighbours_2hop_out_risk", khood(2, "out", True), total_of(
    "(select * from hop2 where nbr in (select node_id from nodes where label=1 and split='train'))",
    BASE + [OUTS, TWO_IN.replace("ins", "outs")]))
R.add("a13_khop_exclusive", lambda spark, folder: summary(
    neighbours.khop_exclusive(order_graph(spark, folder), 2), "node", "hop"), total_of(
    "(select node_id as node, node_id as nbr, 0 as hop from nodes union all select node, nbr, 1 from simple union all select node, nbr, 2 from hop2)",
    UNDS + ["simple as (select * from und where node <> nbr)", TWO_IN.replace("ins", "simple")], "node, hop"))
R.add("a14_walk_counts", lambda spark, folder: neighbours.walk_counts(order_graph(spark, folder), 2)
      .groupBy("node", "length").agg(F.count(F.lit(1)).alias("ends"), F.sum("walks").alias("walks")),
      f"""with {EDGES}, {OUTS}, w2 as (select a.node, b.nbr, count(*)::double as walks from outs a join outs b on a.nbr = b.node group by 1, 2)
  select node, 1 as length, count(*) as ends, count(*)::double as walks from outs group by node
  union all select node, 2, count(*), sum(walks) from w2 group by node""")
R.add("a15_adjacency_list", lambda spark, folder: neighbours.adjacency_list(order_graph(spark, folder)).select(
    "node", "part", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs")),
    f"""with {EDGES}, {NODES}, {UND} select node, 0 as part, array_to_string(list_sort(list(nbr)), ',') as nbrs from
    (select node, nbr from und union select node_id, node_id from nodes) group by node""")
R.add("a16_edge_list", lambda spark, folder: summary(
    neighbours.edge_list(neighbours.adjacency_list(order_graph(spark, folder))), "node"), total_of(
    "(select node, nbr from und union select node_id, node_id from nodes)", UNDS))


def normalized(spark, folder):
    pairs = order_graph(spark, folder).edges.groupBy(F.col("src").alias("node"), F.col("dst").alias("nbr")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    return settle(neighbours.row_normalize(pairs), ("node", "nbr"))


R.add("a17_row_normalize", normalized, settled(
    [EDGES, "p as (select src as node, dst as nbr, count(*)::double as weight from edges group by 1, 2)"],
    "select *, weight/(sum(weight) over (partition by node) + 0.01) as normalized from p", ("node", "nbr")))
