"""Clustering, anomaly and mixed-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions.linear import gaussian
from ringsight.operators import anomaly, cluster, mixed, spectral
from ringsight.registry.base import EDGES, NODES, UND, Registry, div, settle, settled
from ringsight.registry.features import graph_query
from ringsight.registry.spectra import FS, SCALED, UDEG, mean, pstd
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
BASE = [EDGES, NODES, UND, UDEG]
DEG = "deg as (select node_id, coalesce(d,0) as d from nodes left join udeg on udeg.node = node_id)"


def scaled(op):
    def run(spark, folder):
        graph = spectral.scaled(order_graph(spark, folder))
        return settle(op(graph))

    return run


def on_scaled(op):
    return scaled(lambda g: op(g.features(), g.feature_names))


def raw(op):
    def run(spark, folder):
        graph = order_graph(spark, folder)
        return settle(op(graph.features(), graph.feature_names))

    return run


def segments(graph):
    """The market segment as a given clustering."""
    return graph.nodes.select("node_id", F.col("f2").cast("int").alias("cluster"))


CL = "cl as (select node_id, f2::int as cluster from nodes)"


def kmeans_query(k, what):
    def op(graph):
        rows, names, prefix = graph.features(), graph.feature_names, f"kmeans_{k}"
        placed = cluster.nearest_centres(rows, names, cluster.kmeans_centres(rows, names, k), prefix)
        return placed.select("node_id", *[f"{prefix}_{w}" for w in what])

    return scaled(op)


for k in (5, 10, 20):
    R.add(f"k1_kmeans_labels_{k}", kmeans_query(k, ["cluster"]))
R.add("k2_centre_distances", kmeans_query(5, ["min_dist", "nearest_cluster", "second_min_dist"]))
R.add("k3_cluster_size", graph_query(lambda g: cluster.cluster_size(segments(g), "kmeans_5")), settled([NODES, CL], """
  select node_id, count(*) over (partition by cluster) as kmeans_5_cluster_size,
   count(*) over (partition by cluster)/count(*) over () as kmeans_5_cluster_size_norm from cl"""))
DIST2 = "+".join(f"(a.{c}-b.{c})**2" for c in FS)
R.add("k4_cluster_density", scaled(lambda g: cluster.cluster_density(
    g.features(), g.feature_names, segments_of_scaled(g), "kmeans_5")), settled([NODES, CL, SCALED, "pts as (select * from scaled join cl using (node_id))"], f"""
  select node_id, d as kmeans_5_cluster_density from cl join (select a.cluster, sqrt(avg({DIST2})) as d from pts a join pts b
   on a.cluster = b.cluster and a.node_id < b.node_id group by a.cluster) using (cluster)"""))


def segments_of_scaled(graph):
    """The segment from the scaled column: its sign order is the segment order."""
    ranks = graph.nodes.select("f2").distinct().agg(F.array_sort(F.collect_set("f2"))).scalar()
    return graph.nodes.select("node_id", (F.array_position(ranks, F.col("f2")) - 1).cast("int").alias("cluster"))


R.add("k5_silhouette", scaled(lambda g: cluster.silhouette(g.features(), g.feature_names, segments_of_scaled(g), "kmeans_5")), settled(
    [NODES, CL, SCALED, "pts as (select * from scaled join cl using (node_id))",
     f"avgs as (select a.node_id, b.cluster, a.cluster as own, sum({DIST2})/(case when a.cluster = b.cluster then count(*)-1 else count(*) end) as d from pts a, pts b group by 1, 2, 3)",
     "ab as (select node_id, max(d) filter (cluster = own) as a, min(d) filter (cluster <> own) as b from avgs group by node_id)"],
    f"select node_id, {div('b-a', 'greatest(a,b)')} as kmeans_5_silhouette from ab"))
R.add("k6_neighbour_cluster", graph_query(lambda g: cluster.neighbour_cluster(g, segments(g), "kmeans_5_cluster")), settled(BASE + [CL,
    "cnt as (select u.node, o.cluster as own, c.cluster as other, count(*) as n from und u join cl o on o.node_id = u.node join cl c on c.node_id = u.nbr group by 1, 2, 3)",
    "shares as (select *, n/sum(n) over (partition by node) as p from cnt)"], """
  select node_id, s.* exclude (node) from nodes left join (select node, sum(case when own = other then p else 0 end) as kmeans_5_cluster_neighbor_consistency,
   -sum(p*ln(p))/ln((select count(distinct cluster) from cl)) as kmeans_5_cluster_neighbor_cluster_entropy, max(p) as kmeans_5_cluster_neighbor_dominant_ratio
   from shares group by node) s on s.node = node_id"""))
R.add("k7_inter_cluster", graph_query(lambda g: cluster.inter_cluster(g, segments(g))), settled(BASE + [CL,
    "ends2 as (select u.node, o.cluster as own, c.cluster as other from und u join cl o on o.node_id = u.node join cl c on c.node_id = u.nbr)"], """
  select node_id, s.* exclude (node) from nodes left join (select node, count(*) filter (own=other) as inter_cluster_intra_edges, count(*) filter (own<>other) as inter_cluster_inter_edges,
   count(*) filter (own=other)/count(*) as inter_cluster_intra_ratio, count(*) filter (own<>other)/count(*) as inter_cluster_inter_ratio,
   count(*) filter (own=other)/(any_value(size)-1) as inter_cluster_cluster_degree, count(distinct other) as inter_cluster_cluster_bridging,
   count(distinct other)/(select count(distinct cluster) from cl) as inter_cluster_cluster_bridging_norm
   from ends2 join (select cluster, count(*) as size from cl group by cluster) z on z.cluster = own group by node) s on s.node = node_id"""))
BANDED = ["cuts as (select quantile_cont(d, [0.25,0.5,0.75,0.9]) as q from deg)", "banded as (select n.*, (d > q[1])::int+(d > q[2])::int+(d > q[3])::int+(d > q[4])::int as band from nodes n join deg using (node_id), cuts)"]
R.add("k8_degree_cluster", graph_query(cluster.degree_cluster), settled(BASE + [DEG] + BANDED, "select node_id, band as degree_cluster_degree_cluster, " + ", ".join(
    f"abs(f{i} - (select avg(f{i}) from banded where band = {b})) as degree_cluster_degree_cluster_{b}_feat{i}_dist" for b in range(5) for i in range(10)) + " from banded"))

# --- anomaly --------------------------------------------------------------------------------------
R.add("o1_isolation_forest", on_scaled(anomaly.isolation_forest))
R.add("o2_lof", on_scaled(anomaly.local_outlier_factor), settled([NODES, SCALED,
    f"near as (select a.node_id as i, b.node_id as j, sqrt({DIST2}) as d from scaled a join scaled b on a.node_id <> b.node_id qualify row_number() over (partition by a.node_id order by d, b.node_id) <= 20)",
    "kth as (select i, max(d) as kd from near group by i)",
    "dense as (select n.i, 1/(avg(greatest(d, kd))+1e-10) as lrd from near n join kth k on k.i = n.j group by n.i)",
    "factor as (select n.i, avg(o.lrd)/any_value(m.lrd) as f from near n join dense o on o.i = n.j join dense m on m.i = n.i group by n.i)"],
    "select i as node_id, (f-min(f) over ())/(max(f) over ()-min(f) over ()+1e-8) as lof_score from factor"))
R.add("o3_mahalanobis", on_scaled(anomaly.mahalanobis))
Z = [f"{div(f'abs(f{i}-avg(f{i}) over ())', f'stddev_pop(f{i}) over ()')}" for i in range(10)]
ZED = "zed as (select node_id, " + ", ".join(f"{z} as z{i}" for i, z in enumerate(Z)) + " from nodes)"
ZS = [f"z{i}" for i in range(10)]
STAT = f"greatest({','.join(ZS)}) as stat_max_zscore, {mean(ZS)} as stat_mean_zscore, {mean([f'({z} > 3)::int' for z in ZS])} as stat_zscore_gt3_ratio"
R.add("o4_stat_zscore", raw(anomaly.stat_zscore), settled([NODES, ZED], f"select node_id, {STAT} from zed"))
QS = "qs as (select " + ", ".join(f"quantile_cont(f{i}, [0.25,0.75]) as q{i}" for i in range(10)) + " from nodes)"
OVER = ["case when q{i}[2] > q{i}[1] then greatest(q{i}[1]-1.5*(q{i}[2]-q{i}[1])-f{i}, f{i}-q{i}[2]-1.5*(q{i}[2]-q{i}[1]), 0)/(q{i}[2]-q{i}[1]) else 0 end".format(i=i) for i in range(10)]
R.add("o5_iqr_outlier", raw(anomaly.iqr_outlier), settled([NODES, QS], f"select node_id, greatest({', '.join(OVER)}) as stat_max_iqr_outlier from nodes, qs"))
MO = "mo as (select " + ", ".join(f"avg(f{i}) as m{i}, stddev_pop(f{i}) as s{i}" for i in range(10)) + " from nodes)"
R.add("o6_column_moments", raw(anomaly.column_moments), settled([NODES, MO, "mm as (select " + ", ".join(
    f"abs(avg(((f{i}-m{i})/s{i})**3)) as k3_{i}, abs(avg(((f{i}-m{i})/s{i})**4)-3) as k4_{i}" for i in range(10)) + " from nodes, mo)"],
    "select node_id, " + ", ".join(f"k3_{i} as stat_feat{i}_skewness_abs, k4_{i} as stat_feat{i}_kurtosis_abs" for i in range(10)) + " from nodes, mm"))
PAIRS = [(i, j) for i in range(10) for j in range(i + 1, 10)]
R.add("o7_product_zscore", raw(anomaly.product_zscore), settled([NODES], "select node_id, " + ", ".join(
    f"abs(f{i}*f{j}-avg(f{i}*f{j}) over ())/(stddev_pop(f{i}*f{j}) over ()+1e-8) as stat_product_{i}_{j}_zscore" for i, j in PAIRS) + " from nodes"))
DZ = f"{div('abs(d-avg(d) over ())', 'stddev_pop(d) over ()')} as graph_degree_zscore, {div('abs(ln(1+d)-avg(ln(1+d)) over ())', 'stddev_pop(ln(1+d)) over ()')} as graph_degree_log_zscore"
R.add("o8_degree_zscore", graph_query(anomaly.degree_zscore), settled(BASE + [DEG], f"select node_id, {DZ} from deg"))
R.add("o9_nbr_feature_diff", graph_query(anomaly.neighbour_feature_diff), settled(BASE + [
    "nm as (select u.node, " + ", ".join(f"avg(f{i}) as m{i}, stddev_pop(f{i}) as s{i}" for i in range(10)) + " from und u join nodes v on v.node_id = u.nbr group by u.node)",
    "df as (select node_id, coalesce(sqrt(" + "+".join(f"(f{i}-m{i})**2" for i in range(10)) + "),0) as d, coalesce((" + "+".join(f"s{i}" for i in range(10)) + ")/10.0,0) as s from nodes left join nm on nm.node = node_id)"],
    f"select node_id, {div('d', 'max(d) over ()')} as graph_neighbor_feature_diff, {div('s', 'max(s) over ()')} as graph_neighbor_feature_std from df"))
R.add("o10_bridging", graph_query(anomaly.bridging), settled(BASE + [DEG], "select node_id, 1-d/max(d) over () as graph_bridging_score from deg"))
SC = ["stat_max_zscore", "stat_mean_zscore", "stat_zscore_gt3_ratio", "stat_max_iqr_outlier", *[f"stat_product_{i}_{j}_zscore" for i, j in PAIRS],
      "graph_degree_zscore", "graph_degree_log_zscore", "graph_bridging_score"]
SUM = "(" + "+".join(SC) + "+1e-8)"
R.add("o11_combined", graph_query(lambda g: anomaly.combined_anomaly(anomaly.column_scores(g))), settled(BASE + [DEG, ZED, QS, "sc as (select n.node_id, " + STAT
    + f", greatest({', '.join(OVER)}) as stat_max_iqr_outlier, " + ", ".join(f"abs(f{i}*f{j}-avg(f{i}*f{j}) over ())/(stddev_pop(f{i}*f{j}) over ()+1e-8) as stat_product_{i}_{j}_zscore" for i, j in PAIRS)
    + f", {DZ}, 1-d/max(d) over () as graph_bridging_score from nodes n join zed using (node_id) join deg using (node_id), qs)"], f"""
  select node_id, {mean(SC)} as combined_mean_anomaly_score, greatest({','.join(SC)}) as combined_max_anomaly_score, {pstd(SC)} as combined_anomaly_score_std,
   -({'+'.join(f'{c}/{SUM}*ln({c}/{SUM}+1e-8)' for c in SC)}) as combined_anomaly_score_entropy, {'+'.join(f'({c} > 0.5)::int' for c in SC)} as combined_anomaly_vote_count,
   ({'+'.join(f'({c} > 0.5)::int' for c in SC)})/{len(SC)}.0 as combined_anomaly_vote_ratio from sc"""))

# --- mixed ----------------------------------------------------------------------------------------
TERMS = [f"f{i}" for i in range(10)] + [f"f{i}*f{j}" for i in range(10) for j in range(i + 1, 10)]
R.add("x1_polynomial", on_scaled(mixed.polynomial), settled([NODES, SCALED], "select node_id, " + ", ".join(
    f"{t} as poly_feat_{i}" for i, t in enumerate(TERMS)) + " from scaled"))
R.add("x2_pca", on_scaled(mixed.pca_components))
R.add("x3_ica", on_scaled(lambda rows, names: mixed.ica_components(rows, names, k=5, iterations=30)))
G = gaussian(10, 10) / 10**0.5
R.add("x4_random_projection", on_scaled(mixed.random_projection), settled([NODES, SCALED], "select node_id, " + ", ".join(
    "+".join(f"f{j}*({float(G[j, i])!r})" for j in range(10)) + f" as random_proj_{i}" for i in range(10)) + " from scaled"))
CORR = "cc as (select " + ", ".join(f"abs(corr(f{i}, f{j})) as c{i}_{j}" for i in range(10) for j in range(i + 1, 10)) + ", " + mean([f"var_pop(f{i})" for i in range(10)]) + " as v from scaled)"
CS = [f"coalesce(c{i}_{j},0)" for i in range(10) for j in range(i + 1, 10)]
R.add("x5_selection_scores", on_scaled(mixed.selection_scores), settled([NODES, SCALED, CORR], f"""
  select node_id, v as feature_variance_score, 2*({'+'.join(CS)})/100.0 as feature_avg_correlation, greatest({','.join(CS)}) as feature_max_correlation from nodes, cc"""))
U = "cast(('0x' || substr(md5(concat_ws('|','42','{r}',cast(node_id as varchar))), 1, 8)) as bigint)/4294967296.0"
BOOT = "boot as (select *, " + ", ".join("+".join(f"({U.format(r=r)} > {p!r})::int" for p in mixed.POISSON) + f" as w{r}" for r in range(5)) + " from scaled)"
VARS = "vars as (select " + ", ".join(f"sum(w{r}*f{i}*f{i})/sum(w{r}) - (sum(w{r}*f{i})/sum(w{r}))**2 as v{i}_{r}" for i in range(10) for r in range(5)) + " from boot)"
R.add("x6_bootstrap_stability", on_scaled(mixed.bootstrap_stability), settled([NODES, SCALED, BOOT, VARS],
      "select node_id, (" + "+".join(f"1/({pstd([f'v{i}_{r}' for r in range(5)])}+1e-8)" for i in range(10)) + ")/10.0 as feature_stability_score from nodes, vars"))
R.add("x7_pseudo_importance", on_scaled(mixed.pseudo_importance))
MEAN = mean(FS)
SIZES = [f"abs({c})" for c in FS]
L1S = "(" + "+".join(SIZES) + "+1e-8)"


def power(p):
    return mean([f"({c}-{MEAN})**{p}" for c in FS])


R.add("x8_row_stats", on_scaled(mixed.row_stats), settled([NODES, SCALED], f"""
  select node_id, {'+'.join(SIZES)} as feature_l1_norm, sqrt({'+'.join(f'{c}*{c}' for c in FS)}) as feature_l2_norm, greatest({','.join(FS)}) as feature_max,
   least({','.join(FS)}) as feature_min, greatest({','.join(FS)})-least({','.join(FS)}) as feature_range, {MEAN} as feature_mean, {pstd(FS)} as feature_std,
   {power(3)}/({power(2)})**1.5 as feature_skewness, {power(4)}/({power(2)})**2-3 as feature_kurtosis,
   -({'+'.join(f'{s}/{L1S}*ln({s}/{L1S}+1e-8)' for s in SIZES)}) as feature_entropy,
   1-2*({'+'.join(f'o[{i + 1}]*{10 - i}' for i in range(10))})/10.0/{L1S} as feature_gini from (select *, list_sort([{','.join(SIZES)}]) as o from scaled)"""))
R.add("x9_complexity", on_scaled(mixed.complexity))
