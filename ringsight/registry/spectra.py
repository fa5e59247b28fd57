"""Spectral, diffusion and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions.linear import gaussian
from ringsight.operators import embed, spectral
from ringsight.registry.aggregation import near
from ringsight.registry.base import EDGES, NODES, UND, Registry, div, settle, settled
from ringsight.registry.features import graph_query
from ringsight.registry.tables import flat
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
FS = [f"f{i}" for i in range(10)]
UDEG = "udeg as (select node, count(*)::double as d from und group by node)"
BASE = [EDGES, NODES, UND, UDEG]


def sym(eps, name="links", source="und", deg="udeg"):
    return (f"{name} as (select u.node, u.nbr, 1/sqrt(a.d+{eps})/sqrt(b.d+{eps}) as w from {source} u join {deg} a on a.node = u.node "
            f"join {deg} b on b.node = u.nbr)")


RW = "links as (select u.node, u.nbr, 1/a.d as w from und u join udeg a on a.node = u.node)"


def step(name, source, cols, links="links", form="coalesce(s.{c},0)", extra=""):
    """A graph step as a CTE: form combines x.{c} (own) and s.{c} (weighted sum over neighbours)."""
    made = ", ".join(f"{form.format(c=c)} as {c}" for c in cols)
    sums = ", ".join(f"sum(w*v.{c}) as {c}" for c in cols)
    return (f"{name} as materialized (select x.node_id, {made}{extra} from {source} x left join (select l.node, {sums} from {links} l "
            f"join {source} v on v.node_id = l.nbr group by l.node) s on s.node = x.node_id)")


LAP = "x.{c} - coalesce(s.{c},0)"


def mean(cols):
    return "((" + "+".join(cols) + f")/{float(len(cols))})"


def pstd(cols):
    m = mean(cols)
    return "sqrt((" + "+".join(f"({c}-{m})**2" for c in cols) + f")/{float(len(cols))})"


SMOOTH = [sym("1e-8"), step("lx", "nodes", FS, form=LAP),
          "sm as (select n.node_id, " + ", ".join(f"n.f{i}*l.f{i} as s{i}" for i in range(10)) + " from nodes n join lx l using (node_id))"]
SC = [f"s{i}" for i in range(10)]
R.add("l1_laplacian_smoothness", graph_query(spectral.laplacian_smoothness), settled(BASE + SMOOTH, f"""
  select node_id, {mean(SC)} as smoothness_mean, greatest({','.join(SC)}) as smoothness_max, {pstd(SC)} as smoothness_std from sm"""))
R.add("l2_neighbour_smoothness_diff", graph_query(spectral.neighbour_smoothness_diff), settled(
    BASE + SMOOTH + [f"mm as (select node_id, {mean(SC)} as m from sm)"], """
  select node_id, d as neighbor_smoothness_diff from nodes left join (select u.node, avg(abs(a.m-b.m)) as d from und u
   join mm a on a.node_id = u.node join mm b on b.node_id = u.nbr group by u.node) s on s.node = node_id"""))

T1 = step("t1", "nodes", FS, form=LAP)
L1 = step("l1", "t1", FS, form=LAP)
T2 = "t2 as (select a.node_id, " + ", ".join(f"2*a.{c} - n.{c} as {c}" for c in FS) + " from l1 a join nodes n using (node_id))"
L2 = step("l2", "t2", FS, form=LAP)
T3 = "t3 as (select a.node_id, " + ", ".join(f"2*a.{c} - n.{c} as {c}" for c in FS) + " from l2 a join t1 n using (node_id))"
LONG = "tall as (" + " union all ".join(
    f"select node_id, {k} as k, {i} as i, f{i} as v from {t}" for k, t in enumerate(("nodes", "t1", "t2", "t3")) for i in range(10)) + ")"
RANKED = ("ranked as (select k, i, row_number() over (order by var_pop(v) desc, k desc, i desc) as r from tall group by k, i)")
R.add("l3_chebyshev", graph_query(spectral.chebyshev), settled(BASE + [RW, T1, L1, T2, L2, T3, LONG, RANKED], "select node_id, " + ", ".join(
    f"max(case when r = {40 - j} then v end) as chebyshev_{j}" for j in range(40)) + " from tall join ranked using (k, i) group by node_id"))

HALF = "(x.{c} + x.{c} - coalesce(s.{c},0))/2"
R.add("l4_spectral_response", graph_query(spectral.spectral_response), settled(BASE + [
    sym("1e-8"), step("hi", "nodes", FS, form=LAP), step("w1", "nodes", FS, form=HALF), step("w2", "w1", FS, form=HALF), step("w3", "w2", FS, form=HALF),
    "sums as (select a.node_id, " + "+".join(f"abs(a.{c})" for c in FS) + " as lo, " + "+".join(f"abs(b.{c})" for c in FS) + " as hi from w3 a join hi b using (node_id))",
    f"shares as (select node_id, {div('lo', 'max(lo) over ()')} as lo, {div('hi', 'max(hi) over ()')} as hi from sums)"],
    "select node_id, lo as low_freq_response, hi as high_freq_response, lo/(hi+1e-8) as spectral_ratio from shares"))
DEG = "deg as (select node_id, coalesce(d,0) as d from nodes left join udeg on udeg.node = node_id)"
R.add("l5_degree_gap", graph_query(spectral.degree_gap), settled(BASE + [
    DEG, "two as (select max(d) as a, min(d) as b from (select d from deg order by d desc limit 2))"], f"""
  select node_id, {div('d', 'max(d) over ()')} * (a-b)/(a+1e-8) as degree_spectral_gap,
   var_pop(d) over () / ((max(d) over ())**2 + 1e-8) as degree_variance_norm,
   {div('ln(1+d) - min(ln(1+d)) over ()', 'max(ln(1+d)) over () - min(ln(1+d)) over ()')} as log_degree_gap from deg, two"""))

R.add("l6_laplacian_eigvecs", graph_query(spectral.laplacian_eigenvectors))
W = gaussian(10, 15)
EIG = ["ev as (select node_id, d, " + ", ".join(
    (f"f{i}" if i < 5 else "+".join(f"f{j}*({float(W[j, i])!r})" for j in range(10))) + f" as e{i}" for i in range(15)) + " from nodes join deg using (node_id))"]
R.add("l7_approx_eigvecs", graph_query(spectral.approximate_eigenvectors), settled(BASE + [DEG] + EIG, "select node_id, d/(max(d) over () + 1e-8) as laplacian_eig_0, "
      "ln(1+d)/(ln(1+max(d) over ()) + 1) as laplacian_eig_1, " + ", ".join(
          div(f"e{i}", f"sqrt(sum(e{i}*e{i}) over ())") + f" as laplacian_eig_{i}" for i in range(2, 15)) + " from ev"))
R.add("l7_fast_laplacian_approx", graph_query(spectral.fast_laplacian_approx), settled(BASE + [
    DEG, "sec as (select u.node, sum(d) as s from und u join udeg e on e.node = u.nbr group by u.node)",
    "deg2 as (select node_id, d, coalesce(s,0) as s from deg left join sec on sec.node = node_id)"],
    "select node_id, d/max(d) over () as laplacian_dim0, ln(1+d)/ln(1+max(d) over ()) as laplacian_dim1, sqrt(d)/sqrt(max(d) over ()) as laplacian_dim2, "
    "d/(sum(d) over () + 1e-8) as laplacian_dim3, s/max(s) over () as laplacian_dim4, " + ", ".join(
        f"{'sin' if i % 2 == 0 else 'cos'}(d*{i / 16!r})*0.5+0.5 as laplacian_dim{i}" for i in range(5, 16)) + " from deg2"))
R.add("l8_degree_pca", graph_query(spectral.degree_pca))

SCALED = "scaled as (select node_id, " + ", ".join(f"(f{i}-avg(f{i}) over ())/(case when stddev_pop(f{i}) over () = 0 then 1 else stddev_pop(f{i}) over () end) as f{i}" for i in range(10)) + " from nodes)"


def scaled_query(op):
    return lambda spark, folder: settle(op(spectral.scaled(order_graph(spark, folder))))


R.add("l1_graph_smoothness", scaled_query(spectral.graph_smoothness), settled(
    BASE + [SCALED, sym("0"), step("lx", "scaled", FS, form=LAP)],
    "select node_id, " + "+".join(f"a.{c}*b.{c}" for c in FS) + " as graph_smoothness from scaled a join lx b using (node_id)"))
R.add("l9_diffusion", scaled_query(spectral.diffusion), settled(
    BASE + [SCALED, RW, step("p1", "scaled", FS), step("p2", "p1", FS)],
    f"select x.node_id, sqrt({'+'.join(f'(a.{c}-x.{c})**2' for c in FS)}) as graph_diffusion_diffusion_change_norm, "
    f"{mean([f'a.{c}' for c in FS])} as graph_diffusion_step1_mean, {pstd([f'a.{c}' for c in FS])} as graph_diffusion_step1_std, "
    f"{mean([f'b.{c}' for c in FS])} as graph_diffusion_step2_mean, {pstd([f'b.{c}' for c in FS])} as graph_diffusion_step2_std "
    "from scaled x join p1 a using (node_id) join p2 b using (node_id)"))
DOT, NA, NB = "+".join(f"a.{c}*b.{c}" for c in FS), "+".join(f"a.{c}*a.{c}" for c in FS), "+".join(f"b.{c}*b.{c}" for c in FS)
R.add("l10_attention", scaled_query(spectral.attention), settled(BASE + [SCALED], f"""
  select node_id, s as graph_attention_attention_score from nodes left join (select u.node, avg(({DOT})/sqrt({NA})/sqrt({NB})) filter (({NB}) > 0 and ({NA}) > 0) as s
   from und u join scaled a on a.node_id = u.node join scaled b on b.node_id = u.nbr group by u.node) t on t.node = node_id"""))

DIRECTED = """indeg as (select dst as node, count(*)::double as d from edges group by dst), links as (select e.dst as node, e.src as nbr,
  1/sqrt(greatest(a.d,1)*coalesce(b.d,1)) as w from edges e join indeg a on a.node = e.dst left join indeg b on b.node = e.src)"""
THETA = spectral.beta_wavelet_coefficients(2)
R.add("l11_beta_wavelet", graph_query(spectral.beta_wavelet), settled([EDGES, NODES, DIRECTED, step("p1", "nodes", FS, form=LAP), step("p2", "p1", FS, form=LAP)],
      "select n.node_id, " + ", ".join(f"{t[0]!r}*n.{c}+({t[1]!r})*a.{c}+({t[2]!r})*b.{c} as wavelet_{i}_{c}" for i, t in enumerate(THETA) for c in FS)
      + " from nodes n join p1 a using (node_id) join p2 b using (node_id)"))
SIMPLE = ["simple as (select * from und where node <> nbr)", "sdeg as (select node, count(*)::double as d from simple group by node)", sym("0", "links", "simple", "sdeg")]
BERN = spectral.bernstein_coefficients(3)
HALFLAP = "(x.{c} - coalesce(s.{c},0))*0.5"
R.add("l12_bernstein_basis", graph_query(spectral.bernstein_basis), settled(
    BASE + SIMPLE + [step("p1", "nodes", FS, form=HALFLAP), step("p2", "p1", FS, form=HALFLAP), step("p3", "p2", FS, form=HALFLAP)],
    "select n.node_id, " + ", ".join(f"({t[0]!r})*n.{c}+({t[1]!r})*a.{c}+({t[2]!r})*b.{c}+({t[3]!r})*e.{c} as bernstein_{i}_{c}" for i, t in enumerate(BERN) for c in FS)
    + " from nodes n join p1 a using (node_id) join p2 b using (node_id) join p3 e using (node_id)"))


def pruned(spark, folder):
    graph = order_graph(spark, folder)
    p = F.col("f9") / (F.col("f3") + 1)
    scores = graph.nodes.select("node_id", (1 - p).alias("p0"), p.alias("p1"))
    return settle(spectral.heterophily_prune(graph, scores, ["p0", "p1"], 0.05), ("edge_id", "src", "dst", "edge_type", "ts"))


R.add("l13_heterophily_prune", pruned, settled([EDGES, NODES, "pred as (select node_id, 1-f9/(f3+1) as p0, f9/(f3+1) as p1 from nodes)",
    "links as (select e.dst as node, e.src as nbr, 1/sqrt(a.d*b.d) as w from edges e join (select src, count(*)::double as d from edges group by src) a "
    "on a.src = e.src join (select dst, count(*)::double as d from edges group by dst) b on b.dst = e.dst)", step("ly", "pred", ["p0", "p1"], form=LAP)], """
  select edge_id, src, dst, edge_type, ts, score from (select e.*, a.p0*b.p0+a.p1*b.p1 as score, row_number() over (order by a.p0*b.p0+a.p1*b.p1, edge_id, src, dst, edge_type, ts) - 1 as pos
   from edges e join ly a on a.node_id = src join ly b on b.node_id = dst) where pos >= floor(0.05*(select count(*) from edges))""", ("edge_id", "src", "dst", "edge_type", "ts")))
R.add("l14_heterophily_stats", lambda spark, folder: settle(spectral.heterophily_stats(order_graph(spark, folder)), ()), flat([EDGES, NODES], """
  select avg((a.label<>b.label)::int) as heterophily, avg((a.label<>b.label)::int) filter (a.label=0) as heterophily_normal,
   avg((a.label<>b.label)::int) filter (a.label=1) as heterophily_anomaly from edges join nodes a on a.node_id = src join nodes b on b.node_id = dst"""))
R.add("l15_ppr_augment", lambda spark, folder: settle(spectral.ppr_augment(order_graph(spark, folder), steps=4), ("src", "dst")))

# --- embeddings ----------------------------------------------------------------------------------
R.add("e1_adjacency_svd", graph_query(lambda g: embed.adjacency_svd(g, k=16)))


def unit_sql(ctes, inner, names):
    norm = "sqrt(" + "+".join(f"{c}*{c}" for c in names) + ") + 1e-8"
    return settled(ctes, "select node_id, " + ", ".join(f"{c}/({norm}) as {c}" for c in names) + f" from ({inner})")


G2 = gaussian(10, 22)
FE = [f"feature_embedding_dim{i}" for i in range(32)]
R.add("e2_feature_embedding", graph_query(embed.feature_embedding), unit_sql([NODES], "select node_id, " + ", ".join(
    (f"f{i}" if i < 10 else "+".join(f"f{j}*({float(G2[j, i - 10])!r})" for j in range(10))) + f" as {c}" for i, c in enumerate(FE)) + " from nodes", FE))
R.add("e2_feature_embedding_pca", graph_query(lambda g: embed.feature_embedding(g, dim=6)))
G3 = gaussian(6, 16)
DE = [f"degree_embedding_dim{i}" for i in range(16)]
SHAPES = ["deg as (select node_id, coalesce(d,0) as d from nodes left join udeg on udeg.node = node_id)", """shapes as (select node_id, d/max(d) over () as g0,
  ln(1+d)/(ln(1+max(d) over ())+1) as g1, sqrt(d)/(sqrt(max(d) over ())+1) as g2, d/count(*) over () as g3, (row_number() over (order by d, node_id)-1)/count(*) over () as g4,
  (rank() over (order by d)-1)/count(*) over () as g5 from deg)"""]
R.add("e3_degree_embedding", graph_query(embed.degree_embedding), unit_sql(BASE + SHAPES, "select node_id, " + ", ".join(
    "+".join(f"g{j}*({float(G3[j, i])!r})" for j in range(6)) + f" as {c}" for i, c in enumerate(DE)) + " from shapes", DE))
G4 = gaussian(30, 20)
NE = [f"neighbor_embedding_dim{i}" for i in range(20)]
TRIPLE = [f"n.f{i}" for i in range(10)] + [f"m.m{i}" for i in range(10)] + [f"(n.f{i}-m.m{i})" for i in range(10)]
R.add("e4_neighbour_embedding", graph_query(embed.neighbour_embedding), unit_sql(
    BASE + [near("und"), "mn as (select n.node_id, " + ", ".join(f"coalesce(avg(v.f{i}), any_value(n.f{i})) as m{i}" for i in range(10))
            + " from nodes n left join near p on p.node = n.node_id left join nodes v on v.node_id = p.nbr group by n.node_id)"],
    "select n.node_id, " + ", ".join("+".join(f"{t}*({float(G4[j, i])!r})" for j, t in enumerate(TRIPLE)) + f" as {c}" for i, c in enumerate(NE))
    + " from nodes n join mn m using (node_id)", NE))
R.add("e5_gcn_embedding", graph_query(embed.gcn_embedding))
R.add("e5_gcn_block", graph_query(embed.gcn_block), settled(BASE + [sym("0"), step("px", "nodes", FS)], "select n.node_id, " + ", ".join(
    f"n.{c}, p.{c} as p_{c}, n.{c}*p.{c} as x_{c}, abs(n.{c}-p.{c}) as d_{c}" for c in FS) + " from nodes n join px p using (node_id)"))
WALK = ["numbered as (select *, row_number() over (partition by node order by nbr) - 1 as num, count(*) over (partition by node) as d from und)",
        "walk0 as (select node_id as start, w as walk, node_id as cur from nodes, (select unnest(range(5)) as w))"]
for k in range(1, 7):
    WALK.append(f"""walk{k} as materialized (select x.start, x.walk, n.nbr as cur from walk{k-1} x join numbered n on n.node = x.cur and n.num =
     (cast(('0x' || substr(md5(concat_ws('|','42',cast(x.start as varchar),cast(x.walk as varchar),'{k}')),1,8)) as bigint) % n.d){'' if k == 1 else ' where x.cur <> x.start'})""")
VISITS = "visits as (" + " union all ".join(f"select *, {k} as step from walk{k}" for k in range(1, 7)) + ")"
R.add("e6_random_walk_stats", graph_query(lambda g: embed.random_walk_stats(g, walks=5, length=6)), settled(BASE + WALK + [VISITS], """
  select node_id, rw_return_prob, rw_avg_return_steps, rw_visited_nodes from nodes left join (select start, count(*) filter (cur=start)/5.0 as rw_return_prob,
   avg(step) filter (cur=start) as rw_avg_return_steps, count(distinct cur)/6.0 as rw_visited_nodes from visits group by start) v on v.start = node_id"""))
