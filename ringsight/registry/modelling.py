"""Derived-feature and model queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ringsight.operators import derived, model
from ringsight.registry.base import NODES, Registry, div, settle, settled
from ringsight.registry.spectra import FS, mean, pstd
from ringsight.sources.warehouse import order_graph

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def table(op, columns):
    def run(spark, folder):
        return settle(op(order_graph(spark, folder).features(), columns))

    return run


def near_pairs(cols):
    return [(cols[i], cols[j]) for i in range(min(3, len(cols))) for j in range(i + 1, min(4, len(cols)))]


DEC = "[" + ",".join(str(i / 10) for i in range(1, 10)) + "]"


def power(cols, p):
    return mean([f"({c}-{mean(cols)})**{p}" for c in cols])


X10 = ["f0", "f2", "f3", "f5", "f8", "f9"]
parts = []
for a, b in combinations(X10, 2):
    parts += [f"{a}*{b} as important_product_{a}_{b}", f"{a}/({b}+1e-8) as important_ratio_{a}_over_{b}",
              f"{a}-{b} as important_diff_{a}_minus_{b}", f"abs({a}-{b}) as important_abs_diff_{a}_{b}"]
for c in X10:
    parts += [f"{c}*{c} as {c}_squared", f"{c}*{c}*{c} as {c}_cubed", f"exp({c}/(stddev_pop({c}) over ()+1e-8)) as {c}_exp",
              f"len(list_filter(q_{c}, lambda e: {c} >= e)) as {c}_decile", f"abs({c}-avg({c}) over ())/(stddev_pop({c}) over ()+1e-8) as {c}_zscore_abs"]
parts += [f"{mean(X10)} as important_features_mean", f"{pstd(X10)} as important_features_std", f"greatest({','.join(X10)}) as important_features_max",
          f"least({','.join(X10)}) as important_features_min", f"greatest({','.join(X10)})-least({','.join(X10)}) as important_features_range",
          f"{pstd(X10)}/(abs({mean(X10)})+1e-8) as important_features_cv", f"{power(X10, 3)}/({power(X10, 2)})**1.5 as important_features_skew",
          f"{power(X10, 4)}/({power(X10, 2)})**2-3 as important_features_kurt"]


def quantiles(cols, probs):
    return "q as (select " + ", ".join(f"quantile_cont({c}, {probs}) as q_{c}" for c in cols) + " from nodes)"


R.add("x10_pair_derived", table(derived.pair_derived, X10), settled([NODES, quantiles(X10, DEC)], f"select node_id, {', '.join(parts)} from nodes, q"))

X11 = ["f3", "f5", "f8", "f9"]
S = "+".join(X11)
parts = [f"{mean(X11)} as anomaly_score_mean", f"{pstd(X11)} as anomaly_score_std", f"greatest({','.join(X11)}) as anomaly_score_max",
         f"least({','.join(X11)}) as anomaly_score_min", "+".join(f"({c} > cut)::int" for c in X11) + " as anomaly_vote_count",
         "(" + "+".join(f"({c} > cut)::int" for c in X11) + ")/4.0 as anomaly_vote_ratio",
         mean([f"(row_number() over (order by {c}, node_id)-1)" for c in X11]) + "/4.0 as anomaly_avg_rank",
         "-(" + "+".join(f"{c}/({S}+1e-8)*ln({c}/({S}+1e-8)+1e-8)" for c in X11) + ") as anomaly_entropy",
         mean([f"{a}*{b}" for a, b in combinations(X11, 2)]) + " as anomaly_feature_correlation"]
for a, b in near_pairs(X11):
    parts += [f"{a}*{b} as anomaly_product_{a}_{b}", f"abs({a}-{b}) as anomaly_diff_{a}_{b}", f"2*{a}*{b}/({a}+{b}+1e-8) as anomaly_harmonic_{a}_{b}"]
R.add("x11_anomaly_derived", table(derived.anomaly_derived, X11), settled(
    [NODES, "cut as (select quantile_cont(v, 0.75) as cut from (" + " union all ".join(f"select {c} as v from nodes" for c in X11) + "))"],
    f"select node_id, {', '.join(parts)} from nodes, cut"))

X12 = [f"f{i}" for i in range(6)]
NORM = "sqrt(" + "+".join(f"{c}*{c}" for c in X12) + ")"
MNORM = "sqrt(" + "+".join(f"m_{c}*m_{c}" for c in X12) + ")"
parts = [f"{NORM} as embedding_norm", "+".join(f"abs({c})" for c in X12) + " as embedding_l1_norm",
         div("+".join(f"{c}*m_{c}" for c in X12), f"{NORM}*{MNORM}") + " as embedding_cosine_to_mean", f"{mean(X12)} as embedding_dim_mean",
         f"{pstd(X12)} as embedding_dim_std", f"greatest({','.join(X12)}) as embedding_dim_max", f"least({','.join(X12)}) as embedding_dim_min"]
for a, b in near_pairs(X12):
    parts += [f"{a}*{b} as embedding_dot_{a}_{b}", f"abs({a}-{b}) as embedding_dist_{a}_{b}"]
R.add("x12_embedding_derived", table(derived.embedding_shape, X12), settled(
    [NODES, "m as (select " + ", ".join(f"avg({c}) as m_{c}" for c in X12) + " from nodes)"], f"select node_id, {', '.join(parts)} from nodes, m"))
R.add("x12_embedding_model", table(derived.embedding_model, X12))

X13 = ["f3", "f5", "f6", "f7", "f9"]


def scaled13(c):
    s = f"(stddev_pop({c}) over ())"
    return f"{c}/({s}+1e-8)/(1+({s}/({s}+1e-8))**2)"


parts = [f"{mean(X13)} as stats_of_stats_mean", f"{pstd(X13)} as stats_of_stats_std", f"{pstd(X13)}/(abs({mean(X13)})+1e-8) as stats_of_stats_cv",
         f"case when {pstd(X13)} > 0 then 1/({pstd(X13)}/{mean([f'abs({c})' for c in X13])}+1e-8) else 0 end as stats_consistency",
         "+".join(scaled13(c) for c in X13) + " as stats_weighted_sum"]
for c in X13:
    a, s = f"avg({c}) over ()", f"stddev_pop({c}) over ()"
    parts += [f"len(list_filter([q_{c}[2],q_{c}[4],q_{c}[6],q_{c}[8]], lambda e: {c} >= e)) as {c}_quintile", f"len(list_filter(q_{c}, lambda e: {c} >= e)) as {c}_decile",
              f"case when {c} < {a} - {s} then 0 when {c} <= {a} + {s} then 1 else 2 end as {c}_zscore_bin"]
for a, b in near_pairs(X13):
    parts += [f"{a}*{b} as stats_product_{a}_{b}", f"{a}/({b}+1e-8) as stats_ratio_{a}_over_{b}"]
R.add("x13_stats_of_stats", table(derived.stats_of_stats, X13), settled([NODES, quantiles(X13, DEC)], f"select node_id, {', '.join(parts)} from nodes, q"))

X14 = ["f0", "f3", "f5", "f8", "f9"]
parts = []
for i in range(3):
    for j in range(i + 1, 4):
        for k in range(j + 1, 5):
            a, b, c = X14[i], X14[j], X14[k]
            parts += [f"{a}*{b}*{c} as interaction_triple_{a}_{b}_{c}", f"3/(1/({a}+1e-8)+1/({b}+1e-8)+1/({c}+1e-8)) as interaction_harmonic_triple_{a}_{b}_{c}"]
parts += [f"{mean(X14)} as interaction_mean", f"{pstd(X14)} as interaction_std", f"greatest({','.join(X14)}) as interaction_max", f"least({','.join(X14)}) as interaction_min"]
for c in X14:
    parts += [f"case when {c} <= q_{c}[1] then 0 when {c} <= q_{c}[2] then 1 else 2 end as {c}_level", f"ln(1+abs({c})) as {c}_log1p", f"sqrt(abs({c})) as {c}_sqrt"]
R.add("x14_interaction_derived", table(derived.interaction_derived, X14), settled([NODES, quantiles(X14, "[0.25,0.75]")], f"select node_id, {', '.join(parts)} from nodes, q"))

X15 = ["f0", "f2", "f5", "f9"]
X15_BINS = {"f0": 10, "f2": 2, "f5": 10, "f9": 10}


def binned_query(clusters):
    def run(spark, folder):
        nodes = order_graph(spark, folder).features()
        wide = nodes.select("node_id", "f0", "f2", "f5", (F.col("f9") * 100 + F.col("f0")).alias("f9"))
        return settle(derived.binning_derived(wide, X15, clusters))

    return run


WIDE = "wide as (select node_id, f0, f2, f5, f9*100+f0 as f9 from nodes)"
Q15 = "q as (select " + ", ".join(f"quantile_cont({c}, [{','.join(repr(i / n) for i in range(1, n))}]) as q_{c}, min({c}) as a_{c}, max({c}) as b_{c}" for c, n in X15_BINS.items()) + " from wide)"
FREQ = {c: f"len(list_filter(q_{c}, lambda e: {c} >= e))" for c in X15}
parts = []
for c, n in X15_BINS.items():
    parts += ["+".join(f"({c} >= a_{c}+{i}*((b_{c}-a_{c})/{n}))::int" for i in range(1, n)) + f" as {c}_equal_width_bin", f"{FREQ[c]} as {c}_equal_freq_bin"]
    parts += [f"avg(case when {FREQ[c]} = {b} then {c} end) over () as {c}_bin{b}_mean_ref" for b in range(n)]
R.add("x15_binning_derived", binned_query(0), settled([NODES, WIDE, Q15], f"select node_id, {', '.join(parts)} from wide, q"))
R.add("x15_binning_clusters", binned_query(5))

X16 = FS[:5]
parts = []
for c in X16:
    for w in (5, 10, 20):
        o = f"over (order by node_id rows between {w - 1} preceding and current row)"
        parts += [f"avg({c}) {o} as {c}_rolling_mean_ws{w}", f"stddev_pop({c}) {o} as {c}_rolling_std_ws{w}", f"max({c}) {o} as {c}_rolling_max_ws{w}",
                  f"min({c}) {o} as {c}_rolling_min_ws{w}", f"{c}-avg({c}) {o} as {c}_rolling_change_ws{w}"]
R.add("x16_rolling", table(derived.rolling, X16), settled([NODES], f"select node_id, {', '.join(parts)} from nodes"))
parts = []
for c in X16:
    for k in (1, 2, 3):
        v = f"coalesce(lag({c},{k}) over (order by node_id), first({c}) over (order by node_id))"
        parts += [f"{v} as {c}_lag{k}", f"{c}-{v} as {c}_lag{k}_diff", f"{c}/({v}+1e-8) as {c}_lag{k}_ratio"]
R.add("x17_lag", table(derived.lags, X16), settled([NODES], f"select node_id, {', '.join(parts)} from nodes"))
O18 = "over (order by pos rows between 10 preceding and 9 following)"
R.add("x18_local_trend", table(derived.local_trend, X16), settled(
    [NODES, "placed as (select *, (row_number() over (order by node_id)-1)::double as pos from nodes)"],
    "select node_id, " + ", ".join(f"case when count(*) {O18} > 3 then regr_slope({c}, pos) {O18} else 0 end as {c}_pseudo_trend" for c in X16) + " from placed"))
R.add("x19_importance_derived", table(derived.importance_derived, FS))

# --- model ----------------------------------------------------------------------------------------
SMALL = model.BoostSettings(iterations=5, folds=3)


def labelled(spark, folder):
    graph = order_graph(spark, folder)
    return graph.nodes.where(F.col("label").isin(0, 1)).select("node_id", "label", *FS[1:])


def trained(spark, folder):
    return model.train_cv(labelled(spark, folder), FS[1:], SMALL)


R.add("v1_train_cv", lambda spark, folder: trained(spark, folder)[1])
R.add("v2_ensemble_predict", lambda spark, folder: model.ensemble_predict(trained(spark, folder)[0], order_graph(spark, folder).features(FS[1:])))
R.add("v3_class_weight", lambda spark, folder: settle(model.class_weights(labelled(spark, folder)), ("label",)), settled(
    [NODES, "known as (select * from nodes where label in (0,1))"], """select label, count(*) as n_class, (select count(*) from known)/(2*count(*)) as weight,
   (select count(*) filter (label=0)/count(*) filter (label=1) from known) as neg_pos_ratio from known group by label""", ("label",)))
R.add("v4_feature_importance", lambda spark, folder: model.feature_importance(trained(spark, folder)[0]))
