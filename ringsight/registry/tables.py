"""Sources, sinks, splits, cross features and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ringsight.functions.scalars import finalize, safe_div, safe_divide_finite
from ringsight.operators import cross, metrics, splits, temporal
from ringsight.registry.base import CARDS, EDGES, GAPPED, NODES, SCORED, TRANSACTIONS, Registry, div, settle, settled
from ringsight.session import checkpoint_dir
from ringsight.sources import readers, sinks
from ringsight.sources.warehouse import (
    event_transactions, order_cards, order_graph, relation_edges, scored_documents, with_gaps,
)

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
BASE = [EDGES, NODES]


def scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def h(expr, seed="42"):
    return f"md5(concat_ws('|','{seed}',cast({expr} as varchar)))"


# --- sources and sinks ---------------------------------------------------------------------------
def read_graph(spark, folder):
    graph, nodes, edges = order_graph(spark, folder), scratch(spark, "nodes"), scratch(spark, "edges")
    graph.nodes.write.parquet(nodes)
    graph.edges.withColumn("ts", F.col("ts").cast("int")).withColumn("edge_type", F.col("edge_type").cast("int")).write.parquet(edges)
    back = readers.read_graph(spark, nodes, edges, 10)
    ends = back.edges.groupBy(F.col("src").alias("node_id")).agg(
        F.count(F.lit(1)).alias("edges"), F.sum("edge_id").alias("edge_id_sum"), F.max("ts").alias("ts_max"))
    return settle(back.nodes.join(ends, "node_id", "left"), ("node_id", "split"))


R.add("s1_read_graph", read_graph, settled(BASE, """select n.*, edges, edge_id_sum, ts_max from nodes n left join
  (select src, count(*) as edges, sum(edge_id) as edge_id_sum, max(ts) as ts_max from edges group by src) e on e.src = n.node_id""",
  ("node_id", "split")))


def read_transactions(spark, folder):
    path = scratch(spark, "transactions")
    rows = event_transactions(spark, folder).drop("row_id")
    rows.repartitionByRange(4, "Time").sortWithinPartitions("Time", "Source", "Target", "Amount").write.csv(path, header=True)
    return settle(readers.read_transactions(spark, path), ("row_id", "Source", "Target", "Location", "Type"))


R.add("s2_read_transactions", read_transactions, settled([TRANSACTIONS], """
  select * exclude (row_id), row_number() over (order by "Time", "Source", "Target", "Amount") - 1 as row_id from trans""",
  ("row_id", "Source", "Target", "Location", "Type")))


def read_cards(spark, folder):
    path = scratch(spark, "cards")
    rows = order_cards(spark, folder)
    ordered = rows.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id")
    ordered.withColumn("time_stamp", F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss")).write.csv(path, header=True)
    back = readers.read_card_log(spark, path).withColumn("time_stamp", F.unix_seconds("time_stamp"))
    return settle(back, ("row_id", "card_id", "time_stamp"))


R.add("s3_read_card_log", read_cards, settled([CARDS], """
  select * replace (cast(epoch(time_stamp) as bigint) as time_stamp, row_number() over (order by row_id) - 1 as row_id) from cards""",
  ("row_id", "card_id", "time_stamp")))


def write_features(spark, folder):
    path = scratch(spark, "features")
    sinks.write_features(with_gaps(order_graph(spark, folder)).features(), path)
    return settle(spark.read.parquet(path))



R.add("s4_write_features", write_features, settled(BASE + [GAPPED], "select * exclude (label, split) from gapped"))


def two_families(spark, folder):
    graph = order_graph(spark, folder)
    first = graph.features(["f0", "f1"])
    second = temporal.degree_features(graph).withColumn("f1", F.col("out_degree") + 0.5)
    return [first, second, graph.features(["f1", "f2"])]


DEGREES = ("(select n.node_id, coalesce(o,0) as o, coalesce(i,0) as i from nodes n left join (select src, count(*) as o from edges group by src) a "
           "on a.src = n.node_id left join (select dst, count(*) as i from edges group by dst) b on b.dst = n.node_id)")
CONCAT = f"""select n.node_id, f0, f1, o as out_degree, i as in_degree, o+i as total_degree, {div('o', 'i')} as degree_ratio,
  abs(o-i) as degree_imbalance, f2{{extra}} from nodes n join {DEGREES} d on d.node_id = n.node_id"""
R.add("s5_concat_features", lambda spark, folder: settle(sinks.concat_features(two_families(spark, folder))),
      settled(BASE, CONCAT.format(extra=", o+0.5 as f1_1, f1 as f1_2")))
R.add("s6_concat_features_dedup", lambda spark, folder: settle(
    sinks.concat_features(two_families(spark, folder), keep_first=True)), settled(BASE, CONCAT.format(extra="")))


def write_predictions(spark, folder):
    path = scratch(spark, "predictions")
    sinks.write_predictions(scored_documents(spark, folder), path)
    back = spark.read.schema("true_label int, pred_probability double, pred_label int").csv(path, header=True)
    return back.groupBy("true_label", "pred_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pred_probability"), 6).alias("p_sum"))


R.add("s7_write_predictions", write_predictions, f"""with {SCORED} select y as true_label, (p > 0.5)::int as pred_label,
  count(*) as n, round(sum(p), 6) as p_sum from scored group by 1, 2""")


def write_metrics(spark, folder):
    path = scratch(spark, "metrics")
    sinks.write_metrics(metrics.confusion_metrics(scored_documents(spark, folder)), path)
    return settle(spark.read.json(path), ())


COUNTS = ("count(*) filter (y=0 and not {h}) as tn, count(*) filter (y=0 and {h}) as fp, "
          "count(*) filter (y=1 and not {h}) as fn, count(*) filter (y=1 and {h}) as tp")
RATES = (f"*, {div('tp', 'tp+fp')} as precision, {div('tp', 'tp+fn')} as recall, {div('tn', 'tn+fp')} as specificity, "
         f"{div('2*tp', '2*tp+fp+fn')} as f1, {div('tp+tn', 'tp+tn+fp+fn')} as accuracy")


def flat(ctes, select):
    """settled() for results without key columns."""
    inner = settled(ctes, f"select 0 as _k, * from ({select})", ("_k",))
    return f"select * exclude (_k) from ({inner})"


CONFUSION = flat([SCORED], f"select {RATES} from (select {COUNTS.format(h='p > 0.5')} from scored)")
R.add("s8_write_metrics", write_metrics, CONFUSION)


def describe(spark, folder):
    graph = order_graph(spark, folder)
    return settle(splits.graph_describe(graph, relation_edges(graph.edges)), ("scope", "name"))


R.add("s9_graph_describe", describe, settled(BASE, """
  select 'graph' as scope, 'nodes' as name, count(*)::double as value from nodes
  union all select 'graph', 'fraud', count(*) filter (label=1) from nodes union all select 'graph', 'normal', count(*) filter (label=0) from nodes
  union all select 'graph', 'features', 10 union all select 'graph', 'fraud_ratio', count(*) filter (label=1) / count(*) filter (label in (0,1)) from nodes
  union all select split, 'nodes', count(*) from nodes group by split
  union all select split, 'share', count(*)/(select count(*) from nodes) from nodes group by split
  union all select 'r'||(1 + edge_type//2), 'edges', count(*) from edges group by 1
  union all select 'r'||(1 + edge_type//2), 'mean_out_degree', count(*)/(select count(*) from nodes) from edges group by 1""", ("scope", "name")))
R.add("s10_label_distribution", lambda spark, folder: splits.label_distribution(order_graph(spark, folder).nodes),
      f"with {NODES} select label, count(*) as n from nodes group by label")

# --- splits and subgraphs --------------------------------------------------------------------------
FEATURES = ", ".join(f"f{i}" for i in range(10))


def edges_of(op):
    return lambda spark, folder: op(order_graph(spark, folder)).edges


def train_part(graph):
    return splits.induced_subgraph(graph, splits.renumbered(graph.nodes.where(F.col("split") == "train")))


RENUM = "keep as (select node_id, row_number() over (order by node_id) - 1 as new_id from nodes where {w})"
SUB_EDGES = ("select edge_id, a.new_id as src, b.new_id as dst, edge_type, ts from edges join keep a on a.node_id = src join keep b on b.node_id = dst")
R.add("p1_induced_subgraph", edges_of(train_part), f"with {EDGES}, {NODES}, {RENUM.format(w='split = ' + chr(39) + 'train' + chr(39))} {SUB_EDGES}")
R.add("p1_induced_subgraph_nodes", lambda spark, folder: settle(train_part(order_graph(spark, folder)).nodes, ("node_id", "split")),
      settled(BASE + [RENUM.format(w="split = 'train'")], f"select new_id as node_id, {FEATURES}, label, split from nodes join keep using (node_id)",
              ("node_id", "split")))
R.add("p2_filter_labels", edges_of(splits.filter_labels), f"with {EDGES}, {NODES}, {RENUM.format(w='label in (0,1)')} {SUB_EDGES}")
R.add("p3_split_random", lambda spark, folder: splits.split_random(order_graph(spark, folder).nodes), f"""
  with {NODES} select node_id, case when r < floor(0.6*n) then 'train' when r < floor(0.8*n) then 'valid' else 'test' end as split
  from (select node_id, row_number() over (order by {h('node_id', '12345')}, node_id) - 1 as r, count(*) over () as n from nodes)""")
IN_LABEL = f"(select *, row_number() over (partition by label order by {h('node_id')}, node_id) - 1 as r, count(*) over (partition by label) as n from nodes)"
R.add("p4_split_stratified", lambda spark, folder: splits.split_stratified(order_graph(spark, folder).nodes), f"""
  with {NODES} select node_id, label, case when r < floor(0.6*n) then 'train' when r < floor(0.8*n) then 'valid' else 'test' end as split from {IN_LABEL}""")
R.add("p5_split_kfold", lambda spark, folder: splits.split_kfold(order_graph(spark, folder).nodes),
      f"with {NODES} select node_id, label, cast(r % 5 as int) as fold from {IN_LABEL}")
R.add("p6_split_temporal", lambda spark, folder: splits.split_temporal(order_cards(spark, folder), "1995-01-01 00:00:00")
      .groupBy("part", "is_fraud").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("row_sum")), f"""
  with {CARDS} select part, is_fraud, count(*) as n, cast(sum(row_id) as bigint) as row_sum from (select *, case when age <= 0 then null
    when age <= 9*2628000 then 'train' when age <= 10*2628000 then 'Oct' when age <= 11*2628000 then 'Nov' when age <= 12*2628000 then 'Dec' end as part
    from (select *, epoch(time_stamp) - epoch(timestamp '1995-01-01') as age from cards)) group by part, is_fraud""")
R.add("p7_sample_edges", lambda spark, folder: splits.sample_edges(order_graph(spark, folder).edges, 0.1),
      f"with {EDGES} select * from edges where cast(('0x' || substr({h('edge_id')}, 1, 8)) as bigint)/4294967296.0 < 0.1")


def truncate(mode):
    return lambda spark, folder: splits.truncate_split(order_graph(spark, folder).nodes, 100, mode)


def truncate_sql(order, part="split", quota="100"):
    return (f"with {NODES} select node_id, label, split from (select *, row_number() over (partition by {part} order by {order}) as r, "
            "count(*) over (partition by split) as n, count(*) filter (label=1) over (partition by split) as np from nodes) "
            f"where n <= 100 or r <= {quota}")


R.add("p8_truncate_split_first", truncate("first"), truncate_sql("node_id"))
R.add("p8_truncate_split_random", truncate("random"), truncate_sql(f"{h('node_id')}, node_id"))
R.add("p8_truncate_split_balanced", truncate("balanced"), truncate_sql(
    f"{h('node_id')}, node_id", "split, label",
    "case label when 1 then greatest(1, floor(100*np/n)) when 0 then 100 - greatest(1, floor(100*np/n)) else 0 end"))
R.add("p9_undersample", lambda spark, folder: splits.undersample(order_graph(spark, folder).nodes, 2.0), f"""
  with {NODES} select node_id, label from nodes where label = 1 union all select node_id, label from (select node_id, label,
    row_number() over (order by {h('node_id')}, node_id) as r from nodes where label <> 1) where r <= 2*(select count(*) from nodes where label = 1)""")
REL = "rel as (select src, dst, 'r'||(1 + edge_type//2) as relation from edges)"
R.add("p10_relation_bitmap", lambda spark, folder: splits.relation_bitmap(
    relation_edges(order_graph(spark, folder).edges), ("r1", "r2", "r3")),
    f"with {EDGES}, {REL} select src, dst, cast(bit_or(case relation when 'r1' then 1 when 'r2' then 2 else 4 end) as int) as edge_type from rel group by 1, 2")
R.add("p11_remove_self_loop", edges_of(lambda g: type(g)(g.nodes, splits.remove_self_loops(g.edges))),
      f"with {EDGES} select * from edges where src <> dst")


def with_loops(spark, folder):
    graph = order_graph(spark, folder)
    return splits.add_self_loops(graph.edges, graph.nodes)


R.add("p11_add_self_loop", with_loops, f"with {EDGES}, {NODES} select src, dst from edges where src <> dst union all select node_id, node_id from nodes")
R.add("p12_to_bidirected", lambda spark, folder: splits.to_bidirected(order_graph(spark, folder).edges),
      f"with {EDGES} select src, dst from edges union select dst, src from edges")


def merged(spark, folder):
    parts = splits.split_relations(relation_edges(order_graph(spark, folder).edges), ("r1", "r2", "r3"))
    return splits.merge_relations(parts)


R.add("p13_merge_relations", merged, f"with {EDGES} select *, 'r'||(1 + edge_type//2) as relation from edges")


def blocks(which):
    return lambda spark, folder: splits.block_subgraphs(order_graph(spark, folder), 400)[which]


FULL = "(select count(*)//400 from nodes)"
R.add("p14_block_subgraphs", blocks(0), f"""with {EDGES}, {NODES} select edge_id, src % 400 as src, dst % 400 as dst, edge_type, ts,
  src//400 as block from edges where src//400 = dst//400 and src//400 < {FULL}""")
R.add("p14_cross_block_edges", blocks(1), f"with {EDGES}, {NODES} select * from edges where src//400 <> dst//400 or src//400 >= {FULL}")
R.add("p16_safe_div", lambda spark, folder: settle(order_graph(spark, folder).nodes.select(
    "node_id", safe_div(F.col("f0"), F.col("f9"), -1.0).alias("filled"), safe_divide_finite(F.col("f5"), F.col("f2")).alias("finite"))),
    settled(BASE, f"select node_id, {div('f0', 'f9', '-1')} as filled, {div('f5', 'f2')} as finite from nodes"))


def finalized(spark, folder):
    nodes = order_graph(spark, folder).nodes
    odd = nodes.select("node_id", F.when(F.col("f2") == 0, None).otherwise(F.col("f0")).alias("with_null"),
                       F.when(F.col("f2") == 1, float("inf")).when(F.col("f2") == 2, float("nan")).otherwise(F.col("f5")).alias("with_inf"))
    return finalize(odd)


R.add("p17_finalize", finalized, settled(BASE, """select node_id, case when f2 = 0 then null else f0 end as with_null,
  case when f2 in (1, 2) then 0 else f5 end as with_inf from nodes"""))


def selected(spark, folder):
    table, missing = splits.select_features(order_graph(spark, folder).nodes, ["f7", "absent", "f2", "f9"])
    return settle(table.withColumn("missing", F.lit(len(missing))))


R.add("p18_select_features", selected, settled([NODES], "select node_id, f7, f2, f9, 1 as missing from nodes"))
R.add("p18_drop_by_pattern", lambda spark, folder: settle(splits.drop_by_pattern(
    order_graph(spark, folder).nodes.drop("split"), ["f1", "lab"])), settled([NODES], "select * exclude (f1, label, split) from nodes"))

# --- cross features ---------------------------------------------------------------------------------


def inputs(family):
    made = set(cross.FAMILIES[family])
    names = [n for f in cross.FAMILIES[family].values() for n in cross.inputs_of(f)]
    return [n for n in dict.fromkeys(names) if n not in made and "one_class_svm" not in n]


def input_columns(family):
    """The formulas' inputs, filled from the node features in turn."""
    return {name: f"abs(f{k % 10}) / {10 ** (k % 3)}.0" for k, name in enumerate(inputs(family))}


def cross_query(family):
    def run(spark, folder):
        nodes = order_graph(spark, folder).nodes
        table = nodes.select("node_id", *[F.expr(e).alias(n) for n, e in input_columns(family).items()])
        done = cross.cross_features(table, family)
        return settle(done.select("node_id", *[c for c in done.columns if c in cross.FAMILIES[family]]))

    return run


def cross_sql(family):
    columns = input_columns(family)
    formulas = cross.usable(list(columns), family)
    later = {n for n, f in formulas.items() if any(i in formulas for i in cross.inputs_of(f))}
    first = ", ".join(f"{f} as {n}" for n, f in formulas.items() if n not in later)
    second = "".join(f", {formulas[n]} as {n}" for n in later)
    return settled([NODES, "inp as (select node_id, " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + " from nodes)"],
                   f"select *{second} from (select node_id, {first} from inp)")


for number, family in enumerate(cross.FAMILIES, start=1):
    R.add(f"f{number}_cross_{family}", cross_query(family), cross_sql(family))

# --- metrics --------------------------------------------------------------------------------------


def scored_query(op, keys=()):
    return lambda spark, folder: settle(op(scored_documents(spark, folder)), keys)


R.add("q1_confusion_metrics", scored_query(metrics.confusion_metrics), CONFUSION)
RANKS = """(select sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end)/count(*) from
  (select p from scored where y = 1{w}) a, (select p from scored where y = 0{w}) b)"""
R.add("q2_roc_auc", scored_query(metrics.roc_auc), flat([SCORED], f"select {RANKS.format(w='')} as auc"))
CURVE = """curve as (select p, pos, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as np, sum(neg) over () as nn
  from (select p, count(*) filter (y=1) as pos, count(*) filter (y<>1) as neg from scored group by p) window w as (order by p desc))"""
R.add("q3_average_precision", scored_query(metrics.average_precision), flat([SCORED, CURVE], """
  select sum(pos/np*tp/(tp+fp)) as ap, sum(pos/np*(tp/(tp+fp) + coalesce(pt/nullif(pt+pf,0), 1))/2) as pr_auc from
   (select *, coalesce(lag(tp) over (order by p desc), 0) as pt, coalesce(lag(fp) over (order by p desc), 0) as pf from curve)"""))
MF1 = f"({div('2*tp', '2*tp+fp+fn')} + {div('2*tn', '2*tn+fp+fn')})/2"
R.add("q4_best_macro_f1", scored_query(metrics.best_macro_f1), flat(
    [SCORED, f"ths as (select unnest({metrics.THRESHOLDS}) as t)"], f"""
  select mf1 as best_macro_f1, t as threshold from (select t, {MF1} as mf1 from (select t, {COUNTS.format(h='p > t')} from scored, ths group by t))
  order by mf1 desc, t limit 1"""))
BEST = f"""select max(mf1) as mf1, arg_max(p, (mf1, p)) as th1, max(g) as gme, arg_max(p, (g, p)) as th2 from
  (select *, {MF1} as mf1, sqrt(tp/np*tn/nn) as g from (select *, np-tp as fn, nn-fp as tn from curve))"""
R.add("q5_best_threshold_curve", scored_query(metrics.best_thresholds), flat([SCORED, CURVE], BEST))
PARTS = {"trn": "fold < 3", "val": "fold = 3", "tst": "fold = 4"}


def report(scored):
    part = F.when(F.col("fold") < 3, "trn").when(F.col("fold") == 3, "val").otherwise("tst")
    return metrics.threshold_report(scored.withColumn("split", part))


def report_sql():
    parts = []
    for name, where in PARTS.items():
        mine = SCORED.replace("scored as (", "all_scored as (")
        own = f"scored as (select * from all_scored where {PARTS['val'] if name == 'tst' else where})"
        best = f"(with {mine}, {own}, {CURVE} {BEST})"
        judged = (f"(with {mine}, scored as (select * from all_scored where {where}), {CURVE} select {RANKS.format(w='')} as auc, "
                  "(select sum(pos/np*tp/(tp+fp)) from curve) as aps)")
        counts = (f"(with {mine}, scored as (select * from all_scored where {where}) select {COUNTS.format(h='p > (select th1 from ' + best + ')')} from scored)")
        mf1 = MF1 if name == "tst" else "b.mf1"
        gme = "sqrt(tp/(tp+fn)*tn/(tn+fp))" if name == "tst" else "b.gme"
        parts.append(f"select '{name}' as split, auc, aps, {mf1} as mf1, th1, {gme} as gme, th2, {div('tp', 'tp+fn')} as rec, "
                     f"{div('tp', 'tp+fp')} as pre from {best} b, {judged} j, {counts} c")
    return settled(["one as (select 1)"], " union all ".join(parts), ("split",))


R.add("q5_threshold_report", scored_query(report, ("split",)), report_sql())


def gmean(scored):
    return metrics.g_mean(scored.withColumn("prediction", (F.col("p") > 0.5).cast("int")))


R.add("q6_g_mean", scored_query(gmean), flat([SCORED], """select exp(avg(ln(r))) as g_mean from
  (select y, avg(((p > 0.5)::int = y)::int) as r from scored group by y)"""))
R.add("q7_fold_summary", scored_query(metrics.fold_summary), flat([SCORED], f"""
  select avg(auc) as auc_mean, stddev_pop(auc) as auc_std, avg(f1) as f1_mean, stddev_pop(f1) as f1_std, count(*) as folds from
   (select fold, {div('2*tp', '2*tp+fp+fn')} as f1 from (select fold, {COUNTS.format(h='p > 0.5')} from scored group by fold)) c
   join (select a.fold, sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end)/count(*) as auc from scored a join scored b
     on a.fold = b.fold and a.y = 1 and b.y = 0 group by a.fold) d using (fold)"""))
