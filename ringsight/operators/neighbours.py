"""Neighbour aggregation over the undirected graph, two hops, bins and risk counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.functions.ordered import exact_quantiles, melt
from ringsight.functions.sampling import first_k, sample_k_per_key
from ringsight.functions.scalars import mean_of, one_row, safe_div, seeded_hash, total
from ringsight.graph import FraudGraph
from ringsight.operators.blocks import block_pairs
from ringsight.operators.columns import kbins, matrix_columns, zscore
from ringsight.operators.samples import sampled_end_stats, whole_ids
from ringsight.operators.structure import HOT_NODE, undirected_degree, wide_stats
from ringsight.operators.twohop import HUB_THRESHOLD, exclusive_sums, two_hop, union_sums
from ringsight.session import cut_lineage

AGGS = (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop), ("sum", F.sum))


def sampled_neighbours(pairs: DataFrame, k: int | None) -> DataFrame:
    """All, or at most k seeded neighbours of each node of distinct ``(node, nbr)`` pairs."""
    return pairs if k is None else sample_k_per_key(pairs, ["node"], ["node", "nbr"], ["nbr"], k)


def _values(graph: FraudGraph, first: int | None = None) -> DataFrame:
    names = graph.feature_names[:first]
    return graph.nodes.select(F.col("node_id").alias("nbr"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])


def _on_nodes(graph: FraudGraph, stats: DataFrame) -> DataFrame:
    return graph.attach(stats.withColumnRenamed("node", "node_id")).fillna(0)


def one_hop(graph: FraudGraph, k: int | None = None) -> DataFrame:
    """A1: mean, max, min, population std and sum of every feature over all neighbours (or k of them)."""
    values = _values(graph)
    rows = sampled_neighbours(graph.neighbours(), k).join(values, "nbr")
    aggs = [how(f"v{i}").alias(f"orig_n1_{s}_feat{i}") for i in range(len(graph.feature_names)) for s, how in AGGS]
    return _on_nodes(graph, wide_stats(graph, rows, aggs))


def _first_by_node_hash(pairs: DataFrame, k: int) -> DataFrame:
    """Bottom-k sample: the k distinct ``nbr`` with the smallest hash ``h`` of their own id, per node.

    The hash does not depend on the node, so the first k of a union are among the first k of its
    parts: second-hop lists may be cut to k before the join without changing the sample.
    """
    w = Window.partitionBy("node").orderBy("h", "nbr")
    ranked = pairs.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= k)
    return ranked.select("node", "nbr", "h").distinct()


def _hash_number(c: str) -> Column:
    # The first 60 bits of the hash as a number: cheaper to sort and ship than its text.
    return F.conv(F.substring(seeded_hash(c), 1, 15), 16, 10).cast("bigint")


def _hashed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("h", _hash_number("nbr"))


def _hop(near: DataFrame, far: DataFrame) -> DataFrame:
    """``(node, nbr, ..)`` over one shared middle node."""
    kept = [c for c in far.columns if c != "node"]
    return near.select("node", F.col("nbr").alias("mid")).join(
        far.withColumnRenamed("node", "mid"), "mid"
    ).select("node", *kept)


def _beyond(near: DataFrame, pairs: DataFrame, k1: int, k2: int) -> DataFrame:
    """At most k2 nodes behind the (at most k1) sampled ones, without those and the node itself."""
    # At most k1 + 1 nodes are left out, so k2 + k1 + 1 of them always suffice, per middle node
    # and per node; only that many meet the anti join.
    most = k2 + k1 + 1
    far = _first_by_node_hash(_hop(near, _first_by_node_hash(_hashed(pairs), most)), most)
    fresh = far.where(F.col("node") != F.col("nbr")).join(near, ["node", "nbr"], "left_anti")
    return first_k(fresh, ["node"], ["h", "nbr"], k2).select("node", "nbr")


def _beyond_stats(near: DataFrame, pairs: DataFrame, k2: int, values: DataFrame, names: list[str]) -> DataFrame:
    """Statistics of ``values(nbr, names..)`` over the nodes of ``_beyond``; ``near`` and ``pairs`` hold whole numbers."""
    own = near.select("node").distinct().select(F.col("node").alias("u"), F.col("node").alias("w"))
    return sampled_end_stats(
        near.toDF("u", "v"), pairs.where("nbr is not null").toDF("v", "w"), _hash_number, k2,
        values.withColumnRenamed("nbr", "w"), names, near.toDF("u", "w").unionByName(own),
    )


def _two_hop_sums(graph: FraudGraph, first: int | None, exclusive: bool, threshold: int) -> tuple[DataFrame, int]:
    """``(node, n, s0.., q0..)``: size of the exact second hop, and sums of centred features and their squares over it."""
    names = graph.feature_names[:first]
    # Centred on the mean of all nodes, so that a difference of squares keeps its digits.
    centre = one_row(graph.nodes.agg(*[F.avg(c).alias(c) for c in names]))
    values = graph.nodes.select(F.col("node_id").alias("w"), F.lit(1).cast("bigint").alias("n"), *[
        (F.col(c) - centre[c]).alias(f"s{i}") for i, c in enumerate(names)
    ])
    values = values.select("*", *[(F.col(f"s{i}") * F.col(f"s{i}")).alias(f"q{i}") for i in range(len(names))])
    und = graph.neighbours()
    hop = two_hop(und.toDF("u", "v"), und.toDF("v", "w"), threshold)
    sums = ["n", *[f"s{i}" for i in range(len(names))], *([] if exclusive else [f"q{i}" for i in range(len(names))])]
    if exclusive:
        own = graph.nodes.select(F.col("node_id").alias("u"), F.col("node_id").alias("w"))
        found = exclusive_sums(hop, und.toDF("u", "w").unionByName(own).distinct(), values, sums).where("n > 0")
    else:
        found = union_sums(hop, values, sums)
    middle = F.struct(*[centre[c].alias(f"c{i}") for i, c in enumerate(names)])
    return found.withColumnRenamed("u", "node").withColumn("_centre", middle), len(names)


def two_hop_features(
    graph: FraudGraph, k: int | None = None, first: int | None = None, threshold: int = HUB_THRESHOLD
) -> DataFrame:
    """A2: the A1 statistics over all nodes of the pattern of A squared (or k of them), of all features (or the first).

    Without ``k`` the second hop is exact: sums over the distinct nodes (``two_hop``), and the extremes by two
    steps over the edges, which need no distinct nodes.
    """
    und = graph.neighbours()
    if k is not None and whole_ids(und, und):
        und, values = cut_lineage(und), _values(graph, first)
        names = [c for c in values.columns if c != "nbr"]
        stats = sampled_end_stats(
            und.toDF("u", "v"), und.toDF("v", "w"), _hash_number, k, values.withColumnRenamed("nbr", "w"), names,
        )
        out = []
        for i in range(len(names)):
            n, mean = F.col(f"c{i}"), F.col(f"d{i}") / F.col(f"c{i}")
            spread = F.sqrt(F.greatest(F.col(f"q{i}") / n - mean * mean, F.lit(0.0)))
            by_name = {
                "mean": F.col(f"s{i}") / n, "max": F.col(f"h{i}"), "min": F.col(f"l{i}"),
                "std": F.when(F.col(f"h{i}") > F.col(f"l{i}"), spread).otherwise(0.0), "sum": F.col(f"s{i}"),
            }
            out += [by_name[s].alias(f"orig_n2_{s}_feat{i}") for s, _ in AGGS]
        return _on_nodes(graph, stats.select(F.col("u").alias("node"), *out))
    if k is not None:
        sample = _first_by_node_hash(_hop(und, _first_by_node_hash(_hashed(und), k)), k)
        rows = sample.join(_values(graph, first), "nbr")
        n = len(graph.feature_names[:first])
        return _on_nodes(graph, rows.groupBy("node").agg(*[
            how(f"v{i}").alias(f"orig_n2_{s}_feat{i}") for i in range(n) for s, how in AGGS
        ]))
    sums, n = _two_hop_sums(graph, first, False, threshold)
    ends = [how(f"v{i}").alias(f"{tag}{i}") for i in range(n) for tag, how in (("max", F.max), ("min", F.min))]
    near = und.join(_values(graph, first), "nbr").groupBy(F.col("node").alias("nbr")).agg(*ends)
    far = und.join(near, "nbr").groupBy("node").agg(*[
        how(f"{tag}{i}").alias(f"{tag}{i}") for i in range(n) for tag, how in (("max", F.max), ("min", F.min))
    ])
    out, size = [], F.col("n").cast("double")
    for i in range(n):
        c, mean = F.col(f"_centre.c{i}"), F.col(f"s{i}") / size
        # A column that is the same everywhere has no spread, whatever is left by rounding.
        spread = F.sqrt(F.greatest(F.col(f"q{i}") / size - mean * mean, F.lit(0.0)))
        out += [
            (c + mean).alias(f"orig_n2_mean_feat{i}"), F.col(f"max{i}").alias(f"orig_n2_max_feat{i}"), F.col(f"min{i}").alias(f"orig_n2_min_feat{i}"),
            F.when(F.col(f"max{i}") > F.col(f"min{i}"), spread).otherwise(0.0).alias(f"orig_n2_std_feat{i}"),
            (c * size + F.col(f"s{i}")).alias(f"orig_n2_sum_feat{i}"),
        ]
    return _on_nodes(graph, sums.join(far, "node").select("node", *out))


def exclusive_two_hop_features(
    graph: FraudGraph, k1: int | None = None, k2: int | None = None, first: int | None = None, threshold: int = HUB_THRESHOLD
) -> DataFrame:
    """A2, large-graph form: means over the nodes two hops away that are neither neighbours nor the node itself.

    With ``k1`` and ``k2``: behind at most k1 neighbours, and at most k2 of these nodes.
    """
    if (k1 is None) != (k2 is None):
        raise ValueError("give k1 and k2 together, or neither")
    if k1 is not None:
        und, n = cut_lineage(graph.neighbours()), len(graph.feature_names[:first])
        near = cut_lineage(sampled_neighbours(und, k1))
        if whole_ids(und, und):
            stats = _beyond_stats(near, und, k2, _values(graph, first), [f"v{i}" for i in range(n)])
            return _on_nodes(graph, stats.select(F.col("u").alias("node"), *[
                (F.col(f"s{i}") / F.col(f"c{i}")).alias(f"orig_n2_mean_feat{i}") for i in range(n)
            ]))
        rows = _beyond(near, und, k1, k2).join(_values(graph, first), "nbr")
        return _on_nodes(graph, rows.groupBy("node").agg(*[F.avg(f"v{i}").alias(f"orig_n2_mean_feat{i}") for i in range(n)]))
    sums, n = _two_hop_sums(graph, first, True, threshold)
    return _on_nodes(graph, sums.select("node", *[
        (F.col(f"_centre.c{i}") + F.col(f"s{i}") / F.col("n")).alias(f"orig_n2_mean_feat{i}") for i in range(n)
    ]))


def degree_correlation(graph: FraudGraph, first: int | None = None) -> DataFrame:
    """A3: neighbour mean times neighbour degree, and own value against neighbour degree."""
    first = len(graph.feature_names[:first])
    und = graph.neighbours()
    degree = undirected_degree(und, "d")
    values = _values(graph, first).join(degree.withColumnRenamed("node", "nbr"), "nbr")
    means = und.join(values, "nbr").groupBy(F.col("node").alias("node_id")).agg(
        F.avg("d").alias("dm"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(first)]
    )
    own = graph.nodes.select("node_id", *[F.col(c).alias(f"x{i}") for i, c in enumerate(graph.feature_names[:first])])
    rows = own.join(means, "node_id", "left")
    d = F.coalesce("dm", F.lit(0.0))
    out = []
    for i in range(first):
        x = F.col(f"x{i}")
        out += [
            (F.coalesce(F.col(f"m{i}"), x) * d).alias(f"orig_feat{i}_degree_corr"),
            (x - d).alias(f"orig_feat{i}_degree_diff"),
            (x / (d + 1e-8)).alias(f"orig_feat{i}_feat_degree_ratio"),
        ]
    return rows.select("node_id", *out)


def neighbour_distribution(graph: FraudGraph, k: int | None = None, first: int | None = None, hot_node: int = HOT_NODE) -> DataFrame:
    """A4: skewness, excess kurtosis and IQR over all neighbours (or k of them); 0 below three.

    A node with at most ``hot_node`` neighbours is computed where its rows lie; larger ones by partial
    moments and by ranks over range partitions.
    """
    first = len(graph.feature_names[:first])
    pairs = cut_lineage(sampled_neighbours(graph.neighbours(), k))
    hot = cut_lineage(undirected_degree(pairs, "d").where(F.col("d") > hot_node).select("node"))
    values = [f"v{i}" for i in range(first)]
    enough, moments = F.count(F.lit(1)) >= 3, [(F.count(F.lit(1)) >= 3).alias("enough")]
    for i, v in enumerate(values):
        flat = F.max(v) == F.min(v)
        moments += [
            F.when(enough & ~flat, F.skewness(v)).otherwise(0.0).alias(f"orig_feat{i}_neighbor_skew"),
            F.when(enough & ~flat, F.kurtosis(v)).otherwise(0.0).alias(f"orig_feat{i}_neighbor_kurt"),
        ]

    def spread(v: str):
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
        return (q[1] - q[0]).alias(f"iqr_{v}")

    rows = pairs.join(_values(graph, first), "nbr")
    few = hot.isEmpty()
    ordinary = rows if few else rows.join(hot, "node", "left_anti")
    joined = ordinary.repartition("node").groupBy("node").agg(*moments, *[spread(v) for v in values])
    if not few:
        rows = rows.join(hot, "node", "left_semi")
        # Ranks over range partitions: no task holds all values of a node.
        quartiles = exact_quantiles(melt(rows, ["node"], values), ["node", "column"], [0.25, 0.75]).groupBy("node").agg(
            *[F.max(F.when(F.col("column") == v, F.col("q")[1] - F.col("q")[0])).alias(f"iqr_{v}") for v in values]
        )
        joined = joined.unionByName(rows.groupBy("node").agg(*moments).join(quartiles, "node", "left"))
    out = []
    for i, v in enumerate(values):
        iqr = F.when(F.col("enough"), F.col(f"iqr_{v}")).otherwise(0.0)
        out += [f"orig_feat{i}_neighbor_skew", f"orig_feat{i}_neighbor_kurt", iqr.alias(f"orig_feat{i}_neighbor_iqr")]
    return _on_nodes(graph, joined.select("node", *out))


def in_out_difference(graph: FraudGraph, k: int | None = None, first: int | None = None) -> DataFrame:
    """A5: mean over in-neighbours against mean over out-neighbours; own value where none."""
    first = len(graph.feature_names[:first])
    pairs = graph.edges.select("src", "dst").distinct()
    values = _values(graph, first)

    def means(node: str, nbr: str, tag: str) -> DataFrame:
        sample = sampled_neighbours(pairs.select(F.col(node).alias("node"), F.col(nbr).alias("nbr")), k)
        return sample.join(values, "nbr").groupBy(F.col("node").alias("node_id")).agg(
            *[F.avg(f"v{i}").alias(f"{tag}{i}") for i in range(first)]
        )

    names = graph.feature_names[:first]
    rows = graph.features(names).join(means("dst", "src", "in"), "node_id", "left").join(
        means("src", "dst", "out"), "node_id", "left"
    )
    out = []
    for i, c in enumerate(names):
        a, b = F.coalesce(f"in{i}", c), F.coalesce(f"out{i}", c)
        ratio = F.try_divide(a, b + 1e-8)
        out += [(a - b).alias(f"orig_feat{i}_in_out_diff"), ratio.alias(f"orig_feat{i}_in_out_ratio")]
    return rows.select("node_id", *out)


# --- binned features ---------------------------------------------------------------------------

def bin_table(graph: FraudGraph, n_bins: int = 5) -> DataFrame:
    return kbins(graph.features(), n_bins).withColumnRenamed("node_id", "nbr")


def bin_one_hop(graph: FraudGraph, bins: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """A1 with a count, on binned features."""
    bins = bin_table(graph) if bins is None else bins
    rows = sampled_neighbours(graph.neighbours(), k).join(bins, "nbr")
    aggs = []
    for i, c in enumerate(c for c in bins.columns if c != "nbr"):
        aggs += [how(c).alias(f"bin_n1_{s}_feat{i}") for s, how in AGGS]
        aggs.append(F.count(c).alias(f"bin_n1_count_feat{i}"))
    return _on_nodes(graph, wide_stats(graph, rows, aggs))


def bin_distribution(graph: FraudGraph, bins: DataFrame | None = None, n_bins: int = 5, first: int | None = None) -> DataFrame:
    """Share of each bin among the neighbours, most frequent bin, and entropy."""
    first = len(graph.feature_names[:first])
    bins = bin_table(graph, n_bins) if bins is None else bins
    rows = graph.neighbours().join(bins.select("nbr", *[f"bin_{i}" for i in range(first)]), "nbr")
    counts = wide_stats(graph, rows, [
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"bin_{i}") == b).alias(f"c{i}_{b}") for i in range(first) for b in range(n_bins)],
    ])
    out = []
    for i in range(first):
        cells = [F.col(f"c{i}_{b}") for b in range(n_bins)]
        shares = [c / F.col("n") for c in cells]
        entropy = total([F.when(p > 0, -p * F.log(p + 1e-10)).otherwise(0.0) for p in shares])
        out += [p.alias(f"bin_n1_box{b}_ratio_feat{i}") for b, p in enumerate(shares)]
        out.append((F.array_position(F.array(*cells), F.greatest(*cells)) - 1).alias(f"bin_n1_mode_feat{i}"))
        out.append(F.when(F.col("n") < 2, 0.0).otherwise(entropy).alias(f"bin_n1_entropy_feat{i}"))
    return _on_nodes(graph, counts.select("node", *out))


def bin_cross_feature(graph: FraudGraph, bins: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Mean, max, min and range over features of the neighbours' bin means; mean of the stds."""
    stats = bin_one_hop(graph, bins, k)
    n = len(graph.feature_names)
    means = [F.col(f"bin_n1_mean_feat{i}") for i in range(n)]
    return stats.select(
        "node_id", mean_of(means).alias("bin_all_mean"),
        mean_of([F.col(f"bin_n1_std_feat{i}") for i in range(n)]).alias("bin_all_std"),
        F.greatest(*means).alias("bin_all_max"), F.least(*means).alias("bin_all_min"),
        (F.greatest(*means) - F.least(*means)).alias("bin_all_range"),
    )


def grouped_neighbour_mean(graph: FraudGraph, scores: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Mean feature of the in-neighbours scored low and of those scored high.

    ``scores(node_id, p)``; each mean is the sum over (count + 1e-8), so an empty group gives 0.
    """
    values = _values(graph).join(scores.withColumnRenamed("node_id", "nbr"), "nbr")
    rows = graph.edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr")).join(values, "nbr")
    aggs = []
    for tag, mine in (("low", F.col("p") <= low), ("high", F.col("p") > high)):
        size = F.count_if(mine) + 1e-8
        aggs += [
            (F.sum(F.when(mine, F.col(f"v{i}")).otherwise(0.0)) / size).alias(f"{tag}_group_mean_feat{i}")
            for i in range(len(graph.feature_names))
        ]
    return _on_nodes(graph, rows.groupBy("node").agg(*aggs))


# --- risk counts -------------------------------------------------------------------------------

def _risk_base(graph: FraudGraph) -> DataFrame:
    """In-degree and number of distinct label-1 successors, for every node."""
    degree = graph.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    fraud = graph.labelled(F.col("label") == 1).select(F.col("node_id").alias("dst"))
    risk = graph.edges.select("src", "dst").distinct().join(fraud, "dst", "left_semi").groupBy(
        F.col("src").alias("node_id")
    ).agg(F.count(F.lit(1)).alias("riskstat"))
    return graph.attach(degree, risk).fillna(0)


RISK = ["degree", "riskstat"]


def _risk_table(graph: FraudGraph, base: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    for hop, sums in ((1, one), (2, two)):
        named = sums.select(F.col("u").alias("node_id"), *[F.col(c).alias(f"{hop}hop_{c}") for c in RISK])
        base = base.join(named, "node_id", "left")
    # Written once: the scaling reads it for the moments and again for the rows.
    table = cut_lineage(base.fillna(0)).select("node_id", *RISK, "1hop_degree", "2hop_degree", "1hop_riskstat", "2hop_riskstat")
    scaled = zscore(table, guard="one")
    names = matrix_columns(table)
    return scaled.select("node_id", *[F.col(f"feature_{i}_standardized").alias(c) for i, c in enumerate(names)])


def riskstat(graph: FraudGraph, threshold: int = HUB_THRESHOLD) -> DataFrame:
    """A10: degree and risk of the node, and their sums over predecessors one and two hops away."""
    base = _risk_base(graph)
    pairs = graph.edges.select("src", "dst").distinct()
    near = pairs.select(F.col("dst").alias("u"), F.col("src").alias("w"))
    values = base.withColumnRenamed("node_id", "w")
    one = near.join(values, "w").groupBy("u").agg(*[F.sum(c).alias(c) for c in RISK])
    hop = two_hop(near.withColumnRenamed("w", "v"), pairs.select(F.col("dst").alias("v"), F.col("src").alias("w")), threshold)
    own = graph.nodes.select(F.col("node_id").alias("u"), F.col("node_id").alias("w"))
    two = exclusive_sums(hop, near.unionByName(own).distinct(), values, RISK)
    return _risk_table(graph, base, one, two)


def riskstat_sampled(graph: FraudGraph, k1: int = 100, k2: int = 50) -> DataFrame:
    """A10 over at most k1 sampled predecessors and k2 sampled nodes beyond them."""
    base = _risk_base(graph)
    pairs = graph.edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr")).distinct()
    pairs = cut_lineage(pairs)
    near = cut_lineage(sampled_neighbours(pairs, k1))
    values = base.withColumnRenamed("node_id", "nbr")

    def sums(rows: DataFrame) -> DataFrame:
        return rows.join(values, "nbr").groupBy(F.col("node").alias("u")).agg(*[F.sum(c).alias(c) for c in RISK])

    if whole_ids(pairs, pairs):
        stats = _beyond_stats(near, pairs, k2, values, RISK)
        two = stats.select("u", *[F.col(f"s{i}").cast("bigint").alias(c) for i, c in enumerate(RISK)])
    else:
        two = sums(_beyond(near, pairs, k1, k2))
    return _risk_table(graph, base, sums(near), two)


# --- pair lists --------------------------------------------------------------------------------

def k_neighbours(graph: FraudGraph, k: int, where: str, risk_only: bool = False) -> DataFrame:
    """Ids exactly k hops away (k = 1 or 2) along (``out``) or against (``in``) the edges."""
    key, other = ("dst", "src") if where == "in" else ("src", "dst")
    near = graph.edges.select(F.col(key).alias("node"), F.col(other).alias("nbr")).distinct()
    pairs = near
    if k == 2:
        hop = two_hop(near.toDF("u", "v"), near.toDF("v", "w"))
        pairs = hop.pairs(near.toDF("u", "w")).toDF("node", "nbr").where(F.col("node") != F.col("nbr"))
    if risk_only:
        fraud = graph.labelled(F.col("label") == 1).select(F.col("node_id").alias("nbr"))
        pairs = pairs.join(fraud, "nbr", "left_semi").select("node", "nbr")
    return pairs


def khop_exclusive(graph: FraudGraph, k: int = 2, max_density: float | None = None) -> DataFrame:
    """Undirected pairs by the hop at which they are first reached; hop 0 is the identity.

    The result is the pair list itself and may grow to all pairs; a level that fills more than
    ``max_density`` of them is an error.
    """
    und = cut_lineage(graph.neighbours().where(F.col("node") != F.col("nbr")))
    n = graph.nodes.count() if max_density is not None else 0
    seen = graph.nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("nbr"), F.lit(0).alias("hop"))
    front = und
    seen = seen.unionByName(front.withColumn("hop", F.lit(1)))
    for hop in range(2, k + 1):
        front = block_pairs(front.toDF("u", "v"), und.toDF("v", "w"), seen.select("node", "nbr").toDF("u", "w")).toDF("node", "nbr")
        # The last level is the result itself and is not written here.
        if hop < k or max_density is not None:
            front = cut_lineage(front)
        if max_density is not None and front.count() > max_density * n * n:
            raise ValueError(f"hop {hop} fills more than {max_density} of all pairs")
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


def walk_counts(graph: FraudGraph, k: int = 2, max_density: float | None = None) -> DataFrame:
    """Number of directed walks of each length up to k, ``(node, nbr, length, walks)``.

    The result is a list of pairs and may grow to all of them; a power denser than ``max_density`` is an error.
    """
    step = graph.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct().withColumn("walks", F.lit(1))
    step = cut_lineage(step)
    n = graph.nodes.count()
    power = step.withColumn("walks", F.col("walks").cast("double"))
    out = power.withColumn("length", F.lit(1))
    for length in range(2, k + 1):
        right = step.select(F.col("node").alias("mid"), "nbr")
        if length == 2:
            # Every pair starts with one walk: the walks of a pair are its middle nodes.
            counted = block_pairs(step.select("node", "nbr").toDF("u", "v"), right.toDF("v", "w"), paths="walks")
            power = counted.select(F.col("u").alias("node"), F.col("w").alias("nbr"), F.col("walks").cast("double").alias("walks"))
        else:
            left = power.select("node", F.col("nbr").alias("mid"), "walks")
            power = left.join(right, "mid").groupBy("node", "nbr").agg(F.sum("walks").alias("walks"))
        # The last power is the result itself and is not written here.
        if length < k or max_density is not None:
            power = cut_lineage(power)
        if max_density is not None and power.count() > max_density * n * n:
            raise ValueError(f"walks of length {length} fill more than {max_density} of all pairs")
        out = out.unionByName(power.withColumn("length", F.lit(length)))
    return out


def adjacency_list(graph: FraudGraph, chunk: int = 100_000) -> DataFrame:
    """Neighbour ids of every node with the node itself, ``(node, part, nbrs)``.

    A node with more than ``chunk`` neighbours is spread over several parts, so no row grows
    without bound; all others have the single part 0.
    """
    own = graph.nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("nbr"))
    pairs = graph.neighbours().unionByName(own).distinct()
    parts = undirected_degree(pairs, "d").select("node", F.ceil(F.col("d") / chunk).alias("parts"))
    placed = pairs.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("nbr"), F.col("parts")))
    return placed.groupBy("node", "part").agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))


def edge_list(adjacency: DataFrame) -> DataFrame:
    """The inverse, one row per (node, neighbour)."""
    return adjacency.select("node", F.explode("nbrs").alias("nbr"))


def row_normalize(pairs: DataFrame, value: str = "weight", smooth: float = 0.01) -> DataFrame:
    """A_ij / (sum_j A_ij + 0.01)."""
    sums = pairs.groupBy("node").agg(F.sum(value).alias("_sum"))
    return pairs.join(sums, "node").select(*pairs.columns, (F.col(value) / (F.col("_sum") + smooth)).alias("normalized"))
