"""Second-level features made from columns of a feature table ``(node_id, columns..)``."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.functions.linear import correlation, mean_and_std, pca
from ringsight.functions.ordered import (
    blocks_with_halo, column_quantiles, exact_quantiles, melt, with_position,
)
from ringsight.functions.scalars import mean_of, one_row, pop_std_of, safe_div, total
from ringsight.operators.cluster import kmeans_centres, nearest_centres
from ringsight.operators.columns import moments
from ringsight.operators.mixed import forest_importances
from ringsight.session import cut_lineage

EPS = 1e-8


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + EPS)


def _digitize(value: Column, edges: Column, count: int) -> Column:
    """Number of the ``count`` edges at or below the value."""
    return total([(value >= edges[i]).cast("int") for i in range(count)])


def _near_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """The pairs among the first columns: i below 3, j below 4."""
    return [(columns[i], columns[j]) for i in range(min(3, len(columns))) for j in range(i + 1, min(4, len(columns)))]


def _row_shape(cells: list[Column]) -> tuple[Column, Column]:
    mean = mean_of(cells)
    power = lambda p: mean_of([F.pow(c - mean, F.lit(float(p))) for c in cells])
    return F.try_divide(power(3), F.pow(power(2), F.lit(1.5))), F.try_divide(power(4), power(2) * power(2)) - 3


def pair_derived(table: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """Every pair's product, ratio, difference; powers, deciles and z of all (or the first); row statistics."""
    names = [c for c in columns if c in table.columns]
    m = moments(table, names[:first])
    rows = table.withColumn("_q", column_quantiles(table, names[:first], [i / 10 for i in range(1, 10)]))
    out = []
    for a, b in combinations(names, 2):
        x, y = F.col(a), F.col(b)
        out += [
            (x * y).alias(f"important_product_{a}_{b}"), _ratio(x, y).alias(f"important_ratio_{a}_over_{b}"),
            (x - y).alias(f"important_diff_{a}_minus_{b}"), F.abs(x - y).alias(f"important_abs_diff_{a}_{b}"),
        ]
    for c in names[:first]:
        x, std = F.col(c), m[f"{c}_std"] + EPS
        out += [
            (x * x).alias(f"{c}_squared"), (x * x * x).alias(f"{c}_cubed"), F.exp(x / std).alias(f"{c}_exp"),
            _digitize(x, F.col("_q")[c], 9).alias(f"{c}_decile"), (F.abs(x - m[f"{c}_mean"]) / std).alias(f"{c}_zscore_abs"),
        ]
    cells = [F.col(c) for c in names]
    high, low = F.greatest(*cells), F.least(*cells)
    out += [
        mean_of(cells).alias("important_features_mean"), pop_std_of(cells).alias("important_features_std"),
        high.alias("important_features_max"), low.alias("important_features_min"), (high - low).alias("important_features_range"),
        (pop_std_of(cells) / (F.abs(mean_of(cells)) + EPS)).alias("important_features_cv"),
    ]
    if len(names) > 3:
        skew, kurt = _row_shape(cells)
        out += [skew.alias("important_features_skew"), kurt.alias("important_features_kurt")]
    return rows.select("node_id", *out)


def anomaly_derived(table: DataFrame, columns: list[str]) -> DataFrame:
    """X11: statistics, votes over the pooled upper quartile, mean rank, entropy, and pair means."""
    names, n = columns, float(len(columns))
    # Votes compare with the 75 % point of all values of all columns together.
    pooled = melt(table, [], names).select(F.col("value"))
    cut = exact_quantiles(pooled, [], [0.75]).select(F.col("q")[0]).scalar()
    ranks = None
    for c in names:
        # Ordinal rank inside the column; ties follow the node id.
        placed = with_position(table.select("node_id", c), [], [c, "node_id"], f"_r_{c}").select("node_id", f"_r_{c}")
        ranks = placed if ranks is None else ranks.join(placed, "node_id")
    rows = table.select("node_id", *names, cut.alias("_cut")).join(ranks, "node_id")
    cells = [F.col(c) for c in names]
    votes = total([(c > F.col("_cut")).cast("int") for c in cells])
    whole = total(cells) + EPS
    logs = [F.when(F.try_divide(c, whole) + EPS > 0, F.try_divide(c, whole) * F.log(F.try_divide(c, whole) + EPS)).otherwise(0.0) for c in cells]
    out = [
        mean_of(cells).alias("anomaly_score_mean"), pop_std_of(cells).alias("anomaly_score_std"),
        F.greatest(*cells).alias("anomaly_score_max"), F.least(*cells).alias("anomaly_score_min"),
        votes.alias("anomaly_vote_count"), (votes / F.lit(n)).alias("anomaly_vote_ratio"),
        (mean_of([F.col(f"_r_{c}").cast("double") for c in names]) / F.lit(n)).alias("anomaly_avg_rank"),
        (-total(logs)).alias("anomaly_entropy"),
    ]
    if len(names) > 2:
        out.append(mean_of([a * b for a, b in combinations(cells, 2)]).alias("anomaly_feature_correlation"))
    for a, b in _near_pairs(names):
        x, y = F.col(a), F.col(b)
        out += [
            (x * y).alias(f"anomaly_product_{a}_{b}"), F.abs(x - y).alias(f"anomaly_diff_{a}_{b}"),
            _ratio(2 * x * y, x + y).alias(f"anomaly_harmonic_{a}_{b}"),
        ]
    return rows.select("node_id", *out)


def embedding_shape(table: DataFrame, columns: list[str]) -> DataFrame:
    """X12, closed part: norms, cosine to the mean vector, row statistics and near pairs."""
    m = one_row(table.agg(*[F.avg(c).alias(c) for c in columns]))
    cells = [F.col(c) for c in columns]
    norm = F.sqrt(total([c * c for c in cells]))
    dot, length = total([F.col(c) * m[c] for c in columns]), F.sqrt(total([m[c] * m[c] for c in columns]))
    out = [
        norm.alias("embedding_norm"), total([F.abs(c) for c in cells]).alias("embedding_l1_norm"),
        safe_div(dot, norm * length).alias("embedding_cosine_to_mean"), mean_of(cells).alias("embedding_dim_mean"),
        pop_std_of(cells).alias("embedding_dim_std"), F.greatest(*cells).alias("embedding_dim_max"), F.least(*cells).alias("embedding_dim_min"),
    ]
    for a, b in _near_pairs(columns):
        out += [(F.col(a) * F.col(b)).alias(f"embedding_dot_{a}_{b}"), F.abs(F.col(a) - F.col(b)).alias(f"embedding_dist_{a}_{b}")]
    return table.select("node_id", *out)


def embedding_model(table: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """X12, fitted part: three components, mean correlation, cluster, distance and cluster share."""
    corr = correlation(table, columns)
    np.fill_diagonal(corr, 0.0)
    mean, std = mean_and_std(table, columns)
    cov = correlation(table, columns) * np.outer(std, std)
    values = np.linalg.eigvalsh(cov)
    placed = cut_lineage(nearest_centres(table, columns, kmeans_centres(table, columns, k, seed), "e"))
    sizes = placed.groupBy("e_cluster").agg(F.count(F.lit(1)).alias("_size"))
    n = placed.agg(F.count(F.lit(1))).scalar()
    clusters = placed.join(sizes, "e_cluster").select(
        "node_id", F.col("e_cluster").alias("embedding_cluster"), F.col("e_min_dist").alias("embedding_cluster_min_distance"),
        (F.col("_size") / n).alias("embedding_cluster_size"),
    )
    scores = pca(table, columns, 3, "embedding_pca_")
    return scores.join(clusters, "node_id").withColumns({
        "embedding_pca_explained_ratio": F.lit(float(values.max() / max(values.sum(), 1e-300))),
        "embedding_dim_correlation": F.lit(float(np.abs(corr).mean())),
    })


def stats_of_stats(table: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """Mean, std, CV and consistency over the columns, a scaled sum, and levels of all (or the first)."""
    lead = columns[:first]
    m = moments(table, columns)
    q = column_quantiles(table, lead, [i / 10 for i in range(1, 10)])
    rows = table.select("node_id", *columns, q.alias("_q"))
    cells = [F.col(c) for c in columns]
    mean, std = mean_of(cells), pop_std_of(cells)
    size = mean_of([F.abs(c) for c in cells])

    def weighted(c: str) -> Column:
        scale = m[f"{c}_std"] + EPS
        # The variance of x / scale is (std / scale)^2.
        share = m[f"{c}_std"] / scale
        return F.col(c) / scale / (1 + share * share)

    out = [
        mean.alias("stats_of_stats_mean"), std.alias("stats_of_stats_std"), (std / (F.abs(mean) + EPS)).alias("stats_of_stats_cv"),
        F.when(std > 0, F.try_divide(F.lit(1.0), F.try_divide(std, size) + EPS)).otherwise(0.0).alias("stats_consistency"),
        total([weighted(c) for c in columns]).alias("stats_weighted_sum"),
    ]
    for c in lead:
        x, edges = F.col(c), F.col("_q")[c]
        low, high = m[f"{c}_mean"] - m[f"{c}_std"], m[f"{c}_mean"] + m[f"{c}_std"]
        out += [
            total([(x >= edges[i]).cast("int") for i in (1, 3, 5, 7)]).alias(f"{c}_quintile"), _digitize(x, edges, 9).alias(f"{c}_decile"),
            F.when(m[f"{c}_std"] > 0, F.when(x < low, 0).when(x <= high, 1).otherwise(2)).alias(f"{c}_zscore_bin"),
        ]
    for a, b in _near_pairs(columns):
        out += [(F.col(a) * F.col(b)).alias(f"stats_product_{a}_{b}"), _ratio(F.col(a), F.col(b)).alias(f"stats_ratio_{a}_over_{b}")]
    return rows.select("node_id", *out)


def interaction_derived(table: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """Triple products and harmonic means, row statistics, and level, log and root of all (or the first)."""
    lead = columns[:first]
    q = column_quantiles(table, lead, [0.25, 0.75])
    rows = table.select("node_id", *columns, q.alias("_q"))
    out = []
    n = len(columns)
    triples = [
        (i, j, k) for i in range(min(3, n)) for j in range(i + 1, min(4, n)) for k in range(j + 1, min(5, n))
    ]
    for triple in triples:
        parts = [columns[i] for i in triple]
        tag = "_".join(parts)
        inverse = total([F.try_divide(F.lit(1.0), F.col(c) + EPS) for c in parts])
        out += [
            (F.col(parts[0]) * F.col(parts[1]) * F.col(parts[2])).alias(f"interaction_triple_{tag}"),
            F.try_divide(F.lit(3.0), inverse).alias(f"interaction_harmonic_triple_{tag}"),
        ]
    cells = [F.col(c) for c in columns]
    out += [
        mean_of(cells).alias("interaction_mean"), pop_std_of(cells).alias("interaction_std"),
        F.greatest(*cells).alias("interaction_max"), F.least(*cells).alias("interaction_min"),
    ]
    for c in lead:
        x, edges = F.col(c), F.col("_q")[c]
        out += [
            F.when(x <= edges[0], 0).when(x <= edges[1], 1).otherwise(2).alias(f"{c}_level"),
            F.log1p(F.abs(x)).alias(f"{c}_log1p"), F.sqrt(F.abs(x)).alias(f"{c}_sqrt"),
        ]
    return rows.select("node_id", *out)


def binning_derived(table: DataFrame, columns: list[str], clusters: int = 5, seed: int = 42) -> DataFrame:
    """Equal-width, equal-frequency and one-dimensional cluster bins, and the mean of every frequency bin.

    Columns with fewer than five distinct values are skipped; ``clusters=0`` leaves the fitted bins out.
    """
    head = table.agg(*[F.countDistinct(c).alias(f"d_{c}") for c in columns], *[F.min(c).alias(f"a_{c}") for c in columns],
                     *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    used = [c for c in columns if head[f"d_{c}"] >= 5]
    bins = {c: min(10, head[f"d_{c}"] // 2) for c in used}
    probs = sorted({round(i / bins[c], 12) for c in used for i in range(1, bins[c])})
    q = column_quantiles(table, used, probs)
    rows = cut_lineage(table.select("node_id", *used, q.alias("_q")))
    out, freq = [], {}
    for c in used:
        x, n = F.col(c), bins[c]
        low, high = float(head[f"a_{c}"]), float(head[f"b_{c}"])
        if high > low:
            width = (high - low) / n
            out.append(total([(x >= F.lit(low + i * width)).cast("int") for i in range(1, n)]).alias(f"{c}_equal_width_bin"))
        places = [probs.index(round(i / n, 12)) for i in range(1, n)]
        freq[c] = total([(x >= F.col("_q")[c][p]).cast("int") for p in places])
        out.append(freq[c].alias(f"{c}_equal_freq_bin"))
    means = rows.agg(*[
        F.avg(F.when(freq[c] == b, F.col(c))).alias(f"{c}_bin{b}") for c in used for b in range(bins[c])
    ]).first().asDict()
    out += [F.lit(float(v)).alias(f"{name}_mean_ref") for name, v in means.items() if v is not None]
    binned = rows.select("node_id", *out)
    if not clusters:
        return binned
    for c in used:
        k = min(clusters, head[f"d_{c}"] // 3)
        if k >= 2:
            centres = np.sort(kmeans_centres(rows, [c], k, seed), axis=0).ravel()
            middle = (centres[1:] + centres[:-1]) / 2
            label = total([(F.col(c) > F.lit(float(v))).cast("int") for v in middle])
            binned = binned.join(rows.select("node_id", label.alias(f"{c}_cluster_bin")), "node_id")
    return binned


# --- X16-X18: row windows over the id order ----------------------------------------------------------

def _in_order(table: DataFrame, columns: list[str], before: int, after: int = 0):
    """Rows in blocks of the id order with copied edges, and the window over one block."""
    placed = with_position(table.select("node_id", *columns), [], ["node_id"])
    blocks = blocks_with_halo(placed, "pos", before=before, after=after)
    return blocks, Window.partitionBy("_block").orderBy("pos")


def rolling(table: DataFrame, columns: list[str], sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Trailing mean, population std, max, min and change over the last w rows."""
    rows, w = _in_order(table, columns, before=max(sizes) - 1)
    made = {}
    for c in columns:
        for size in sizes:
            frame = w.rowsBetween(-(size - 1), 0)
            for name, how in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min)):
                made[f"{c}_rolling_{name}_ws{size}"] = how(c).over(frame)
    change = {
        f"{c}_rolling_change_ws{size}": F.col(c) - F.col(f"{c}_rolling_mean_ws{size}") for c in columns for size in sizes
    }
    out = rows.withColumns(made).where(~F.col("_halo")).withColumns(change)
    return out.select("node_id", *made, *change)


def lags(table: DataFrame, columns: list[str], steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Earlier values (the first value before the start), differences and ratios."""
    first = one_row(table.agg(*[F.min_by(c, "node_id").alias(c) for c in columns]))
    rows, w = _in_order(table, columns, before=max(steps))
    shifted = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in steps}
    kept = rows.withColumns(shifted).where(~F.col("_halo"))
    filled = kept.withColumns({f"{c}_lag{k}": F.coalesce(f"{c}_lag{k}", first[c]) for c in columns for k in steps})
    out = []
    for c in columns:
        for k in steps:
            then = F.col(f"{c}_lag{k}")
            out += [then, (F.col(c) - then).alias(f"{c}_lag{k}_diff"), _ratio(F.col(c), then).alias(f"{c}_lag{k}_ratio")]
    return filled.select("node_id", *out)


def local_trend(table: DataFrame, columns: list[str], half: int = 10) -> DataFrame:
    """Least-squares slope over the ten rows before and the ten rows from the current one on."""
    rows, w = _in_order(table, columns, before=half, after=half - 1)
    frame = w.rowsBetween(-half, half - 1)
    enough = F.count(F.lit(1)).over(frame) > 3
    slopes = {f"{c}_pseudo_trend": F.when(enough, F.regr_slope(F.col(c), F.col("pos").cast("double")).over(frame)).otherwise(0.0) for c in columns}
    return rows.withColumns(slopes).where(~F.col("_halo")).select("node_id", *slopes)


def importance_derived(table: DataFrame, columns: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Clusters of ten components as pseudo labels; forest importances, their sum, ranks and entropy."""
    reduced = cut_lineage(pca(table, columns, min(10, len(columns)), "_p"))
    parts = [c for c in reduced.columns if c != "node_id"]
    placed = nearest_centres(reduced, parts, kmeans_centres(reduced, parts, k, seed), "c")
    labels = cut_lineage(placed.select("node_id", F.col("c_cluster").alias("cluster")))
    weights = forest_importances(table, columns, labels, 50, seed)
    order = np.argsort(weights, kind="stable")
    ranks = np.argsort(order, kind="stable")
    shares = weights / max(weights.sum(), 1e-300)
    out = [total([F.col(c) * F.lit(float(v)) for c, v in zip(columns, weights)]).alias("importance_weighted_sum")]
    out += [F.col(columns[i]).alias(f"important_{columns[i]}") for i in order[-5:]]
    out += [F.lit(float(ranks[i])).alias(f"{columns[i]}_importance_rank") for i in range(max(0, len(columns) - 10), len(columns))]
    out.append(F.lit(float(-(shares * np.log(shares + 1e-8)).sum())).alias("feature_importance_entropy"))
    return table.select("node_id", *out)
