"""Outlier scores of nodes: isolation forest, local outlier factor, distances and z-scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.linear import covariance, project
from ringsight.functions.ordered import column_quantiles
from ringsight.functions.sampling import first_k
from ringsight.functions.scalars import SEED, finite, mean_of, one_row, safe_div, seeded_hash, seeded_unit, total
from ringsight.graph import FraudGraph
from ringsight.operators.columns import moments
from ringsight.operators.nearest import nearest_rows, points_of
from ringsight.operators.structure import undirected_degree
from ringsight.session import cut_lineage


def _minmax(scored: DataFrame, raw: str, name: str) -> DataFrame:
    scored = cut_lineage(scored)
    m = one_row(scored.agg(F.min(raw).alias("low"), F.max(raw).alias("high")))
    return scored.select("node_id", ((F.col(raw) - m["low"]) / (m["high"] - m["low"] + 1e-8)).alias(name))


def seeded_sample(rows: DataFrame, size: int, seed: int | str = SEED) -> DataFrame:
    """The ``size`` rows with the smallest hash; a threshold keeps the sort small on large tables."""
    n = rows.count()
    share = min(1.0, (2.0 * size + 40.0) / max(n, 1))
    picked = rows.where(seeded_unit("node_id", seed=seed) < F.lit(share))
    return picked.orderBy(seeded_hash("node_id", seed=seed), "node_id").limit(size)


# --- O1: isolation forest ---------------------------------------------------------------------------

def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.RandomState, limit: int) -> list[list[float]]:
    """Rows ``feature, cut, left, right, depth value`` of one random tree; leaves have feature -1."""
    nodes: list[list[float]] = []
    queue = [(points, 0, -1, 0)]
    while queue:
        rows, depth, parent, side = queue.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][side] = me
        low, high = rows.min(axis=0), rows.max(axis=0)
        free = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(free):
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, 0.0])
        below = rows[:, f] < cut
        queue += [(rows[~below], depth + 1, me, 3), (rows[below], depth + 1, me, 2)]
    return nodes


def isolation_forest(rows: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = SEED) -> DataFrame:
    """O1: random trees on seeded samples, mean depth over all of them, scaled so that 1 is most anomalous.

    The samples hold trees x sample rows at most; every tree grows in its own task and all rows are
    scored in batches.
    """
    n = rows.count()
    # A draw per tree and row: twice as many as needed pass the threshold, the first of them stay.
    share = min(1.0, (2.0 * sample + 40.0) / max(n, 1))
    spread = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(
        seeded_unit("tree", "node_id", seed=seed) < F.lit(share)
    )
    dealt = first_k(spread, ["tree"], [seeded_hash("tree", "node_id", seed=seed), "node_id"], sample)

    def grow(block: pd.DataFrame) -> pd.DataFrame:
        tree = int(block["tree"].iloc[0])
        points = block.sort_values("node_id")[columns].to_numpy(dtype=float)
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        table = pd.DataFrame(_grow(points, np.random.RandomState(seed + tree), limit), columns=["f", "cut", "l", "r", "depth"])
        return table.assign(tree=tree, node=np.arange(len(table)))[["tree", "node", "f", "cut", "l", "r", "depth"]]

    schema = "tree int, node int, f int, cut double, l int, r int, depth double"
    forest = dealt.select("tree", "node_id", *columns).groupBy("tree").applyInPandas(grow, schema).toPandas()
    grown = [t.sort_values("node") for _, t in forest.groupby("tree")]
    arrays = [tuple(t[c].to_numpy() for c in ("f", "cut", "l", "r", "depth")) for t in grown]
    shared = rows.sparkSession.sparkContext.broadcast(arrays)
    typical = float(_average_path(min(sample, n)))

    def score(batches):
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            depth, everyone = np.zeros(len(x)), np.arange(len(x))
            for f, cut, left, right, value in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = f[at] >= 0
                    if not inner.any():
                        break
                    i, a = everyone[inner], at[inner]
                    at[inner] = np.where(x[i, f[a]] < cut[a], left[a], right[a])
                depth += value[at]
            yield pd.DataFrame({"node_id": batch["node_id"], "raw": 2.0 ** (-depth / len(shared.value) / max(typical, 1e-9))})

    return _minmax(rows.select("node_id", *columns).mapInPandas(score, "node_id bigint, raw double"), "raw", "isolation_forest_score")


# --- O2: local outlier factor --------------------------------------------------------------------------

def local_outlier_factor(rows: DataFrame, columns: list[str], k: int = 20, seed: int = SEED) -> DataFrame:
    """O2: outlier factor from the k nearest of all rows; higher is more anomalous.

    The neighbours are exact (``nearest_rows``): equal rows are neighbours at distance 0, ties go to the
    smaller id, and rows that are equal get one score. ``seed`` only chooses the cells.
    """
    clean, points = points_of(rows, columns)
    points = cut_lineage(points)
    near = cut_lineage(nearest_rows(points, k, seed))
    reach = near.groupBy(F.col("pid").alias("near")).agg(F.max("away").alias("kth"))
    met = near.join(reach, "near")
    dense = cut_lineage(met.groupBy("pid").agg(
        (1 / (F.sum(F.greatest("away", "kth") * F.col("copies")) / F.sum("copies") + 1e-10)).alias("dense")
    ))
    around = near.join(dense.withColumnRenamed("pid", "near"), "near").groupBy("pid").agg(
        (F.sum(F.col("dense") * F.col("copies")) / F.sum("copies")).alias("around")
    )
    scores = around.join(dense, "pid").select("pid", (F.col("around") / F.col("dense")).alias("raw"))
    placed = points.join(scores, "pid", "left").select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)], "raw")
    # A row without any other has no neighbours: as dense as its surroundings.
    return _minmax(clean.join(placed, columns).select("node_id", F.coalesce("raw", F.lit(1.0)).alias("raw")), "raw", "lof_score")


# --- O3: Mahalanobis --------------------------------------------------------------------------------------

def mahalanobis(rows: DataFrame, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """O3: sqrt(d' C^-1 d) with the sample covariance plus a small ridge, over its maximum."""
    mean, cov = covariance(rows, columns)
    n = rows.count()
    inverse = np.linalg.pinv(cov * n / max(n - 1, 1) + ridge * np.eye(len(columns)))
    values, basis = np.linalg.eigh((inverse + inverse.T) / 2)
    root = basis * np.sqrt(np.maximum(values, 0.0))
    moved = rows.select("node_id", *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(columns, mean)])
    whitened = project(moved, columns, root, "_w")
    length = F.sqrt(total([F.col(f"_w{j}") * F.col(f"_w{j}") for j in range(len(columns))]))
    raw = cut_lineage(whitened.select("node_id", length.alias("raw")))
    top = raw.agg(F.max("raw")).scalar()
    return raw.select("node_id", F.when(top > 0, F.try_divide(F.col("raw"), top)).otherwise(F.col("raw")).alias("mahalanobis_distance"))


# --- O4-O7: columns ---------------------------------------------------------------------------------------

def _abs_z(c: str, m: Column) -> Column:
    return F.when(m[f"{c}_std"] > 0, F.try_divide(F.abs(F.col(c) - m[f"{c}_mean"]), m[f"{c}_std"])).otherwise(0.0)


def stat_zscore(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Largest and mean |z| over the columns, and the share above 3."""
    m = moments(rows, columns)
    z = rows.select("node_id", *[_abs_z(c, m).alias(c) for c in columns])
    cells = [F.col(c) for c in columns]
    return z.select(
        "node_id", F.greatest(*cells).alias("stat_max_zscore"), mean_of(cells).alias("stat_mean_zscore"),
        mean_of([(c > 3).cast("double") for c in cells]).alias("stat_zscore_gt3_ratio"),
    )


def iqr_outlier(rows: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """Largest distance beyond the 1.5 IQR fences, in IQRs, over all columns (or the first)."""
    names = columns[:first]
    q = column_quantiles(rows, names, [0.25, 0.75])
    placed = rows.select("node_id", *names, q.alias("_q"))

    def beyond(c: str) -> Column:
        low, high = F.col("_q")[c][0], F.col("_q")[c][1]
        iqr = high - low
        x = F.col(c)
        over = F.when(x < low - 1.5 * iqr, low - 1.5 * iqr - x).when(x > high + 1.5 * iqr, x - high - 1.5 * iqr).otherwise(0.0)
        return F.when(iqr > 0, F.try_divide(over, iqr)).otherwise(0.0)

    scores = [beyond(c) for c in names] + [F.lit(0.0)]
    return placed.select("node_id", F.greatest(*scores).alias("stat_max_iqr_outlier"))


def column_moments(rows: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """|skewness| and |excess kurtosis| of all columns (or the first), as constants."""
    names = columns[:first]
    m = one_row(rows.agg(
        *[F.skewness(c).alias(f"{c}_s") for c in names], *[F.kurtosis(c).alias(f"{c}_k") for c in names]
    ))
    out = []
    for i, c in enumerate(names):
        for tag, name in (("s", "skewness"), ("k", "kurtosis")):
            out.append(F.abs(m[f"{c}_{tag}"]).alias(f"stat_feat{i}_{name}_abs"))
    return rows.select("node_id", *out)


def product_zscore(rows: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """|z| of the products of all pairs of columns (or of the first)."""
    pairs = [(i, j) for i in range(len(columns[:first])) for j in range(i + 1, len(columns[:first]))]
    made = rows.select("node_id", *[(F.col(columns[i]) * F.col(columns[j])).alias(f"p_{i}_{j}") for i, j in pairs])
    m = moments(made, [f"p_{i}_{j}" for i, j in pairs])
    return made.select("node_id", *[
        (F.abs(F.col(f"p_{i}_{j}") - m[f"p_{i}_{j}_mean"]) / (m[f"p_{i}_{j}_std"] + 1e-8)).alias(f"stat_product_{i}_{j}_zscore")
        for i, j in pairs
    ])


# --- O8-O10: graph -------------------------------------------------------------------------------------------

def degree_zscore(graph: FraudGraph) -> DataFrame:
    """|z| of the degree and of its log."""
    d = graph.attach(undirected_degree(graph.neighbours(), "d").withColumnRenamed("node", "node_id")).fillna(0)
    rows = d.select("node_id", F.col("d").cast("double").alias("degree"), F.log1p("d").alias("log"))
    m = moments(rows, ["degree", "log"])
    return rows.select("node_id", _abs_z("degree", m).alias("graph_degree_zscore"), _abs_z("log", m).alias("graph_degree_log_zscore"))


def neighbour_feature_diff(graph: FraudGraph) -> DataFrame:
    """Distance to the neighbours' mean and mean of their population stds, each over its maximum."""
    names = graph.feature_names
    values = graph.features().withColumnRenamed("node_id", "nbr")
    near = graph.neighbours().join(values, "nbr").groupBy(F.col("node").alias("node_id")).agg(
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]
    )
    rows = graph.features().join(near, "node_id", "left")
    diff = F.sqrt(total([(F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in names]))
    raw = cut_lineage(rows.select("node_id", diff.alias("d"), mean_of([F.col(f"s_{c}") for c in names]).alias("s")).fillna(0.0))
    m = one_row(raw.agg(F.max("d").alias("d"), F.max("s").alias("s")))
    return raw.select(
        "node_id", safe_div(F.col("d"), m["d"]).alias("graph_neighbor_feature_diff"),
        safe_div(F.col("s"), m["s"]).alias("graph_neighbor_feature_std"),
    )


def bridging(graph: FraudGraph) -> DataFrame:
    """One minus the degree over the largest degree."""
    d = graph.attach(undirected_degree(graph.neighbours(), "d").withColumnRenamed("node", "node_id")).fillna(0)
    top = d.agg(F.max("d")).scalar()
    return d.select("node_id", F.when(top > 0, 1 - safe_div(F.col("d"), top)).otherwise(0.0).alias("graph_bridging_score"))


# --- O11 -------------------------------------------------------------------------------------------------------

MARKS = ("score", "distance", "zscore", "outlier")


def combined_anomaly(scores: DataFrame, most: int | None = None, threshold: float = 0.5) -> DataFrame:
    """Mean, max, std, entropy and votes over all score columns (or the first)."""
    names = [c for c in scores.columns if c != "node_id" and any(mark in c.lower() for mark in MARKS)][:most]
    # One array and folds over it: written out, the shares of many columns grow with their square.
    size, add = F.lit(float(len(names))), lambda acc, x: acc + x
    cells = scores.select("node_id", F.array(*[finite(F.col(c)) for c in names]).alias("c"))
    sums = cells.select("node_id", "c", F.aggregate("c", F.lit(0.0), add).alias("s"))
    level = sums.select("node_id", "c", (F.col("s") / size).alias("mean"), (F.col("s") + 1e-8).alias("whole"))
    spread = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean")))

    def log_share(x: Column) -> Column:
        share = x / F.col("whole")
        # A share may be negative for scores below zero; such logs have no value and count 0.
        return F.when(share + 1e-8 > 0, share * F.log(share + 1e-8)).otherwise(0.0)

    votes = F.size(F.filter("c", lambda x: x > threshold))
    return level.select(
        "node_id", F.col("mean").alias("combined_mean_anomaly_score"), F.array_max("c").alias("combined_max_anomaly_score"),
        F.sqrt(spread / size).alias("combined_anomaly_score_std"),
        (-F.aggregate("c", F.lit(0.0), lambda acc, x: acc + log_share(x))).alias("combined_anomaly_score_entropy"),
        votes.alias("combined_anomaly_vote_count"), (votes / size).alias("combined_anomaly_vote_ratio"),
    )


def column_scores(graph: FraudGraph) -> DataFrame:
    """The scores that need no sampling, side by side."""
    rows, names = graph.features(), graph.feature_names
    return graph.attach(
        stat_zscore(rows, names), iqr_outlier(rows, names), product_zscore(rows, names), degree_zscore(graph), bridging(graph)
    )
