"""Polynomials, projections, independent components, and per-row and per-table feature statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.linear import correlation, covariance, fix_signs, gaussian, pca, project, vectors
from ringsight.functions.scalars import SEED, mean_of, pop_std_of, seeded_unit, total
from ringsight.operators.cluster import kmeans_centres, nearest_centres
from ringsight.session import cut_lineage


def polynomial(rows: DataFrame, columns: list[str], over: int | None = None, keep: int | None = None) -> DataFrame:
    """All columns (or the first ``over``) and their pairwise products; with ``keep`` so many terms, padded with 0."""
    names = columns[:over]
    terms = [F.col(c) for c in names]
    terms += [F.col(names[i]) * F.col(names[j]) for i in range(len(names)) for j in range(i + 1, len(names))]
    terms += [F.lit(0.0)] * max(0, (keep or 0) - len(terms))
    return rows.select("node_id", *[t.alias(f"poly_feat_{i}") for i, t in enumerate(terms[:keep])])


def pca_components(rows: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Principal component scores; the largest loading of each is positive."""
    return pca(rows, columns, min(k, len(columns)), "pca_component_")


def ica_components(
    rows: DataFrame, columns: list[str], k: int = 10, iterations: int = 100, tolerance: float = 1e-4, seed: int = SEED
) -> DataFrame:
    """Independent components by fixed-point steps on whitened rows (tanh contrast).

    Each step is one pass that adds up a k x k block per task; only that block reaches the driver.
    """
    mean, cov = covariance(rows, columns)
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(k, int((values > values.max() * 1e-10).sum()))]
    whiten = fix_signs(basis[:, order]) / np.sqrt(values[order])
    moved = rows.select("node_id", *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(columns, mean)])
    white = cut_lineage(project(moved, columns, whiten, "z"))
    names = [f"z{j}" for j in range(len(order))]
    n = white.count()
    w = _decorrelate(np.random.RandomState(seed).standard_normal((len(order), len(order))))
    for _ in range(iterations):
        step = w

        def partial(batches):
            block, slope = np.zeros(step.shape), np.zeros(len(step))
            for batch in batches:
                z = batch[names].to_numpy(dtype=float)
                g = np.tanh(z @ step.T)
                block += g.T @ z
                slope += (1.0 - g**2).sum(axis=0)
            yield pd.DataFrame({"cell": np.arange(block.size + slope.size), "value": np.concatenate([block.ravel(), slope])})

        cells = white.select(*names).mapInPandas(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        flat = np.zeros(w.size + len(w))
        for row in cells.collect():  # k * (k + 1) numbers
            flat[row["cell"]] = row["value"]
        fresh = _decorrelate(flat[: w.size].reshape(w.shape) / n - np.diag(flat[w.size :] / n) @ w)
        moved_by = np.max(np.abs(np.abs(np.einsum("ij,ij->i", fresh, w)) - 1.0))
        w = fresh
        if moved_by < tolerance:
            break
    return project(white, names, w.T, "ica_component_")


def _decorrelate(w: np.ndarray) -> np.ndarray:
    values, basis = np.linalg.eigh(w @ w.T)
    return basis @ np.diag(1.0 / np.sqrt(np.maximum(values, 1e-12))) @ basis.T @ w


def random_projection(rows: DataFrame, columns: list[str], k: int = 15, seed: int = SEED) -> DataFrame:
    """Projection by a fixed Gaussian matrix of variance 1/k."""
    k = min(k, len(columns))
    return project(rows, columns, gaussian(len(columns), k, seed) / np.sqrt(k), "random_proj_")


def _constants(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    return rows.select("node_id", *[F.lit(float(v)).alias(k) for k, v in values.items()])


def selection_scores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean variance, mean and largest absolute correlation, as constants."""
    spread = rows.agg(*[F.var_pop(c) for c in columns]).first()
    corr = correlation(rows, columns)
    np.fill_diagonal(corr, 0.0)
    return _constants(rows, {
        "feature_variance_score": float(np.mean(list(spread))),
        "feature_avg_correlation": float(np.abs(corr).mean()), "feature_max_correlation": float(np.abs(corr).max()),
    })


# Distribution function of the Poisson law with mean one.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def bootstrap_weight(round_: int, seed: int = SEED) -> Column:
    """Number of times a row is drawn in a bootstrap round, from its hash."""
    u = seeded_unit(F.lit(round_), "node_id", seed=seed)
    return total([(u > F.lit(p)).cast("int") for p in POISSON])


def bootstrap_stability(rows: DataFrame, columns: list[str], rounds: int = 5, seed: int = SEED) -> DataFrame:
    """Mean over the columns of 1 / std of their variances over bootstrap rounds.

    All rounds are weighted sums of one pass; the columns should be scaled.
    """
    weighted = rows.select(*columns, *[bootstrap_weight(r, seed).cast("double").alias(f"w{r}") for r in range(rounds)])
    aggs = [F.sum(f"w{r}").alias(f"n{r}") for r in range(rounds)]
    for r in range(rounds):
        for c in columns:
            aggs += [F.sum(F.col(f"w{r}") * F.col(c)).alias(f"s{r}_{c}"), F.sum(F.col(f"w{r}") * F.col(c) * F.col(c)).alias(f"q{r}_{c}")]
    table = weighted.agg(*aggs).select(F.array(*[
        F.array(*[
            F.col(f"q{r}_{c}") / F.col(f"n{r}") - (F.col(f"s{r}_{c}") / F.col(f"n{r}")) * (F.col(f"s{r}_{c}") / F.col(f"n{r}"))
            for r in range(rounds)
        ]) for c in columns
    ]).alias("v"))
    score = mean_of([1.0 / (pop_std_of([F.col("v")[i][r] for r in range(rounds)]) + 1e-8) for i in range(len(columns))])
    return rows.select("node_id", table.select(score).scalar().alias("feature_stability_score"))


def forest_importances(rows: DataFrame, columns: list[str], labels: DataFrame, trees: int = 50, seed: int = SEED) -> np.ndarray:
    """Importances of a random forest that predicts ``labels(node_id, cluster)``."""
    table = vectors(rows.join(labels, "node_id"), columns, ["cluster"]).withColumn("cluster", F.col("cluster").cast("double"))
    forest = RandomForestClassifier(featuresCol="_v", labelCol="cluster", numTrees=trees, seed=seed)
    return forest.fit(table).featureImportances.toArray()


def pseudo_importance(rows: DataFrame, columns: list[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Clusters as pseudo labels, forest importances, and rows weighted by them."""
    placed = nearest_centres(rows, columns, kmeans_centres(rows, columns, k, seed), "p")
    labels = cut_lineage(placed.select("node_id", F.col("p_cluster").alias("cluster")))
    weights = forest_importances(rows, columns, labels, 50, seed)
    weighted = total([F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights)])
    return rows.select(
        "node_id", F.lit(float(weights.mean())).alias("feature_importance_mean"), F.lit(float(weights.std())).alias("feature_importance_std"),
        F.lit(float(weights.max())).alias("feature_importance_max"), weighted.alias("feature_weighted_sum"),
    )


def row_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Norms, range, moments, entropy and Gini coefficient of every row."""
    cells = [F.col(c) for c in columns]
    sizes = [F.abs(c) for c in cells]
    n = len(cells)
    m = rows.select("node_id", *columns, mean_of(cells).alias("_m"), total(sizes).alias("_l1"))
    away = [F.col(c) - F.col("_m") for c in columns]
    power = lambda p: mean_of([F.pow(a, F.lit(float(p))) for a in away])
    m = m.withColumns({"_2": power(2), "_3": power(3), "_4": power(4)})
    whole = F.col("_l1") + 1e-8
    entropy = -total([(s / whole) * F.log(s / whole + 1e-8) for s in sizes])
    # Mean of the running sums of the sorted sizes: the i-th of n counts n - i times.
    ordered = F.array_sort(F.array(*sizes))
    running = total([F.element_at(ordered, i + 1) * F.lit(float(n - i)) for i in range(n)]) / n
    return m.select(
        "node_id", F.col("_l1").alias("feature_l1_norm"), F.sqrt(total([c * c for c in cells])).alias("feature_l2_norm"),
        F.greatest(*cells).alias("feature_max"), F.least(*cells).alias("feature_min"),
        (F.greatest(*cells) - F.least(*cells)).alias("feature_range"), F.col("_m").alias("feature_mean"),
        F.sqrt("_2").alias("feature_std"), F.try_divide(F.col("_3"), F.pow("_2", F.lit(1.5))).alias("feature_skewness"),
        (F.try_divide(F.col("_4"), F.col("_2") * F.col("_2")) - 3).alias("feature_kurtosis"), entropy.alias("feature_entropy"),
        (1 - 2 * running / whole).alias("feature_gini"),
    )


def complexity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number of columns, effective rank and mean absolute correlation, as constants."""
    _, cov = covariance(rows, columns)
    n = rows.count()
    shares = np.linalg.eigvalsh(cov * n / max(n - 1, 1))
    shares = shares / (shares.sum() + 1e-8)
    corr = correlation(rows, columns)
    np.fill_diagonal(corr, 0.0)
    return _constants(rows, {
        "feature_dimensionality": float(len(columns)),
        "feature_effective_dim": float(np.exp(-np.sum(shares * np.log(np.maximum(shares, 0.0) + 1e-8)))),
        "feature_redundancy": float(np.abs(corr).mean()),
    })
