"""K-means clusters and what they say about nodes and their neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.linear import vectors
from ringsight.functions.scalars import safe_div, total
from ringsight.graph import FraudGraph
from ringsight.operators.structure import undirected_degree
from ringsight.session import cut_lineage


def kmeans_centres(rows: DataFrame, columns: list[str], k: int, seed: int = 42, iterations: int = 20) -> np.ndarray:
    """Cluster centres: k rows, whatever the size of the table."""
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_v").fit(vectors(rows, columns, []))
    return np.array(model.clusterCenters())


def nearest_centres(rows: DataFrame, columns: list[str], centres: np.ndarray, prefix: str, key: str = "node_id") -> DataFrame:
    """K1/K2: cluster, distance to the nearest and to the second nearest centre."""
    names = [f"{prefix}_cluster", f"{prefix}_min_dist", f"{prefix}_nearest_cluster", f"{prefix}_second_min_dist"]

    def place(batches):
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            away = np.sqrt(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
            best = away.argmin(axis=1) if len(away) else np.zeros(0, dtype=int)
            two = np.sort(away, axis=1)
            second = two[:, 1] if two.shape[1] > 1 else np.full(len(two), np.inf)
            yield pd.DataFrame({key: batch[key], names[0]: best, names[1]: two[:, 0], names[2]: best, names[3]: second})

    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {names[0]} int, {names[1]} double, {names[2]} int, {names[3]} double"
    return rows.select(key, *columns).mapInPandas(place, schema)


def cluster_size(clusters: DataFrame, prefix: str) -> DataFrame:
    """K3: size of the own cluster and its share; ``clusters(node_id, cluster)``."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias(f"{prefix}_cluster_size"))
    n = clusters.agg(F.count(F.lit(1))).scalar()
    joined = clusters.join(sizes, "cluster")
    return joined.select("node_id", f"{prefix}_cluster_size", (F.col(f"{prefix}_cluster_size") / n).alias(f"{prefix}_cluster_size_norm"))


def cluster_density(rows: DataFrame, columns: list[str], clusters: DataFrame, prefix: str) -> DataFrame:
    """K4: root mean square distance between the points of a cluster, over all its pairs; 0 for a single point.

    The mean squared distance of all pairs is twice the sum of the columns' sample variances.
    """
    spread = total([F.coalesce(F.var_samp(c), F.lit(0.0)) for c in columns])
    density = rows.join(clusters, "node_id").groupBy("cluster").agg(F.sqrt(2 * spread).alias("density"))
    return clusters.join(density, "cluster").select("node_id", F.col("density").alias(f"{prefix}_cluster_density"))


def silhouette(rows: DataFrame, columns: list[str], clusters: DataFrame, prefix: str) -> DataFrame:
    """K5: silhouette with squared distances, from the size, mean and mean square of every cluster.

    The mean squared distance to a cluster is |x|^2 - 2 x.mean + mean square, so the cost is linear.
    """
    joined = cut_lineage(rows.join(clusters, "node_id"))
    square = total([F.col(c) * F.col(c) for c in columns])
    stats = joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(square).alias("s"), *[F.avg(c).alias(c) for c in columns]
    ).orderBy("cluster").collect()  # one row per cluster
    x2 = total([F.col(c) * F.col(c) for c in columns])

    def away(row) -> Column:
        dot = total([F.col(c) * F.lit(float(row[c])) for c in columns])
        return x2 - 2 * dot + F.lit(float(row["s"]))

    own, other = F.lit(0.0), F.lit(float("inf"))
    single = F.lit(False)
    for row in stats:
        mine = F.col("cluster") == F.lit(row["cluster"])
        n = row["n"]
        own = F.when(mine, away(row) * F.lit(n / max(n - 1.0, 1.0))).otherwise(own)
        other = F.least(other, F.when(mine, F.lit(float("inf"))).otherwise(away(row)))
        single = F.when(mine, F.lit(n == 1)).otherwise(single)
    scored = joined.select("node_id", own.alias("a"), other.alias("b"), single.alias("one"))
    value = F.when(F.col("one"), 0.0).otherwise(safe_div(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return scored.select("node_id", value.alias(f"{prefix}_silhouette"))


def _neighbour_counts(graph: FraudGraph, clusters: DataFrame) -> DataFrame:
    """(node, own cluster, neighbour cluster, n): at most one row per node and cluster."""
    pairs = graph.neighbours().join(clusters.toDF("nbr", "other"), "nbr")
    counts = pairs.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(clusters.toDF("node", "own"), "node")


def neighbour_cluster(graph: FraudGraph, clusters: DataFrame, prefix: str) -> DataFrame:
    """K6: share of neighbours in the own cluster, normalised entropy, share of the largest cluster."""
    k = clusters.agg(F.countDistinct("cluster")).scalar()
    rows = _neighbour_counts(graph, clusters)
    sums = rows.groupBy("node").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("own") == F.col("other"), F.col("n")).otherwise(0)).alias("same"),
        F.max("n").alias("top"), F.sum(F.col("n") * F.log("n")).alias("nlogn"),
    )
    # -sum p log p with p = n/all is log(all) - sum(n log n)/all.
    entropy = F.log("all") - F.col("nlogn") / F.col("all")
    stats = sums.select(
        F.col("node").alias("node_id"), (F.col("same") / F.col("all")).alias(f"{prefix}_neighbor_consistency"),
        F.coalesce(F.try_divide(entropy, F.log(k)), F.lit(0.0)).alias(f"{prefix}_neighbor_cluster_entropy"),
        (F.col("top") / F.col("all")).alias(f"{prefix}_neighbor_dominant_ratio"),
    )
    return graph.attach(stats).fillna(0.0)


def inter_cluster(graph: FraudGraph, clusters: DataFrame) -> DataFrame:
    """K7: edges inside and out of the own cluster, shares, density, and clusters touched."""
    k = clusters.agg(F.countDistinct("cluster")).scalar()
    sizes = clusters.groupBy(F.col("cluster").alias("own")).agg(F.count(F.lit(1)).alias("size"))
    same = F.col("own") == F.col("other")
    sums = _neighbour_counts(graph, clusters).groupBy("node", "own").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("intra"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("touched")
    ).join(sizes, "own")
    intra, inter = F.col("intra"), F.col("all") - F.col("intra")
    stats = sums.select(
        F.col("node").alias("node_id"), intra.alias("inter_cluster_intra_edges"), inter.alias("inter_cluster_inter_edges"),
        (intra / F.col("all")).alias("inter_cluster_intra_ratio"), (inter / F.col("all")).alias("inter_cluster_inter_ratio"),
        F.when(F.col("size") > 1, safe_div(intra, F.col("size") - 1)).otherwise(0.0).alias("inter_cluster_cluster_degree"),
        F.col("touched").alias("inter_cluster_cluster_bridging"), (F.col("touched") / k).alias("inter_cluster_cluster_bridging_norm"),
    )
    return graph.attach(stats).fillna(0)


BAND_PERCENTILES = (0.25, 0.5, 0.75, 0.9)


def degree_cluster(graph: FraudGraph, first: int | None = None) -> DataFrame:
    """K8: five degree bands and the distance of all features (or the first) to every band's mean."""
    d = graph.attach(undirected_degree(graph.neighbours(), "d").withColumnRenamed("node", "node_id")).fillna(0)
    rows = cut_lineage(d.join(graph.features(graph.feature_names[:first]), "node_id"))
    counted = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    cuts = counted.agg(F.percentile("d", F.array(*[F.lit(p) for p in BAND_PERCENTILES]), F.col("n"))).scalar()
    band = total([(F.col("d") > cuts[i]).cast("int") for i in range(len(BAND_PERCENTILES))])
    banded = cut_lineage(rows.withColumn("band", band))
    names = graph.feature_names[:first]
    means = {r["band"]: r for r in banded.groupBy("band").agg(*[F.avg(c).alias(c) for c in names]).collect()}  # five rows
    return banded.select("node_id", F.col("band").alias("degree_cluster_degree_cluster"), *[
        F.abs(F.col(c) - F.lit(float(means[b][c]))).alias(f"degree_cluster_degree_cluster_{b}_feat{i}_dist")
        for b in sorted(means) for i, c in enumerate(names)
    ])


def kmeans_family(graph: FraudGraph, scaled: FraudGraph, ks: tuple[int, ...] = (5, 10, 20), seed: int = 42) -> DataFrame:
    """K1-K5 for every k, on scaled features."""
    columns, parts = scaled.feature_names, []
    rows = scaled.features()
    for k in ks:
        prefix = f"kmeans_{k}"
        placed = cut_lineage(nearest_centres(rows, columns, kmeans_centres(rows, columns, k, seed), prefix))
        clusters = placed.select("node_id", F.col(f"{prefix}_cluster").alias("cluster"))
        parts += [
            placed, cluster_size(clusters, prefix), cluster_density(rows, columns, clusters, prefix),
            silhouette(rows, columns, clusters, prefix),
        ]
    return graph.attach(*parts)
