"""Embeddings of the adjacency, of features and degrees, and random-walk statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ringsight.functions.linear import gaussian, pca, project, unit_rows
from ringsight.functions.ordered import running_sums, with_position
from ringsight.functions.scalars import SEED, one_row, seeded_hash
from ringsight.graph import FraudGraph
from ringsight.operators.neighbours import sampled_neighbours
from ringsight.operators.spectral import (
    drop_links, held_links, laplacian_eigenvectors, leading_subspace, ritz, symmetric_links, with_propagated,
)
from ringsight.operators.structure import undirected_degree
from ringsight.session import cut_lineage


PIECE = 256  # neighbours of a node that lie in one row


def adjacency_svd(graph: FraudGraph, k: int = 32, iterations: int = 5, seed: int = SEED) -> DataFrame:
    """A times its leading right singular vectors, by randomized subspace iteration.

    The undirected adjacency is symmetric, so singular vectors are eigenvectors of A squared.
    """
    import numpy as np

    links = held_links(graph.neighbours().withColumn("weight", F.lit(1.0)))
    width = k + 10  # usual oversampling of the randomized method
    block = leading_subspace(links, graph.ids(), width, iterations, 0.0, seed)
    values, mix = ritz(links, block, width)
    lead = np.argsort(-np.abs(values))[:k]
    columns = [f"q{j}" for j in range(width)]
    moved = with_propagated(links, block, {f"m{j}": c for j, c in enumerate(columns)})
    out = cut_lineage(project(moved, [f"m{j}" for j in range(width)], mix[:, lead], "svd_dim"))
    drop_links(links)
    names = [f"svd_dim{j}" for j in range(k)]
    top = out.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in names]).first()
    return out.select("node_id", *[
        (F.col(c) * F.lit(-1.0 if (top[c] or 0.0) < 0 else 1.0)).alias(c) for c in names
    ])


def laplacian_embedding(graph: FraudGraph, k: int = 16) -> DataFrame:
    """L6 under the embedding's names."""
    return laplacian_eigenvectors(graph, k, prefix="laplacian_dim")


def feature_embedding(graph: FraudGraph, dim: int = 32, seed: int = SEED) -> DataFrame:
    """Principal components, or the features and random mixtures of them; rows of length one."""
    names = graph.feature_names
    if len(names) >= dim:
        return unit_rows(pca(graph.features(), names, dim, "feature_embedding_dim"))
    mixed = project(graph.features(), names, gaussian(len(names), dim - len(names), seed), "_r")
    rows = graph.features().join(mixed, "node_id").toDF("node_id", *[f"feature_embedding_dim{i}" for i in range(dim)])
    return unit_rows(rows)


def degree_shapes(graph: FraudGraph) -> DataFrame:
    """Six transforms of the undirected degree: shares of the maximum, of N, rank and distribution."""
    d = cut_lineage(graph.attach(
        undirected_degree(graph.neighbours(), "d").withColumnRenamed("node", "node_id")
    ).fillna(0))
    m = one_row(d.agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")))
    counted = d.groupBy("d").agg(F.count(F.lit(1)).alias("c"))
    below = running_sums(counted, [], ["d"], {"upto": F.col("c")}).select("d", (F.col("upto") - F.col("c")).alias("below"))
    rows = with_position(d, [], ["d", "node_id"], "rank").join(below, "d")
    x = F.col("d")
    return rows.select(
        "node_id", F.coalesce(F.try_divide(x, m["d"]), F.lit(0.0)).alias("g0"), (F.log1p(x) / (F.log1p(m["d"]) + 1)).alias("g1"),
        (F.sqrt(x) / (F.sqrt(m["d"]) + 1)).alias("g2"), (x / m["n"]).alias("g3"),
        (F.col("rank") / m["n"]).alias("g4"), (F.col("below") / m["n"]).alias("g5"),
    )


def degree_embedding(graph: FraudGraph, dim: int = 16, seed: int = SEED) -> DataFrame:
    """The degree transforms, mixed at random up to ``dim``; rows of length one."""
    shapes = [f"g{i}" for i in range(6)]
    return unit_rows(project(degree_shapes(graph), shapes, gaussian(6, dim, seed), "degree_embedding_dim"))


def neighbour_embedding(graph: FraudGraph, dim: int = 20, k: int | None = None, seed: int = SEED) -> DataFrame:
    """Own features, neighbour mean and their difference, projected; rows of length one."""
    names = graph.feature_names
    values = graph.features().withColumnRenamed("node_id", "nbr")
    means = sampled_neighbours(graph.neighbours(), k).join(values, "nbr").groupBy(F.col("node").alias("node_id")).agg(
        *[F.avg(c).alias(f"m_{c}") for c in names]
    )
    rows = graph.features().join(means, "node_id", "left")
    near = {f"m_{c}": F.coalesce(f"m_{c}", c) for c in names}
    rows = rows.withColumns(near).withColumns({f"x_{c}": F.col(c) - F.col(f"m_{c}") for c in names})
    columns = [*names, *[f"m_{c}" for c in names], *[f"x_{c}" for c in names]]
    if len(columns) > dim:
        out = project(rows, columns, gaussian(len(columns), dim, seed), "neighbor_embedding_dim")
    else:
        out = rows.select("node_id", *[F.col(c).alias(f"neighbor_embedding_dim{i}") for i, c in enumerate(columns)],
                          *[F.lit(0.0).alias(f"neighbor_embedding_dim{i}") for i in range(len(columns), dim)])
    return unit_rows(out)


def gcn_block(graph: FraudGraph) -> DataFrame:
    """Own features, propagated features, their product and absolute difference."""
    names = graph.feature_names
    links = symmetric_links(graph.neighbours(), 0.0)
    rows = with_propagated(links, graph.features(), {f"p_{c}": c for c in names})
    return rows.withColumns({
        **{f"x_{c}": F.col(c) * F.col(f"p_{c}") for c in names},
        **{f"d_{c}": F.abs(F.col(c) - F.col(f"p_{c}")) for c in names},
    })


def gcn_embedding(graph: FraudGraph, dim: int = 24) -> DataFrame:
    """E5: principal components of the propagated block."""
    block = cut_lineage(gcn_block(graph))
    columns = [c for c in block.columns if c != "node_id"]
    return pca(block, columns, dim, "gnn_embedding_dim")


def random_walk_stats(graph: FraudGraph, walks: int = 20, length: int = 10, seed: int = SEED) -> DataFrame:
    """Return probability, mean steps to return, and distinct nodes visited over the length.

    All walkers move one step per join. The next node is the neighbour whose number (in id order)
    the hash of (node, walk, step) selects. Neighbours lie in pieces of at most ``PIECE``, each with its degree, so
    a step joins few rows and there is never one list per hub.
    """
    und = cut_lineage(graph.neighbours())
    degree = cut_lineage(undirected_degree(und, "d"))
    numbered = with_position(und, ["node"], ["nbr"], "number").join(degree.withColumnRenamed("node", "nbr"), "nbr", "left")
    pieces = cut_lineage(numbered.groupBy(F.col("node").alias("at"), F.floor(F.col("number") / PIECE).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("number", "nbr", "d"))).alias("next")
    ))
    walkers = graph.ids().join(degree, F.col("node_id") == F.col("node")).select(
        F.col("node_id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("node_id").alias("at"), "d"
    )
    seen = []
    for step in range(1, length + 1):
        head = F.substring(seeded_hash("start", "walk", F.lit(step), seed=seed), 1, 8)
        chosen = F.pmod(F.conv(head, 16, 10).cast("bigint"), F.col("d"))
        placed = walkers.withColumn("number", chosen).withColumn("piece", F.floor(F.col("number") / PIECE))
        taken = F.col("next")[(F.col("number") % PIECE).cast("int")]
        moved = cut_lineage(placed.join(pieces, ["at", "piece"]).select("start", "walk", taken.alias("to")).select(
            "start", "walk", F.col("to.nbr").alias("at"), F.col("to.d").alias("d"), F.lit(step).alias("step")
        ))
        seen.append(moved.drop("d"))
        walkers = moved.where(F.col("at") != F.col("start")).drop("step")
    visits = seen[0]
    for part in seen[1:]:
        visits = visits.unionByName(part)
    # One row per (start, visited node) before the counts, so no list of nodes is built.
    pairs = visits.groupBy("start", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"))
    home = F.col("at") == F.col("start")
    stats = pairs.groupBy(F.col("start").alias("node_id")).agg(
        (F.sum(F.when(home, F.col("n")).otherwise(0)) / walks).alias("rw_return_prob"),
        F.try_divide(F.sum(F.when(home, F.col("steps"))).cast("double"), F.sum(F.when(home, F.col("n")))).alias("rw_avg_return_steps"),
        (F.count(F.lit(1)) / length).alias("rw_visited_nodes"),
    )
    return graph.attach(stats).fillna(0.0)
