"""Subgraphs, splits, sampling, relations and column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.ordered import with_position
from ringsight.functions.sampling import sample_fraction
from ringsight.functions.scalars import SEED, seeded_hash
from ringsight.graph import FraudGraph

EDGE_ENDS = ["src", "dst"]


def induced_subgraph(graph: FraudGraph, keep: DataFrame) -> FraudGraph:
    """Nodes of ``keep(node_id, new_id)`` and the edges between them, renumbered."""
    nodes = graph.nodes.join(keep, "node_id").drop("node_id").withColumnRenamed("new_id", "node_id")
    edges = graph.edges
    for end in EDGE_ENDS:
        renamed = keep.select(F.col("node_id").alias(end), F.col("new_id").alias("_new"))
        edges = edges.join(renamed, end).drop(end).withColumnRenamed("_new", end)
    return FraudGraph(nodes.select(*graph.nodes.columns), edges.select(*graph.edges.columns), graph.label_splits)


def renumbered(nodes: DataFrame, order: list[str] = ("node_id",)) -> DataFrame:
    """``(node_id, new_id)``: positions of the kept nodes in the given order."""
    columns = list(dict.fromkeys(["node_id", *order]))
    return with_position(nodes.select(*columns), [], list(order), "new_id").select("node_id", "new_id")


def filter_labels(graph: FraudGraph, labels: tuple[int, ...] = (0, 1), first_labelled_id: int = 0) -> FraudGraph:
    """Nodes with the given labels (from an id on), re-indexed, with the edges between them."""
    kept = graph.nodes.where(F.col("label").isin(*labels) & (F.col("node_id") >= first_labelled_id))
    return induced_subgraph(graph, renumbered(kept))


def _cuts(position: Column, size: Column, ratios: list[tuple[str, float]]) -> Column:
    """Name of the part a position falls into; the last part takes the rest."""
    done, chain = 0.0, None
    for name, ratio in ratios[:-1]:
        done += ratio
        inside = position < F.floor(size * F.lit(round(done, 10)))
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain.otherwise(ratios[-1][0])


THIRDS = [("train", 0.6), ("valid", 0.2), ("test", 0.2)]


def split_random(nodes: DataFrame, ratios=THIRDS, seed: int = 12345) -> DataFrame:
    """A seeded permutation of all nodes, cut by ratio."""
    rows = nodes.select("node_id", seeded_hash("node_id", seed=seed).alias("_h"))
    placed = with_position(rows, [], ["_h", "node_id"])
    n = nodes.agg(F.count(F.lit(1))).scalar()
    return placed.select("node_id", _cuts(F.col("pos"), n, ratios).alias("split"))


def _placed_in_label(nodes: DataFrame, seed: int) -> DataFrame:
    rows = nodes.select("node_id", "label", seeded_hash("node_id", seed=seed).alias("_h"))
    return with_position(rows, ["label"], ["_h", "node_id"])


def split_stratified(nodes: DataFrame, ratios=THIRDS, seed: int = SEED) -> DataFrame:
    """The same cut inside every label."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = _placed_in_label(nodes, seed).join(sizes, "label")
    return placed.select("node_id", "label", _cuts(F.col("pos"), F.col("n"), ratios).alias("split"))


def split_kfold(nodes: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """P5: stratified shuffled folds."""
    return _placed_in_label(nodes, seed).select("node_id", "label", (F.col("pos") % k).cast("int").alias("fold"))


# Seconds of a month and the parts by month.
MONTH_SECONDS = 2_628_000
MONTH_PARTS = [("train", 9), ("Oct", 10), ("Nov", 11), ("Dec", 12)]


def split_temporal(cards: DataFrame, start: str) -> DataFrame:
    """Nine months of training, then one part per month; rows outside get no part."""
    age = F.unix_seconds("time_stamp") - F.unix_seconds(F.lit(start).cast("timestamp"))
    chain = F.when(age <= 0, None)
    for name, months in MONTH_PARTS:
        chain = chain.when(age <= months * MONTH_SECONDS, name)
    return cards.withColumn("part", chain)


def sample_edges(edges: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """A seeded fraction of the edges."""
    return sample_fraction(edges, ["edge_id"], fraction, seed)


def truncate_split(nodes: DataFrame, size: int, mode: str = "random", seed: int = SEED) -> DataFrame:
    """At most ``size`` nodes per split: the first ids, random ones, or with the class ratio kept."""
    counts = nodes.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_pos")
    )
    rows = nodes.select("node_id", "label", "split", seeded_hash("node_id", seed=seed).alias("_h"))
    if mode == "balanced":
        placed = with_position(rows, ["split", "label"], ["_h", "node_id"]).join(counts, "split")
        n_pos = F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("n_pos") / F.col("n")))
        quota = F.when(F.col("label") == 1, n_pos).when(F.col("label") == 0, size - n_pos).otherwise(0)
    else:
        order = ["node_id"] if mode == "first" else ["_h", "node_id"]
        placed = with_position(rows, ["split"], order).join(counts, "split")
        quota = F.lit(size)
    kept = (F.col("n") <= size) | (F.col("pos") < quota)
    return placed.where(kept).select("node_id", "label", "split")


def undersample(nodes: DataFrame, scale: float = 1.0, seed: int = SEED) -> DataFrame:
    """All positives and ``scale`` random negatives per positive."""
    positives = nodes.where(F.col("label") == 1).agg(F.count(F.lit(1))).scalar()
    negative = nodes.where(F.col("label") != 1).select("node_id", "label", seeded_hash("node_id", seed=seed).alias("_h"))
    placed = with_position(negative, [], ["_h", "node_id"])
    drawn = placed.where(F.col("pos") < F.floor(positives * F.lit(scale))).select("node_id", "label")
    return nodes.where(F.col("label") == 1).select("node_id", "label").unionByName(drawn)


# --- relations -------------------------------------------------------------------------------------

def relation_bitmap(relations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """P10: one edge per (src, dst) whose type has one bit per relation that contains it."""
    bit = F.lit(0)
    for i, name in enumerate(names):
        bit = F.when(F.col("relation") == name, F.lit(1 << i)).otherwise(bit)
    return relations.groupBy(*EDGE_ENDS).agg(F.bit_or(bit).alias("edge_type"))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    """Drop (v, v)."""
    return edges.where(F.col("src") != F.col("dst"))


def add_self_loops(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One (v, v) per node next to the other pairs."""
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return remove_self_loops(pairs).select(*EDGE_ENDS).unionByName(loops)


def to_bidirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, distinct."""
    pairs = edges.select(*EDGE_ENDS)
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def merge_relations(relations: dict[str, DataFrame]) -> DataFrame:
    """Several edge tables as one, with the relation as a column."""
    parts = [edges.withColumn("relation", F.lit(name)) for name, edges in relations.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_relations(edges: DataFrame, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """P13, back: one edge table per relation."""
    return {name: edges.where(F.col("relation") == name).drop("relation") for name in names}


def block_subgraphs(graph: FraudGraph, size: int) -> tuple[DataFrame, DataFrame]:
    """Edges inside the full id blocks (``block``, local ends) and the edges that leave them."""
    n = graph.nodes.agg(F.count(F.lit(1))).scalar()
    full = F.floor(n / size)
    a, b = F.floor(F.col("src") / size), F.floor(F.col("dst") / size)
    flagged = graph.edges.withColumns({"block": a, "_inside": (a == b) & (a < full)})
    inside = flagged.where("_inside").drop("_inside").withColumns({c: F.col(c) % size for c in EDGE_ENDS})
    return inside, flagged.where("not _inside").select(*graph.edges.columns)


def select_features(table: DataFrame, keep: list[str], key: str = "node_id") -> tuple[DataFrame, list[str]]:
    """The listed columns that exist, in list order, and the names that are missing."""
    have = set(table.columns)
    missing = [c for c in keep if c not in have]
    return table.select(key, *[c for c in keep if c in have and c != key]), missing


def drop_by_pattern(table: DataFrame, patterns: list[str], key: str = "node_id") -> DataFrame:
    """P18, other way: leave out the columns whose name contains one of the patterns."""
    return table.select(*[c for c in table.columns if c == key or not any(p in c for p in patterns)])


# --- descriptions -----------------------------------------------------------------------------------

def label_distribution(nodes: DataFrame, column: str = "label") -> DataFrame:
    """Rows per value."""
    return nodes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def graph_describe(graph: FraudGraph, relations: DataFrame | None = None) -> DataFrame:
    """Long table ``(scope, name, value)`` of sizes, fraud share, relations and splits."""
    nodes = graph.nodes.agg(
        F.count(F.lit(1)).cast("double").alias("nodes"), F.count_if(F.col("label") == 1).cast("double").alias("fraud"),
        F.count_if(F.col("label") == 0).cast("double").alias("normal"), F.lit(float(len(graph.feature_names))).alias("features"),
    ).withColumn("fraud_ratio", F.try_divide(F.col("fraud"), F.col("fraud") + F.col("normal")))
    whole = nodes.unpivot([], nodes.columns, "name", "value").select(F.lit("graph").alias("scope"), "name", "value")
    n = graph.nodes.agg(F.count(F.lit(1)).cast("double")).scalar()
    splits = graph.nodes.groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        F.col("split").alias("scope"), F.inline(F.array(
            F.struct(F.lit("nodes").alias("name"), F.col("n").alias("value")),
            F.struct(F.lit("share").alias("name"), (F.col("n") / n).alias("value")),
        ))
    )
    edges = graph.edges.withColumn("relation", F.lit("edges")) if relations is None else relations
    parts = edges.groupBy("relation").agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        F.col("relation").alias("scope"), F.inline(F.array(
            F.struct(F.lit("edges").alias("name"), F.col("n").alias("value")),
            F.struct(F.lit("mean_out_degree").alias("name"), (F.col("n") / n).alias("value")),
        ))
    )
    return whole.unionByName(splits).unionByName(parts)
