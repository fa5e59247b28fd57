"""Bounded neighbour sampling, hop joins, and the statistics over the sampled neighbours.

Every builder yields pairs ``(node, nbr, ts, edge_type)`` with at most k rows per node, and
``neighbour_stats`` turns them into features with one join and one aggregation. Each side of a
hop join holds at most k rows per key, so a hot key multiplies its rows by k and no more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.ordered import column_quantiles
from ringsight.functions.sampling import first_k, sample_k_per_key
from ringsight.functions.scalars import SEED, seeded_hash
from ringsight.graph import EDGE_COLUMNS, FraudGraph
from ringsight.session import cut_lineage

K = 15
PAIR = ["node", "nbr"]


@dataclass(frozen=True)
class Samples:
    """The edge samples that several builders share."""

    edges: DataFrame
    k: int = K
    seed: int = SEED

    @cached_property
    def out(self) -> DataFrame:
        return sample_k_per_key(self.edges, ["src"], ["edge_id"], EDGE_COLUMNS, self.k, self.seed)

    @cached_property
    def into(self) -> DataFrame:
        return sample_k_per_key(self.edges, ["dst"], ["edge_id"], EDGE_COLUMNS, self.k, self.seed)

    @cached_property
    def around(self) -> DataFrame:
        return undirected_sample(self.edges, self.k, self.seed)

    # Written once, for builders that read a sample twice.
    @cached_property
    def out_kept(self) -> DataFrame:
        return cut_lineage(self.out)

    @cached_property
    def into_kept(self) -> DataFrame:
        return cut_lineage(self.into)

    @cached_property
    def around_kept(self) -> DataFrame:
        return cut_lineage(self.around)

    def written(self) -> "Samples":
        """The same samples read back from the checkpoint folder, for many builders at once."""
        kept = Samples(self.edges, self.k, self.seed)
        for name in ("out", "into", "around"):
            rows = getattr(self, f"{name}_kept")
            kept.__dict__.update({name: rows, f"{name}_kept": rows})
        return kept


def undirected_sample(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """Both directions, the first edge of each (node, nbr), then k per node."""
    def turned(node: str, nbr: str, way: int) -> Column:
        return F.struct(
            F.col(node).alias("node"), F.col(nbr).alias("nbr"),
            F.struct(F.lit(way).alias("way"), "edge_id", "edge_type", "ts").alias("first"),
        )

    both = edges.select(F.inline(F.array(turned("src", "dst", 0), turned("dst", "src", 1))))
    pairs = both.groupBy(*PAIR).agg(F.min("first").alias("first"))
    rows = pairs.select(*PAIR, "first.edge_id", "first.edge_type", F.col("first.ts").cast("double").alias("ts"))
    return sample_k_per_key(rows, ["node"], ["edge_id"], ["edge_id", "nbr"], k, seed)


def _as_pairs(edges: DataFrame, node: str, nbr: str) -> DataFrame:
    return edges.select(
        F.col(node).alias("node"), F.col(nbr).alias("nbr"), "edge_id", "edge_type", F.col("ts").cast("double").alias("ts")
    )


def directed_1hop_out(s: Samples, graph: FraudGraph) -> DataFrame:
    """H1: k out-edges per source."""
    return _as_pairs(s.out, "src", "dst")


def directed_1hop_in(s: Samples, graph: FraudGraph) -> DataFrame:
    """H2: k in-edges per target."""
    return _as_pairs(s.into, "dst", "src")


def undirected_1hop(s: Samples, graph: FraudGraph) -> DataFrame:
    """H3: k distinct neighbours per node, either direction."""
    return s.around


def _path(*parts: str) -> Column:
    return F.struct(*[F.col(p) for p in parts])


def _lists(second: DataFrame, way: Column) -> DataFrame:
    """``(mid, ways)``: the sampled steps out of a node, at most k of them, in one row."""
    return second.groupBy(F.col("node").alias("mid")).agg(F.collect_list(way).alias("ways"))


def _by_node(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first(node, mid, ..)`` next to its ``ways``, dealt by node before the steps are written out.

    One row per sampled edge is shuffled, at most k per node; the paths are made, cut to the first of
    each pair and sampled where the rows of their node lie.
    """
    return first.join(second, "mid").repartition("node").withColumn("way", F.explode("ways")).drop("ways")


def join_hops(first: DataFrame, second: DataFrame, samples: Samples) -> DataFrame:
    """Pairs two steps apart: first path per pair, no self pairs, day = mean, type of hop one."""
    paths = _two_steps(first, second)
    rows = paths.where(F.col("node") != F.col("nbr")).select(
        *PAIR, F.col("path.edge_type").alias("edge_type"), ((F.col("path.ts1") + F.col("path.ts2")) / 2).alias("ts")
    )
    return first_k(rows, ["node"], [seeded_hash(*PAIR, seed=samples.seed)], samples.k)


def _two_steps(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("node", F.col("nbr").alias("mid"), F.col("edge_id").alias("e1"), "edge_type", F.col("ts").alias("ts1"))
    b = _lists(second, F.struct("nbr", F.col("edge_id").alias("e2"), F.col("ts").alias("ts2")))
    return _by_node(a, b).groupBy("node", F.col("way.nbr").alias("nbr")).agg(
        F.min(_path("e1", "edge_type", "ts1", "way.e2", "way.ts2")).alias("path")
    )


def directed_2hop_out(s: Samples, graph: FraudGraph) -> DataFrame:
    """H4: sampled out-edges joined with sampled out-edges."""
    out = _as_pairs(s.out_kept, "src", "dst")
    return join_hops(out, out, s)


def directed_2hop_in(s: Samples, graph: FraudGraph) -> DataFrame:
    """H5: the mirror of H4 on in-edges."""
    into = _as_pairs(s.into_kept, "dst", "src")
    return join_hops(into, into, s)


def undirected_2hop(s: Samples, graph: FraudGraph) -> DataFrame:
    """H6: undirected sample joined with itself."""
    return join_hops(s.around_kept, s.around_kept, s)


def mixed_propagation(s: Samples, graph: FraudGraph) -> DataFrame:
    """H7: other sources of the same target."""
    return join_hops(_as_pairs(s.out, "src", "dst"), _as_pairs(s.into, "dst", "src"), s)


def recent_activity(s: Samples, graph: FraudGraph, quantile: float = 0.7) -> DataFrame:
    """H8: neighbours met on the latest days."""
    # Days are few: the exact percentile keeps one counter per distinct day.
    bound = graph.edges.agg(F.percentile("ts", F.lit(quantile))).scalar()
    return undirected_sample(graph.edges.where(F.col("ts") >= bound), s.k, s.seed)


def _between(edges: DataFrame, members: DataFrame) -> DataFrame:
    return edges.join(members.withColumnRenamed("node", "src"), "src", "left_semi").join(
        members.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )


def risk_cluster(s: Samples, graph: FraudGraph, quantile: float = 0.8) -> DataFrame:
    """H9: edges between nodes whose risk feature lies above its quantile."""
    names = graph.feature_names
    risk = "f16" if "f16" in names else "f9"
    bound = column_quantiles(graph.nodes.select(risk), [risk], [quantile])[risk][0]
    members = graph.nodes.where(F.col(risk) > bound).select(F.col("node_id").alias("node"))
    return undirected_sample(_between(graph.edges, members), s.k, s.seed)


def degree_quantile(degrees: DataFrame, quantile: float) -> Column:
    """Exact quantile of a degree column ``d``.

    A graph with E edges has at most about sqrt(4E) different degrees, so the counted form is small.
    """
    counted = degrees.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.percentile("d", F.lit(quantile), F.col("n"))).scalar()


def core_business(s: Samples, graph: FraudGraph, quantile: float = 0.8) -> DataFrame:
    """Edges between nodes of high out-degree."""
    degree = graph.edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    members = degree.where(F.col("d") > degree_quantile(degree, quantile)).select("node")
    return undirected_sample(_between(graph.edges, members), s.k, s.seed)


def financial_hub(s: Samples, graph: FraudGraph, quantile: float = 0.85) -> DataFrame:
    """Edges with at least one end of high total degree."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    hubs = degree.where(F.col("d") > degree_quantile(degree, quantile)).select("node", F.lit(True).alias("hub"))
    flagged = graph.edges.join(hubs.withColumnsRenamed({"node": "src", "hub": "a"}), "src", "left").join(
        hubs.withColumnsRenamed({"node": "dst", "hub": "b"}), "dst", "left"
    )
    touching = flagged.where(F.col("a").isNotNull() | F.col("b").isNotNull()).select(*EDGE_COLUMNS)
    return undirected_sample(touching, s.k, s.seed)


def transaction_chain(s: Samples, graph: FraudGraph) -> DataFrame:
    """Ends of three-edge chains; day = mean of the three.

    Paths are ordered by their edges from the front, so keeping the first path per (source, middle)
    before the third hop leaves the first path per (source, end) unchanged.
    """
    out = _as_pairs(s.out_kept, "src", "dst")
    two = _two_steps(out, out).select("node", F.col("nbr").alias("mid"), "path")
    third = _lists(out, F.struct("nbr", F.col("edge_id").alias("e3"), F.col("ts").alias("ts3")))
    chains = _by_node(two, third).where(F.col("node") != F.col("way.nbr")).groupBy("node", F.col("way.nbr").alias("nbr")).agg(
        F.min(_path("path", "way.e3", "way.ts3")).alias("chain")
    )
    day = (F.col("chain.path.ts1") + F.col("chain.path.ts2") + F.col("chain.ts3")) / 3
    rows = chains.select(*PAIR, F.col("chain.path.edge_type").alias("edge_type"), day.alias("ts"))
    return first_k(rows, ["node"], [seeded_hash(*PAIR, seed=s.seed)], s.k)


BUILDERS: dict[str, Callable[[Samples, FraudGraph], DataFrame]] = {
    "directed_1hop_out": directed_1hop_out,
    "directed_1hop_in": directed_1hop_in,
    "undirected_1hop": undirected_1hop,
    "directed_2hop_out": directed_2hop_out,
    "directed_2hop_in": directed_2hop_in,
    "undirected_2hop": undirected_2hop,
    "mixed_propagation": mixed_propagation,
    "recent_activity": recent_activity,
    "risk_cluster": risk_cluster,
    "core_business": core_business,
    "financial_hub": financial_hub,
    "transaction_chain": transaction_chain,
}


def top_types(pairs: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent edge types of a pair set."""
    counts = pairs.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "edge_type").limit(n)


def interval_columns(times: Column, prefix: str) -> list[Column]:
    """Gaps between consecutive days of one node; ``times`` holds at most k sorted values."""
    n = F.size(times)
    gaps = F.zip_with(
        F.slice(times, 2, F.greatest(n - 1, F.lit(0))), F.slice(times, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a
    )
    size = F.greatest(n - 1, F.lit(1)).cast("double")
    mean = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g) / size
    spread = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + (g - mean) * (g - mean)) / size
    values = {"mean": mean, "std": F.sqrt(spread), "max": F.array_max(gaps), "min": F.array_min(gaps)}
    return [
        F.when(n < 2, 0.0).otherwise(value).alias(f"{prefix}_interval_{name}") for name, value in values.items()
    ]


def neighbour_stats(pairs: DataFrame, graph: FraudGraph, prefix: str, types: list[int] | None = None) -> DataFrame:
    """Feature, day, interval and edge-type statistics over the sampled neighbours of a node.

    ``types`` names the edge types that get their own columns; by default the three most frequent,
    asked once on the driver because column names depend on them.
    """
    if types is None:
        types = [row["edge_type"] for row in top_types(pairs).collect()]
    names = graph.feature_names
    # At most k rows per node, dealt by node: the many statistics are never shuffled half done.
    rows = pairs.join(graph.features().withColumnRenamed("node_id", "nbr"), "nbr", "left").repartition("node")
    stats = [("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)]
    ts = F.col("ts")
    aggs = [how(name).alias(f"{prefix}_{name}_{s}") for name in names for s, how in stats]
    aggs += [how(ts).alias(f"{prefix}_timestamp_{s}") for s, how in stats]
    aggs.append((F.max(ts) - F.min(ts)).alias(f"{prefix}_timestamp_range"))
    for t in types:
        day = F.when(F.col("edge_type") == t, ts)
        aggs += [how(day).alias(f"{prefix}_type_{t}_{s}") for s, how in stats]
        aggs += [F.count(day).alias(f"{prefix}_type_{t}_count"), (F.max(day) - F.min(day)).alias(f"{prefix}_type_{t}_range")]
    # At most k days per node are listed.
    table = rows.groupBy("node").agg(*aggs, F.array_sort(F.collect_list(ts)).alias("_times"))
    kept = [c for c in table.columns if c not in ("node", "_times")]
    return table.select(F.col("node").alias("node_id"), *kept, *interval_columns(F.col("_times"), prefix))


def hop_features(
    graph: FraudGraph, name: str, k: int = K, types: list[int] | None = None, samples: Samples | None = None
) -> DataFrame:
    """One hop family on all nodes; nodes without such neighbours get 0."""
    pairs = BUILDERS[name](samples or Samples(graph.edges, k), graph)
    return graph.attach(neighbour_stats(pairs, graph, name, types)).fillna(0.0)


def all_hop_features(graph: FraudGraph, k: int = K, types: list[int] | None = None, names=tuple(BUILDERS)) -> DataFrame:
    """Every hop family next to each other, over shared samples."""
    graph = FraudGraph(cut_lineage(graph.nodes), cut_lineage(graph.edges), graph.label_splits)
    samples = Samples(graph.edges, k).written()
    # Each family is written before the next is made: one lost executor never reruns all of them, and the shuffles of
    # one family only are on the disks.
    families = [cut_lineage(neighbour_stats(BUILDERS[name](samples, graph), graph, name, types)) for name in names]
    return graph.attach(*families).fillna(0.0)
