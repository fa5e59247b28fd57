"""The graph bundle every operator takes: a node table and an edge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# One total order over edges. edge_id alone may repeat, so ties fall back on the whole row;
# rows equal in all five columns are interchangeable.
EDGE_COLUMNS = ["edge_id", "src", "dst", "edge_type", "ts"]
FEATURE_PREFIX = "f"


@dataclass(frozen=True)
class FraudGraph:
    """``nodes(node_id, f0.., label, split)`` and ``edges(edge_id, src, dst, edge_type, ts)``."""

    nodes: DataFrame
    edges: DataFrame
    # Splits whose labels a feature may look at; None for all (evaluation of leaked variants).
    label_splits: tuple[str, ...] | None = ("train",)

    @property
    def feature_names(self) -> list[str]:
        named = [c for c in self.nodes.columns if c[:1] == FEATURE_PREFIX and c[1:].isdigit()]
        return sorted(named, key=lambda c: int(c[1:]))

    def features(self, names: list[str] | None = None) -> DataFrame:
        return self.nodes.select("node_id", *(names or self.feature_names))

    def ids(self) -> DataFrame:
        return self.nodes.select("node_id")

    def labelled(self, condition: Column) -> DataFrame:
        """Nodes that satisfy a condition on ``label``, as far as their label may be used."""
        if self.label_splits is not None:
            condition = condition & F.col("split").isin(*self.label_splits)
        return self.nodes.where(condition)

    def neighbours(self) -> DataFrame:
        """Distinct undirected pairs ``(node, nbr)``; a self loop gives one pair."""
        e = self.edges.select("src", "dst")
        both = e.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).unionByName(
            e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"))
        )
        return both.distinct()

    def attach(self, *families: DataFrame) -> DataFrame:
        """Left-join feature families onto the node ids, so that every node keeps one row."""
        out = self.ids()
        for family in families:
            out = out.join(family, "node_id", "left")
        return out
