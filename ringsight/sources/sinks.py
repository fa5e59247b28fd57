"""Sinks for feature families, predictions and metrics, and the column-wise concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ringsight.functions.scalars import finalize


def write_features(family: DataFrame, path: str) -> None:
    """One family per folder, all features finite floats."""
    finalize(family).write.mode("overwrite").parquet(path)


def concat_features(families: list[DataFrame], key: str = "node_id", keep_first: bool = False) -> DataFrame:
    """Families side by side on the first one's nodes.

    A repeated column gets the first free of ``_1``, ``_2``.. appended; with ``keep_first`` only its first copy stays.
    """
    given = {c for family in families for c in family.columns}
    taken: set[str] = set()
    out = None
    for family in families:
        picked = [F.col(key)]
        for c in family.columns:
            if c == key:
                continue
            if c in taken and keep_first:
                continue
            name, copies = c, 0
            while name in taken or (copies and name in given):
                copies += 1
                name = f"{c}_{copies}"
            taken.add(name)
            picked.append(F.col(f"`{c}`").alias(name))
        part = family.select(*picked)
        out = part if out is None else out.join(part, key, "left")
    return out


def predictions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.select(
        F.col("y").alias("true_label"), F.col("p").alias("pred_probability"),
        (F.col("p") > threshold).cast("int").alias("pred_label"),
    )


def write_predictions(scored: DataFrame, path: str, threshold: float = 0.5) -> None:
    """CSV of label, probability and predicted label."""
    predictions(scored, threshold).write.mode("overwrite").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row metrics table as JSON."""
    metrics.write.mode("overwrite").json(path)
