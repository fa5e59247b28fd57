"""Seeded top-k per key and seeded fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.functions.scalars import SEED, seeded_hash, seeded_unit


def first_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """At most ``k`` rows per key in the given order.

    The rank limit is planned as a window group limit before the shuffle, so a hot key sends at
    most k rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def sample_k_per_key(
    df: DataFrame, keys: list[str], hashed: list[str], ties: list[str], k: int, seed: int = SEED
) -> DataFrame:
    """H0: shuffle by a seeded hash, then the first ``k`` rows of each key."""
    return first_k(df, keys, [seeded_hash(*hashed, seed=seed), *ties], k)


def sample_fraction(df: DataFrame, hashed: list[str], fraction: float, seed: int = SEED) -> DataFrame:
    """A reproducible fraction of rows; a narrow filter, no shuffle."""
    return df.where(seeded_unit(*hashed, seed=seed) < F.lit(fraction))
