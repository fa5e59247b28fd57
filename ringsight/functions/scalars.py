"""Column expressions used by several operator families."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SEED = 42


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_of(columns: list[Column]) -> Column:
    return total(columns) / F.lit(float(len(columns)))


def pop_std_of(columns: list[Column]) -> Column:
    mean = mean_of(columns)
    return F.sqrt(total([(c - mean) * (c - mean) for c in columns]) / F.lit(float(len(columns))))


def safe_div(a: Column, b: Column, fill: float = 0.0) -> Column:
    """a/b, and ``fill`` where b is zero or either side is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(fill))


def safe_divide_finite(a: Column, b: Column) -> Column:
    """a/b with every non-finite or missing result set to 0."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def finite(c: Column, fill: float = 0.0) -> Column:
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(fill)).otherwise(c)


def seeded_hash(*keys: Column | str, seed: int | str = SEED) -> Column:
    """Reproducible pseudo-random order: md5 of the seed and the keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_unit(*keys: Column | str, seed: int | str = SEED) -> Column:
    """Uniform number in [0, 1): the first 8 hex digits of the seeded hash."""
    head = F.substring(seeded_hash(*keys, seed=seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**32))


def is_missing(c: Column, null_value: float = -1.0) -> Column:
    return c.isNull() | F.isnan(c) | (c == F.lit(null_value))


def finalize(df: DataFrame, keep: Iterable[str] = ("node_id",), kind: str = "float") -> DataFrame:
    """Last projection of a feature family: missing and non-finite values to 0, one float type."""
    keep = set(keep)
    return df.select(
        *[F.col(f"`{c}`") if c in keep else finite(F.col(f"`{c}`")).cast(kind).alias(c) for c in df.columns]
    )


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as one struct column, planned as a scalar subquery."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()
