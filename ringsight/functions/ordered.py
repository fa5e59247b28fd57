"""Global and per-key order without gathering a group in one task.

A plain ``Window.partitionBy(key).orderBy(..)`` puts all rows of a key into one task, and a
window without keys puts the whole table there. These helpers range-partition on (key, order),
work inside each range, and add the totals of the earlier ranges. A key that holds a third of
all rows is then spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.session import cut_lineage


def _names(columns: list[str]) -> list[Column]:
    return [F.col(c) for c in columns]


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Add inclusive running sums per key, in ``order``.

    ``order`` must not leave large ties: callers pre-aggregate equal values or end it with an id.
    The ranges are checkpointed because a recomputed range partitioning may choose other bounds.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sort = [direction(c) for c in order]
    given = df.withColumns({f"_in_{name}": value for name, value in sums.items()})
    ranged = cut_lineage(
        given.repartitionByRange(*_names(keys), *sort).withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    # One row per key and range: at most as many rows per key as there are partitions.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(f"_in_{name}").alias(f"_all_{name}") for name in sums]
    )
    before = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    local = ranged.withColumns({f"_run_{n}": F.sum(f"_in_{n}").over(inside) for n in sums})
    joined = local.join(before, [*keys, "_range"])
    return joined.select(
        *df.columns, *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums]
    )


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of every row inside its key (or in the table when ``keys`` is empty)."""
    ranked = running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})
    return ranked.withColumn(name, F.col(name) - 1)


def blocks_with_halo(
    df: DataFrame, position: str, before: int = 0, after: int = 0, size: int = 100_000
) -> DataFrame:
    """Copy each row into the blocks whose frames reach it; add ``_block`` and ``_halo``.

    Row-frame windows then run per ``(keys, _block)`` over at most size+before+after rows, and
    the halo copies are dropped afterwards.
    """
    size = max(size, before + 1, after + 1)
    pos = F.col(position)
    first = F.greatest(F.lit(0), F.floor((pos - after) / size)).cast("bigint")
    last = F.floor((pos + before) / size).cast("bigint")
    spread = df.withColumn("_block", F.explode(F.sequence(first, last)))
    own = F.floor(pos / size).cast("bigint")
    return spread.withColumn("_halo", F.col("_block") != own)


def melt(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Long form ``(ids.., column, value)`` of double columns."""
    return df.unpivot(
        ids, [F.col(c).cast("double").alias(c) for c in columns], "column", "value"
    )


def value_counts(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distinct values per key with their count ``n`` and the count ``upto`` of rows not above them."""
    counted = value_counts(long.where(F.col(value).isNotNull()), keys, value)
    return running_sums(counted, keys, [value], {"upto": F.col("n")})


def exact_quantiles(long: DataFrame, keys: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """Exact linearly interpolated quantiles per key: one array column ``q`` in the order of ``probs``.

    Values are counted, range-sorted and located by rank, so no task holds all values of a key.
    """
    ranked = ranked_values(long, keys, value)
    sizes = ranked.groupBy(*keys).agg(F.sum("n").alias("_size"))
    placed = ranked.join(sizes, keys) if keys else ranked.withColumn("_size", sizes.scalar())
    start, end, v = F.col("upto") - F.col("n"), F.col("upto"), F.col(value)

    def at(p: float, how) -> Column:
        index = how((F.col("_size") - 1) * F.lit(p))
        return F.max(F.when((start <= index) & (index < end), v))

    picked = placed.groupBy(*keys).agg(
        F.first("_size").alias("_size"),
        *[at(p, F.floor).alias(f"_lo{i}") for i, p in enumerate(probs)],
        *[at(p, F.ceil).alias(f"_hi{i}") for i, p in enumerate(probs)],
    )

    def blend(i: int, p: float) -> Column:
        index = (F.col("_size") - 1) * F.lit(p)
        share = index - F.floor(index)
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share

    return picked.select(*keys, F.array(*[blend(i, p) for i, p in enumerate(probs)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> Column:
    """Exact quantiles of whole columns as a map ``column -> array``, a scalar subquery."""
    q = exact_quantiles(melt(df, [], columns), ["column"], probs)
    # One entry per column of the table, however many rows it has.
    return q.agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("m")).scalar()


def average_ranks(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Rank (1-based, ties averaged) of every value inside its column, in wide form ``<column>``."""
    long = melt(df, ids, columns)
    ranked = ranked_values(long, ["column"]).select(
        "column", "value", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("_rank")
    )
    joined = long.join(ranked, ["column", "value"])
    return joined.groupBy(*ids).agg(
        *[F.max(F.when(F.col("column") == c, F.col("_rank"))).alias(c) for c in columns]
    )
