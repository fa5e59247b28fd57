"""Look-back windows of many lengths over a key and an integer time, safe for hot keys.

Rows are first aggregated to one per (key, time) and laid out in time blocks at least as long as
the longest look-back; each row is copied into the next block as well when a look-back can reach
it from there. A window task then sees one block of one key, whose size is bounded by the number
of time units in two blocks and not by the number of rows.

A look-back sum is the difference of two running sums. Spark evaluates frames that start at
UNBOUNDED PRECEDING incrementally, so the cost per row does not grow with the look-back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def in_blocks(df: DataFrame, time: str, size: int, reach: int) -> DataFrame:
    """Copy rows into every block from which a look-back of ``reach`` can see them."""
    first, last = F.floor(F.col(time) / size), F.floor((F.col(time) + reach) / size)
    return df.withColumn("_block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))


def own_block(time: str, size: int) -> Column:
    return F.col("_block") == F.floor(F.col(time) / size)


def block_size(lookbacks: list[int], at_least: int) -> int:
    return max(at_least, max(lookbacks) + 1)


def lookback_sums(
    blocks: DataFrame, keys: list[str], time: str, sums: list[str], lookbacks: list[int],
    running: list[str] = (), include_now: bool = True,
) -> DataFrame:
    """Add ``<sum>_<L>`` over [t-L, t] (or [t-L, t-1]) and ``<running>_now`` over the block up to t."""
    w = Window.partitionBy(*keys, "_block").orderBy(time)
    upto = w.rangeBetween(Window.unboundedPreceding, 0 if include_now else -1)
    zero = F.lit(0)
    added = {f"{c}_now": F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, 0)) for c in running}
    for length in lookbacks:
        before = w.rangeBetween(Window.unboundedPreceding, -(length + 1))
        for c in sums:
            added[f"{c}_{length}"] = F.coalesce(F.sum(c).over(upto), zero) - F.coalesce(F.sum(c).over(before), zero)
    return blocks.withColumns(added)


def presence_changes(
    seen: DataFrame, keys: list[str], time: str, lookbacks: list[int], size: int
) -> DataFrame:
    """How the number of distinct values in each look-back changes over time.

    ``seen(keys.., dim, value, time)``: a value enters every window when it occurs and leaves the
    window of length L after L units, unless it has occurred again by then. One row per change:
    ``(keys.., _block, dim, time, lo, hi, change)`` for the look-backs number lo..hi.
    """
    reach = max(lookbacks)
    blocks = in_blocks(seen.distinct(), time, size, reach)
    again = F.lead(time).over(Window.partitionBy(*keys, "_block", "dim", "value").orderBy(time))
    rows = blocks.withColumn("_again", again)
    t, nxt, top = F.col(time), F.col("_again"), len(lookbacks) - 1

    def change(when: Column, lo: Column, hi: Column, by: int) -> Column:
        return F.struct(
            when.cast("bigint").alias("at"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(by).alias("change")
        )

    ordered = sorted(lookbacks)
    gone = [
        F.when(nxt.isNull() | (t + length + 1 < nxt), change(t + length + 1, F.lit(i), F.lit(i), -1))
        for i, length in enumerate(ordered)
    ]
    shorter = sum([(t + length + 1 < nxt).cast("int") for length in ordered[1:]], (t + ordered[0] + 1 < nxt).cast("int"))
    renewed = F.when(nxt.isNotNull() & (shorter <= top), change(nxt, shorter, F.lit(top), -1))
    entered = change(t, F.lit(0), F.lit(top), 1)
    events = F.filter(F.array(entered, renewed, *gone), lambda e: e.isNotNull())
    return rows.select(*keys, "_block", "dim", F.inline(events)).withColumnRenamed("at", time)
