"""Column-wise base features of a matrix ``(node_id, columns..)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.ordered import average_ranks, column_quantiles, exact_quantiles, melt, running_sums
from ringsight.functions.scalars import is_missing, one_row, total

EPS = 1e-8


def matrix_columns(df: DataFrame, key: str = "node_id") -> list[str]:
    return [c for c in df.columns if c != key]


def moments(df: DataFrame, columns: list[str]) -> Column:
    """Min, max, mean and population std of every column: one pass, one row."""
    return one_row(df.agg(*[
        how(c).alias(f"{c}_{s}") for c in columns
        for s, how in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
    ]))


def _per_column(df: DataFrame, suffix: str, make: Callable[[str], Column], key: str = "node_id") -> DataFrame:
    names = matrix_columns(df, key)
    return df.select(key, *[make(c).alias(f"feature_{i}_{suffix}") for i, c in enumerate(names)])


def log_shift(df: DataFrame) -> DataFrame:
    """log1p after moving columns with non-positive values just above zero."""
    m = moments(df, matrix_columns(df))

    def make(c: str) -> Column:
        low = m[f"{c}_min"]
        return F.log1p(F.when(low <= 0, F.col(c) - low + 1e-6).otherwise(F.col(c)))

    return _per_column(df, "log", make)


def sqrt_clip(df: DataFrame) -> DataFrame:
    """Square root of the non-negative part."""
    return _per_column(df, "sqrt", lambda c: F.sqrt(F.greatest(F.col(c), F.lit(0.0))))


def decile_bucket(df: DataFrame) -> DataFrame:
    """Number of the nine inner deciles that lie at or below the value."""
    names = matrix_columns(df)
    q = column_quantiles(df, names, [i / 10 for i in range(1, 10)])
    rows = df.withColumn("_q", q)

    def make(c: str) -> Column:
        return total([(F.col(c) >= F.col("_q")[c][i]).cast("int") for i in range(9)])

    return rows.select("node_id", *[make(c).alias(f"feature_{i}_bucket") for i, c in enumerate(names)])


def zscore(df: DataFrame, guard: str = "epsilon") -> DataFrame:
    """C4: (x - mean) / (std + 1e-8), or / std with constant columns left centred (``guard='one'``)."""
    m = moments(df, matrix_columns(df))

    def make(c: str) -> Column:
        std = m[f"{c}_std"]
        scale = F.when(std == 0, 1.0).otherwise(std) if guard == "one" else std + EPS
        return (F.col(c) - m[f"{c}_mean"]) / scale

    return _per_column(df, "standardized", make)


def minmax(df: DataFrame) -> DataFrame:
    """To [0, 1]; a constant column gives 0."""
    m = moments(df, matrix_columns(df))

    def make(c: str) -> Column:
        span = m[f"{c}_max"] - m[f"{c}_min"]
        return (F.col(c) - m[f"{c}_min"]) / F.when(span == 0, 1.0).otherwise(span)

    return _per_column(df, "normalized", make)


def interactions(df: DataFrame, reach: int = 2) -> DataFrame:
    """Products of a column with the next two."""
    names = matrix_columns(df)
    return df.select("node_id", *[
        (F.col(names[i]) * F.col(names[j])).alias(f"interaction_{i}_{j}")
        for i in range(len(names)) for j in range(i + 1, min(i + 1 + reach, len(names)))
    ])


def poly2(df: DataFrame, first: int | None = None) -> DataFrame:
    """Squares of all columns (or the first)."""
    names = matrix_columns(df)[:first]
    return df.select("node_id", *[(F.col(c) * F.col(c)).alias(f"feature_{i}_poly2") for i, c in enumerate(names)])


def rank_pct(df: DataFrame) -> DataFrame:
    """Average-tie rank over the number of rows."""
    ranks = average_ranks(df, ["node_id"], matrix_columns(df))
    n = df.agg(F.count(F.lit(1))).scalar()
    return _per_column(ranks, "rank", lambda c: F.col(c) / n)


def winsorize(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip every column to its quantiles."""
    names = matrix_columns(df)
    q = column_quantiles(df, names, [low, high])
    return df.select("node_id", *[
        F.least(F.greatest(F.col(c), q[c][0]), q[c][1]).alias(c) for c in names
    ])


def outlier_to_null(df: DataFrame, limit: float = 1e6) -> DataFrame:
    """Values beyond ``limit`` or not finite become missing."""
    def clean(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when((F.abs(v) > limit) | F.isnan(v), None).otherwise(v).alias(c)

    return df.select("node_id", *[clean(c) for c in matrix_columns(df)])


# --- C9: k bins ------------------------------------------------------------------------------

def _drop_close(edges: Column, tolerance: float = 1e-8) -> Column:
    """Leave out edges that do not move on from the last kept one."""
    first = F.slice(edges, 1, 1)
    return F.aggregate(
        F.slice(edges, 2, F.size(edges)), first,
        lambda kept, e: F.when(e - F.element_at(kept, -1) > tolerance, F.concat(kept, F.array(e))).otherwise(kept),
    )


def fit_bins(df: DataFrame, n_bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """Bin edges ``(column, edges)``; a few numbers per column, reusable on other tables."""
    names = matrix_columns(df)
    steps = [i / n_bins for i in range(n_bins + 1)]
    if strategy == "quantile":
        raw = exact_quantiles(melt(df, [], names), ["column"], steps).withColumnRenamed("q", "edges")
    else:
        spans = melt(df, [], names).groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b"))
        raw = spans.select("column", F.array(*[
            F.col("a") + (F.col("b") - F.col("a")) * F.lit(s) for s in steps
        ]).alias("edges"))
    return raw.select("column", _drop_close(F.col("edges")).alias("edges"))


def apply_bins(df: DataFrame, fitted: DataFrame, n_bins: int = 5) -> DataFrame:
    """Ordinal bin of every column under fitted edges (at most ``n_bins`` bins)."""
    # The inner edges only: values outside the fitted range fall into the first or last bin.
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = df.withColumn("_edges", fitted.agg(F.map_from_entries(F.collect_list(F.struct("column", inner)))).scalar())

    def ordinal(c: str) -> Column:
        above = [F.col(c) >= F.get(F.col("_edges")[c], F.lit(i)) for i in range(n_bins - 1)]
        return total([F.coalesce(a.cast("int"), F.lit(0)) for a in above])

    return rows.select("node_id", *[ordinal(c).alias(f"bin_{i}") for i, c in enumerate(matrix_columns(df))])


def kbins(df: DataFrame, n_bins: int = 5, strategy: str = "quantile") -> DataFrame:
    return apply_bins(df, fit_bins(df, n_bins, strategy), n_bins)


# --- C10: supervised bins --------------------------------------------------------------------

CANDIDATES = 1024  # cut points looked at per column: all values, or so many quantiles of more


def split_candidates(known: DataFrame, columns: list[str], y: str) -> DataFrame:
    """Per column, values spread evenly over the ranks, with the rows and positives at or below each."""
    counted = melt(known, [y], columns).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")
    )
    run = running_sums(counted, ["column"], ["value"], {"upto": F.col("n"), "pos_upto": F.col("pos")})
    sizes = counted.groupBy("column").agg(F.sum("n").alias("size"))
    step = lambda rank: F.floor(rank * CANDIDATES / F.col("size"))
    return run.join(sizes, "column").where(step(F.col("upto")) > step(F.col("upto") - F.col("n"))).select("column", "value", "upto", "pos_upto")


def best_cuts(values: list[float], upto: list[int], positives: list[int], n_bins: int, min_share: float) -> list[float]:
    """Best-first Gini splits of one column; ``upto`` and ``positives`` count rows at or below each value."""
    least = min_share * upto[-1]

    def impurity(n: float, p: float) -> float:
        return 2 * p * (1 - p / n) if n else 0.0

    def best(lo: int, hi: int) -> tuple[float, int]:
        """Gain and place of the best cut inside the candidates lo < i < hi (part: rows above lo up to hi)."""
        n0, p0 = (upto[lo], positives[lo]) if lo >= 0 else (0, 0)
        n, p = upto[hi] - n0, positives[hi] - p0
        gain, at = 0.0, -1
        for i in range(lo + 1, hi):
            left, hits = upto[i] - n0, positives[i] - p0
            if left >= least and n - left >= least:
                g = impurity(n, p) - impurity(left, hits) - impurity(n - left, p - hits)
                if g > gain + 1e-12:
                    gain, at = g, i
        return gain, at

    leaves = [(-1, len(values) - 1)]
    cuts: list[int] = []
    while len(leaves) < n_bins:
        (gain, at), leaf = max(((best(*leaf), leaf) for leaf in leaves), key=lambda x: (x[0][0], -x[1][0]))
        if at < 0:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], at), (at, leaf[1])]
        cuts.append(at)
    return [values[i] for i in sorted(cuts)]


def supervised_bins(
    df: DataFrame, label: str, columns: list[str], train: Column, n_bins: int = 5, min_share: float = 0.01
) -> DataFrame:
    """Per column, the cut points of a tree with at most ``n_bins`` leaves on the training rows, one-hot coded.

    All columns are counted in one pass; a leaf holds at least ``min_share`` of the training rows.
    """
    known = df.where(train & ~is_missing(F.col(label))).withColumn("_y", F.col(label).cast("int"))
    # CANDIDATES rows per column at most.
    table: dict[str, list] = {c: [] for c in columns}
    for r in split_candidates(known.select("_y", *columns), columns, "_y").orderBy("column", "value").collect():
        table[r["column"]].append(r)
    coded = []
    for c in columns:
        rows = table[c]
        cuts = best_cuts([r["value"] for r in rows], [r["upto"] for r in rows], [r["pos_upto"] for r in rows], n_bins, min_share) if rows else []
        value = F.lit(0)
        for cut in cuts:
            value = value + F.coalesce((F.col(c) > F.lit(cut)).cast("int"), F.lit(0))
        coded += [(value == b).cast("int").alias(f"{c}_bin_{b}") for b in range(len(cuts) + 1)]
    return df.select("node_id", *columns, *coded)
