"""Small dense algebra over distributed rows: moments, PCA, projections, orthonormal blocks.

Only matrices whose size depends on the number of columns reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.scalars import SEED, seeded_unit, total


def vectors(df: DataFrame, columns: list[str], keep: list[str], name: str = "_v") -> DataFrame:
    rows = df.select(*keep, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    assembler = VectorAssembler(inputCols=[f"_c{i}" for i in range(len(columns))], outputCol=name)
    return assembler.transform(rows).select(*keep, name)


def mean_and_std(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Column means and population standard deviations."""
    row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    values = np.array([0.0 if v is None else v for v in row], dtype=float).reshape(-1, 2)
    return values[:, 0], values[:, 1]


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance; one distributed Gram matrix."""
    mean, std = mean_and_std(df, columns)
    corr = correlation(df, columns)
    return mean, corr * np.outer(std, std)


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix; a constant column correlates 0 with the others and 1 with itself."""
    if len(columns) == 1:
        return np.ones((1, 1))
    rows = vectors(df, columns, [])
    corr = np.nan_to_num(Correlation.corr(rows, "_v").first()[0].toArray(), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    return corr


def centred(df: DataFrame, columns: list[str], key: str, scale: bool = False) -> DataFrame:
    mean, std = mean_and_std(df, columns)
    std = np.where(std == 0, 1.0, std) if scale else np.ones_like(std)
    return df.select(key, *[
        ((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(columns, mean, std)
    ])


def fix_signs(components: np.ndarray) -> np.ndarray:
    """One sign per column: its largest loading is positive."""
    lead = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return components * np.where(lead < 0, -1.0, 1.0)


def pca(df: DataFrame, columns: list[str], k: int, prefix: str, key: str = "node_id") -> DataFrame:
    """Scores on the first k principal components of the centred columns."""
    rows = centred(df, columns, key)
    model = PCA(k=min(k, len(columns)), inputCol="_v", outputCol="_p").fit(vectors(rows, columns, []))
    return project(rows, columns, fix_signs(model.pc.toArray()), prefix, key)


WIDE = 120


def project(df: DataFrame, columns: list[str], matrix: np.ndarray, prefix: str, key: str = "node_id") -> DataFrame:
    """Row times matrix; the matrix has one row per column.

    A small matrix becomes a plain expression; a larger one, whose generated code would be too
    long, is multiplied batch by batch.
    """
    if matrix.size <= WIDE:
        return df.select(key, *[
            total([F.col(c) * F.lit(float(w)) for c, w in zip(columns, matrix[:, j])]).alias(f"{prefix}{j}")
            for j in range(matrix.shape[1])
        ])
    names = [f"{prefix}{j}" for j in range(matrix.shape[1])]

    def multiply(batches):
        for batch in batches:
            out = pd.DataFrame(batch[columns].to_numpy(dtype=float) @ matrix, columns=names)
            out.insert(0, key, batch[key].to_numpy())
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInPandas(multiply, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def gaussian(rows: int, columns: int, seed: int = SEED) -> np.ndarray:
    """Fixed standard normal matrix for random projections."""
    return np.random.RandomState(seed).standard_normal((rows, columns))


def seeded_normal(*keys: Column | str, seed: int | str = SEED) -> Column:
    """Standard normal number per row, from two seeded uniforms."""
    u = seeded_unit(*keys, seed=f"{seed}a")
    v = seeded_unit(*keys, seed=f"{seed}b")
    return F.sqrt(-2.0 * F.log1p(-u)) * F.cos(2.0 * math.pi * v)


def row_norm(columns: list[str]) -> Column:
    return F.sqrt(total([F.col(c) * F.col(c) for c in columns]))


def unit_rows(df: DataFrame, key: str = "node_id", eps: float = 1e-8) -> DataFrame:
    names = [c for c in df.columns if c != key]
    norm = row_norm(names) + eps
    return df.select(key, *[(F.col(c) / norm).alias(c) for c in names])


def gram(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Inner products of columns: one small block per task, added up by cell."""
    names = list(dict.fromkeys([*left, *right]))
    width = len(right)

    def partial(batches):
        block = np.zeros((len(left), width))
        for batch in batches:
            block += batch[left].to_numpy(dtype=float).T @ batch[right].to_numpy(dtype=float)
        yield pd.DataFrame({"cell": np.arange(block.size), "value": block.ravel()})

    cells = df.select(*names).mapInPandas(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(len(left) * width)
    for row in cells.collect():  # one row per cell of the small matrix
        out[row["cell"]] = row["value"]
    return out.reshape(len(left), width)


def orthonormal(df: DataFrame, columns: list[str], key: str = "node_id") -> DataFrame:
    """Replace the columns by an orthonormal basis of their span (Gram matrix on the driver)."""
    values, basis = np.linalg.eigh(gram(df, columns, columns))
    safe = np.maximum(values, 1e-300)
    keep = values > values.max() * 1e-14
    mix = basis * np.where(keep, 1.0 / np.sqrt(safe), 0.0)
    return project(df, columns, mix, columns[0].rstrip("0123456789"), key)
