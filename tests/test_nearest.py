"""The exact neighbour join next to plain numpy: many cells and blocks, hot points, ties, odd values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.operators import anomaly, nearest
from ringsight.operators.nearest import nearest_rows, points_of


def plain(ids, x, k):
    """For every row its k nearest others as (distance, smallest id of the equal rows), sorted."""
    first = {}
    for i, p in sorted(zip(ids, map(tuple, x))):
        first.setdefault(p, i)
    name = np.array([first[tuple(p)] for p in x])
    out = {}
    for at, i in enumerate(ids):
        d = nearest._distances(x[at : at + 1], x)[0]
        order = [j for j in np.lexsort((name, d)) if j != at][:k]
        out[int(i)] = [(round(float(d[j]), 9), int(name[j])) for j in order]
    return out, dict(zip(map(int, ids), map(int, name)))


@pytest.mark.parametrize("kind", ["clusters", "ties", "hot"])
def test_nearest_rows_match_plain_code(spark, monkeypatch, kind):
    for name, value in (("CELL", 40), ("BLOCK", 16), ("VISITORS", 50)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.RandomState(5)
    if kind == "clusters":
        x = rng.normal(size=(8, 4))[rng.randint(0, 8, 700)] * 5 + rng.normal(size=(700, 4)) * rng.choice([0.1, 2.0], size=(700, 1))
    elif kind == "ties":
        x = rng.randint(0, 6, size=(500, 3)).astype(float)  # a grid: many equal distances and equal rows
    else:
        x = np.concatenate([rng.normal(size=(250, 2)), np.zeros((200, 2)), np.full((15, 2), 30.0)])
    ids = rng.permutation(len(x)) * 3
    k = 12
    want, name = plain(ids, x, k)
    columns = [f"c{j}" for j in range(x.shape[1])]
    rows = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, x)], "node_id long, " + ", ".join(f"{c} double" for c in columns))
    _, points = points_of(rows, columns)
    got = {}
    for r in nearest_rows(points, k).collect():
        got.setdefault(r.pid, []).extend([(round(r.away, 9), r.near)] * r.copies)
    assert set(got) == set(name.values())
    for i in want:
        assert sorted(got[name[i]]) == sorted(want[i]), (kind, i)


def test_outlier_factor_of_few_equal_and_odd_rows(spark):
    def scores(rows):
        df = spark.createDataFrame(rows, "node_id long, a double, b double")
        return {r.node_id: r.lof_score for r in anomaly.local_outlier_factor(df, ["a", "b"], k=3).collect()}

    assert scores([(1, 2.0, 3.0)]) == {1: 0.0}
    assert set(scores([(i, 1.0, 1.0) for i in range(9)]).values()) == {0.0}
    got = scores([(i, float(i % 3), 0.0) for i in range(12)] + [(90, None, float("nan")), (91, 0.0, 0.0), (92, -0.0, 0.0), (93, 50.0, 50.0)])
    assert got[90] == got[91] == got[92] == got[0] and max(got, key=got.get) == 93
    assert anomaly.local_outlier_factor(spark.createDataFrame([], "node_id long, a double, b double"), ["a", "b"]).isEmpty()


def test_seed_does_not_change_the_factor(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 30)
    rng = np.random.RandomState(2)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(200, 3)))], "node_id long, a double, b double, c double")
    one, two = (anomaly.local_outlier_factor(rows, ["a", "b", "c"], seed=s).withColumnRenamed("lof_score", f"s{s}") for s in (1, 2))
    assert one.join(two, "node_id").agg(F.max(F.abs(F.col("s1") - F.col("s2")))).first()[0] < 1e-12


def test_points_without_clusters_reach_few_cells():
    x = np.random.RandomState(3).normal(size=(4000, 6))
    steps, many = nearest._limits(x[:1000], 64)
    cell = nearest._cells(x, steps)
    assert many == 64 and np.bincount(cell, minlength=64).max() < 200
    low = np.array([x[cell == c].min(axis=0) for c in range(64)])
    high = np.array([x[cell == c].max(axis=0) for c in range(64)])
    step_low, step_high = np.empty((len(steps), 6)), np.empty((len(steps), 6))
    for at in reversed(range(len(steps))):
        column, _, below, other = steps[at]
        step_low[at] = low[below] if column < 0 else np.minimum(step_low[below], step_low[other])
        step_high[at] = high[below] if column < 0 else np.maximum(step_high[below], step_high[other])
    bound = np.array([np.sort(nearest._distances(x[i : i + 1], x)[0])[10] for i in range(300)])
    row, to = nearest._reached(x[:300], bound, steps, step_low, step_high)
    got = set(zip(row.tolist(), to.tolist()))
    for i in range(300):
        assert {int(c) for c in cell[nearest._distances(x[i : i + 1], x)[0] <= bound[i]]} <= {c for r, c in got if r == i}
    assert len(got) < 300 * 32  # half of the cells
    assert not len(nearest._reached(x[:0], bound[:0], steps, step_low, step_high)[0])
