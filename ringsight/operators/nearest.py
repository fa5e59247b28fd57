"""Exact k nearest rows of every row, from all rows, by cells between limits of their columns.

Equal rows are one point with a number of copies, so a value that a third of all rows hold costs
one row here. Space is cut in cells at medians of drawn points, always across the column in which
the fullest cell is widest; a cell lies in blocks of bounded size. A point's neighbours inside its
own block bound the distance of its k-th one; it then visits the blocks of just those cells whose
points' smallest box comes nearer than that bound. Only the limits rest on drawn points: all rows are
compared, and no list is cut before the k nearest are known.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringsight.functions.scalars import SEED, finite, seeded_hash, seeded_unit
from ringsight.session import cut_lineage

CELL = 250  # points to a cell, as long as there are not too many cells
MOST_CELLS = 8192
DRAWN = 8  # points drawn for each cell to be cut
BLOCK = 2048  # points to a block, about
VISITORS = 4096  # visiting points that meet a block in one task, about
CHUNK = 1 << 17  # distances computed at once; they stay in the cache
NEAR = 1e-9  # relative slack of the bounds, for rounding


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed column by column: the same for a pair wherever it is computed."""
    out = np.zeros((len(a), len(b)))
    gap = np.empty_like(out)
    for j in range(a.shape[1]):
        np.subtract(a[:, j, None], b[None, :, j], out=gap)
        out += np.multiply(gap, gap, out=gap)
    return np.sqrt(out, out=out)


def _nearest(away: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the first points of each row whose copies make k, nearest first, then by id.

    ``copies`` may be a matrix; a point of no copies is passed over. Rows with fewer give what they have.
    """
    counts = np.broadcast_to(copies, away.shape)
    away = np.where(counts > 0, away, np.inf)
    row, col = np.nonzero(counts > 0)
    if away.shape[1] > k and len(row) > k * len(away):
        kth = np.partition(away, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((away <= kth[:, None]) & (counts > 0))
    order = np.lexsort((ids[col], away[row, col], row))
    row, col = row[order], col[order]
    before = np.cumsum(counts[row, col]) - counts[row, col]
    first = np.searchsorted(row, np.arange(len(away)))
    start = before[np.minimum(first, max(len(row) - 1, 0))] if len(row) else np.zeros(len(away))
    keep = before - start[row] < k
    return row[keep], col[keep]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def points_of(rows: DataFrame, columns: list[str], key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """``(key, columns..)`` with finite numbers, and the distinct ``(pid, copies, x)``; ``pid`` is the smallest key."""
    # Adding 0 makes one zero of two; null, NaN and infinite values count as 0.
    clean = rows.select(key, *[(finite(F.col(f"`{c}`")) + F.lit(0.0)).alias(c) for c in columns])
    points = clean.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("copies"))
    return clean, points.select("pid", "copies", F.array(*[F.col(f"`{c}`") for c in columns]).alias("x"))


def _drawn(points: DataFrame, n: int, wanted: int, seed: int | str) -> np.ndarray:
    most = wanted * DRAWN
    drawn = points.where(seeded_unit("pid", seed=seed) < F.lit(min(1.0, (2.0 * most + 40.0) / n)))
    rows = drawn.orderBy(seeded_hash("pid", seed=seed), "pid").limit(most).select("x").collect()  # MOST_CELLS * DRAWN at most
    return np.array([r.x for r in rows], float)


def _limits(drawn: np.ndarray, wanted: int) -> tuple[list[tuple[int, float, int, int]], int]:
    """Steps ``(column, limit, below, other)`` and the number of cells; a step without a column (-1) ends in cell ``below``."""
    steps: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    waiting, cells = [(-len(drawn), 0, drawn)], 1
    while waiting and cells < wanted:
        _, at, x = heapq.heappop(waiting)
        spread = x.std(axis=0)
        j = int(spread.argmax())
        values = np.sort(x[:, j])
        if values[0] == values[-1]:
            continue  # equal points: they are not cut
        middle = values[len(values) // 2]
        above = values[np.searchsorted(values, middle, "right") :]
        # Of the values next to the median the one that halves the points best.
        choices = [v for v in (middle, *above[:1]) if v > values[0]]
        limit = float(min(choices, key=lambda v: abs(2 * int(np.searchsorted(values, v)) - len(values))))
        below = x[:, j] < limit
        own = steps[at][2]
        steps[at] = (j, limit, len(steps), len(steps) + 1)
        for part, cell in ((x[below], own), (x[~below], cells)):
            heapq.heappush(waiting, (-len(part), len(steps), part))
            steps.append((-1, 0.0, cell, 0))
        cells += 1
    return steps, cells


def _cells(x: np.ndarray, steps: list[tuple[int, float, int, int]]) -> np.ndarray:
    column, limit, below, other = (np.array(part) for part in zip(*steps))
    at = np.zeros(len(x), np.int64)
    while True:
        going = np.flatnonzero(column[at] >= 0)
        if not len(going):
            return below[at].astype(np.int32)
        now = at[going]
        at[going] = np.where(x[going, column[now]] < limit[now], below[now], other[now])


def _reached(x: np.ndarray, bound: np.ndarray, steps: list[tuple[int, float, int, int]], low: np.ndarray, high: np.ndarray):
    """Row and cell numbers where the box of the cell comes within the bound; ``low`` and ``high`` are the boxes of all steps."""
    column, _, below, other = (np.array(part) for part in zip(*steps))
    row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, cells = [row[:0]], [at[:0]]
    while len(row):
        least = np.zeros(len(row))
        for j in range(x.shape[1]):
            gap = np.maximum(low[at, j] - x[row, j], x[row, j] - high[at, j])
            least += np.maximum(gap, 0.0) ** 2
        near = np.sqrt(least) <= bound[row] * (1 + NEAR)
        row, at = row[near], at[near]
        leaf = column[at] < 0
        rows.append(row[leaf])
        cells.append(below[at[leaf]])
        row, at = row[~leaf], at[~leaf]
        row, at = np.concatenate([row, row]), np.concatenate([below[at], other[at]])
    return np.concatenate(rows), np.concatenate(cells)


def nearest_rows(points: DataFrame, k: int, seed: int | str = SEED) -> DataFrame:
    """``(pid, near, copies, away)``: the k nearest other rows of a row of each point.

    ``points(pid, copies, x)`` as of ``points_of``. A row's own copies are neighbours at distance 0;
    of equally distant points the one with the smaller ``pid`` comes first; ``copies`` is how many of
    the k rows the point ``near`` gives. With k other rows or fewer, all are neighbours.
    """
    schema = "pid bigint, near bigint, copies bigint, away double"
    points = cut_lineage(points)
    spark = points.sparkSession
    n, total = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    k = min(k, total - 1)
    if k < 1:
        return spark.createDataFrame([], schema)
    wanted = max(1, min(MOST_CELLS, n // CELL))
    steps, many = _limits(_drawn(points, n, wanted, f"{seed}cells"), wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            cell = _cells(x, steps) if len(x) else np.empty(0, np.int32)
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    placed = cut_lineage(points.mapInArrow(place, "pid bigint, copies bigint, x array<double>, cell int"))
    width = len(points.select("x").first().x)
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"),
        F.array(*[F.min(F.col("x")[j]) for j in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[j]) for j in range(width)]).alias("high"),
    ).collect()  # one row per cell
    # The box of a cell without points reaches nothing and is reached by nothing.
    low, high = np.full((many, width), np.inf), np.full((many, width), -np.inf)
    size, weight = np.zeros(many, np.int64), np.zeros(many, np.int64)
    for s in stats:
        low[s.cell], high[s.cell], size[s.cell], weight[s.cell] = s.low, s.high, s.n, s.copies
    blocks = np.maximum(1, -(-size // BLOCK))
    # So far from a point of the cell lie k others: those of its own cell, or all of the nearest cells that hold enough rows.
    filled = np.flatnonzero(size)
    enough = np.sqrt(((high - low) ** 2).sum(axis=1))
    for c in filled[weight[filled] <= k]:
        reach = np.sqrt((np.maximum(high[c] - low[filled], high[filled] - low[c]) ** 2).sum(axis=1))
        order = np.argsort(reach)
        enough[c] = reach[order[np.searchsorted(np.cumsum(weight[filled][order]), k + 1)]]
    step_low, step_high = np.empty((len(steps), width)), np.empty((len(steps), width))
    for at in reversed(range(len(steps))):  # parts come after the step that makes them
        column, _, below, other = steps[at]
        if column < 0:
            step_low[at], step_high[at] = low[below], high[below]
        else:
            step_low[at], step_high[at] = np.minimum(step_low[below], step_low[other]), np.maximum(step_high[below], step_high[other])
    cells = spark.createDataFrame(
        [(c, int(b)) for c, b in enumerate(blocks)], "cell int, blocks int"
    )

    def inside(block: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(block["x"]), block["pid"].to_numpy()
        copies = block["copies"].to_numpy()
        pieces, bound = [], np.empty(len(x))
        step = max(1, CHUNK // len(x))
        for at in range(0, len(x), step):
            d = _distances(x[at : at + step], x)
            others = np.repeat(copies[None, :], len(d), axis=0)
            me = np.arange(at, at + len(d))
            others[np.arange(len(d)), me] -= 1
            row, col = _nearest(d, ids, others, k)
            met = np.bincount(row, others[row, col], len(d))
            last = np.zeros(len(d))
            np.maximum.at(last, row, d[row, col])
            far = enough[int(block["cell"].iloc[0])]
            bound[me] = np.where(met >= k, np.minimum(last, far), far)
            pieces.append((row + at, col, others[row, col], d[row, col]))
        row, col, count, d = (np.concatenate(p) for p in zip(*pieces))
        edges = np.searchsorted(row, np.arange(len(x) + 1))
        cut = lambda values: [values[edges[i] : edges[i + 1]] for i in range(len(x))]
        return block[["pid", "x", "cell", "block"]].assign(bound=bound, near=cut(ids[col]), counts=cut(count), aways=cut(d))

    dealt = placed.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    held = dealt.select("pid", "copies", "x", "cell", "block")
    local = cut_lineage(held.groupBy("cell", "block").applyInPandas(
        inside, "pid bigint, x array<double>, cell int, block int, bound double, near array<bigint>, counts array<bigint>, aways array<double>"
    ))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            own, bound = (batch.column(c).to_numpy() for c in ("cell", "bound"))
            row, cell = _reached(x, bound, steps, step_low, step_high)
            away = (cell != own[row]) | (blocks[own[row]] > 1)
            row, cell = row[away], cell[away]
            take = pa.array(row)
            yield pa.record_batch(
                [batch.column(c).take(take) for c in ("pid", "x", "bound", "cell", "block")] + [pa.array(cell.astype(np.int32))],
                names=["pid", "x", "bound", "own", "own_block", "cell"],
            )

    visits = cut_lineage(local.select("pid", "x", "cell", "block", "bound").mapInArrow(
        reached, "pid bigint, x array<double>, bound double, own int, own_block int, cell int"
    ))
    crowds = cut_lineage(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("visits")).join(F.broadcast(cells), "cell").select(
        "cell", "blocks", F.ceil(F.col("visits") / VISITORS).cast("int").alias("deals")
    ))  # one row per cell
    coming = visits.join(F.broadcast(crowds), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(
        (F.col("cell") != F.col("own")) | (F.col("block") != F.col("own_block"))
    ).select("cell", "block", F.pmod(F.xxhash64("pid", F.lit(1)), F.col("deals")).cast("int").alias("deal"), "pid", "x", "bound")
    waiting = held.join(F.broadcast(crowds.select("cell", "deals")), "cell").withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
    ).select("cell", "block", "deal", "pid", "copies", "x")

    def meet(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(guests) and len(hosts):
            there, ids, copies = _matrix(hosts["x"]), hosts["pid"].to_numpy(), hosts["copies"].to_numpy()
            step = max(1, CHUNK // len(there))
            for at in range(0, len(guests), step):
                part = guests.iloc[at : at + step]
                d = _distances(_matrix(part["x"]), there)
                close = np.where(d <= part["bound"].to_numpy()[:, None] * (1 + NEAR), copies[None, :], 0)
                row, col = _nearest(d, ids, close, k)
                out.append(pd.DataFrame({"pid": part["pid"].to_numpy()[row], "near": ids[col], "copies": copies[col], "away": d[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("pid", "near", "copies", "away")})

    keys = ["cell", "block", "deal"]
    abroad = coming.groupBy(*keys).cogroup(waiting.groupBy(*keys)).applyInPandas(meet, schema)
    home = local.select("pid", F.explode(F.arrays_zip("near", "counts", "aways")).alias("t")).select(
        "pid", "t.near", F.col("t.counts").alias("copies"), F.col("t.aways").alias("away")
    )
    before = F.coalesce(F.sum("copies").over(Window.partitionBy("pid").orderBy("away", "near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # k rows at most from every block a point visited.
    ranked = home.unionByName(abroad).withColumn("_before", before).where(F.col("_before") < k)
    return ranked.select("pid", "near", F.least("copies", k - F.col("_before")).alias("copies"), "away")
