"""Statistics over bottom-k samples of two steps, without writing the steps out as rows.

All ends ``w`` get one number by the order of their hash. The task of a group of start nodes gets their first steps
and then the second steps of all nodes by ranges of that number, lowest first; a start node with ``k`` ends takes no
part in later ranges. What a task holds is one range and its own first steps. The second steps lie in one shuffle that
all tasks read and put in order; no step is written once per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringsight.functions.ordered import with_position
from ringsight.operators.blocks import (
    CHUNK, FIRST, SECOND, VALUES, WITHOUT, _dealt_to, _grown, _ids, _once, _places, _shrunk, _whole_ids,
)

RANGES = 64
FIRST_PER_TASK = 8_000_000
SMALL = 10_000
STATS = "csdqhl"  # count, sum, sum and squares of centred values, highest, lowest
PACKED = "side int, kind int, a binary, b binary, gaps binary"


def _packed(rows: DataFrame, kind: int) -> DataFrame:
    """Rows ``(side, a, b)`` or ``(side, a, x0, ..)`` as one large binary row per side and batch, sorted by ``a``."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        side, a = (_ids(table.column(c).combine_chunks()) for c in (0, 1))
        order = np.lexsort((a, side))
        side, a, gaps = side[order], a[order], None
        if kind == VALUES:
            columns = [c.combine_chunks() for c in table.columns[2:]]
            b = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])[order]
            gaps = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])[order]
        else:
            b = _ids(table.column(2).combine_chunks())[order]
        edges = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1], [True]]))
        spans = list(zip(edges[:-1], edges[1:]))
        return pa.record_batch([
            pa.array([int(side[x]) for x, _ in spans], pa.int32()), pa.array([kind] * len(spans), pa.int32()),
            pa.array([a[x : x + 1].tobytes() + _shrunk(np.diff(a[x:y], prepend=a[x : x + 1])) for x, y in spans], pa.binary()),
            pa.array([b[x:y].tobytes() if kind == VALUES else _shrunk(b[x:y]) for x, y in spans], pa.binary()),
            pa.array([gaps[x:y].tobytes() if gaps is not None and gaps[x:y].any() else None for x, y in spans], pa.binary()),
        ], names=["side", "kind", "a", "b", "gaps"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size >= CHUNK:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(each, PACKED)


def _steps(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64, 1) + np.cumsum(_grown(data[8:]))


class _Group:
    """The start nodes of one group, while the ranges pass by."""

    def __init__(self, k: int, centre: np.ndarray):
        self.k, self.centre, self.width = k, centre, len(centre)
        self.first, self.ready, self.held, self.left_out = [], False, {}, {}

    def take(self, span: int, row: dict) -> None:
        if row["kind"] == FIRST:
            self.first.append((_steps(row["a"]), _grown(row["b"])))
        elif row["kind"] == WITHOUT:
            self.left_out.setdefault(span, []).append(row)
        else:
            self.held.setdefault(row["kind"], []).append(row)

    def _start(self) -> None:
        u = np.concatenate([*[a for a, _ in self.first], np.empty(0, np.int64)])
        v = np.concatenate([*[b for _, b in self.first], np.empty(0, np.int64)])
        order = np.argsort(u, kind="stable")
        self.u, edge = np.unique(u[order], return_index=True)
        self.edge = np.append(edge, len(u))
        self.mids, self.at = np.unique(v[order], return_inverse=True)
        self.found, self.first, self.ready = np.zeros(len(self.u), np.int64), [], True

    def _both(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.held.get(kind, [])
        empty = np.empty(0, np.int64)
        return np.concatenate([*[_steps(r["a"]) for r in rows], empty]), np.concatenate([*[_grown(r["b"]) for r in rows], empty])

    def range_done(self, span: int) -> Iterator[pa.RecordBatch]:
        """Ends of the range that passed, for all start nodes that still want some."""
        if not self.ready:
            self._start()
        self.held[WITHOUT] = self.left_out.pop(span, [])
        open_ = np.flatnonzero(self.found < self.k)
        v, r = self._both(SECOND) if len(open_) else (self.mids[:0], self.mids[:0])
        mid = _places(self.mids, v)
        mid, r = mid[mid >= 0], r[mid >= 0]
        if len(r):
            ends, to = np.unique(r, return_inverse=True)
            to = to[np.argsort(mid, kind="stable")]
            start = np.concatenate([[0], np.cumsum(np.bincount(mid, minlength=len(self.mids)))])
            a, b = self._both(WITHOUT)
            a, b = _places(self.u, a), _places(ends, b)
            self.out = np.unique(a[(a >= 0) & (b >= 0)] * len(ends) + b[(a >= 0) & (b >= 0)])
            self._values(ends)
            for u, w in self._runs(open_, to, start, len(ends)):
                yield from self._stats(u, w)
        self.held = {}

    def _runs(self, open_: np.ndarray, to: np.ndarray, start: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of start nodes and ends, sorted; at most what is still missing per start node."""
        paths = np.diff(start)
        per_step = paths[self.at]
        before = np.concatenate([[0], np.cumsum(per_step)])
        size = before[self.edge[open_ + 1]] - before[self.edge[open_]]
        total, i = np.concatenate([[0], np.cumsum(size)]), 0
        while i < len(open_):
            j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, "right")) - 1)
            if size[i] > CHUNK:
                seen, lo, last = np.zeros(wide, bool), int(self.edge[open_[i]]), int(self.edge[open_[i] + 1])
                while lo < last:
                    hi = min(last, max(lo + 1, int(np.searchsorted(before, before[lo] + CHUNK, "right")) - 1))
                    seen[self._ends(np.arange(lo, hi), per_step, to, start)] = True
                    lo = hi
                key = open_[i] * wide + np.flatnonzero(seen)
            else:
                u = open_[i:j]
                count = self.edge[u + 1] - self.edge[u]
                step = np.repeat(self.edge[u] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                key = np.unique(np.repeat(u, size[i:j]) * wide + self._ends(step, per_step, to, start))
            i = j
            if len(self.out) and len(key):
                at = np.searchsorted(self.out, key)
                at[at == len(self.out)] = 0
                key = key[self.out[at] != key]
            if not len(key):
                continue
            u, w = np.divmod(key, wide)
            new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            place = np.arange(len(u)) - np.repeat(new, np.diff(np.append(new, len(u))))
            keep = place < self.k - self.found[u]
            u, w = u[keep], w[keep]
            np.add.at(self.found, u, 1)
            yield u, w

    def _ends(self, step: np.ndarray, per_step: np.ndarray, to: np.ndarray, start: np.ndarray) -> np.ndarray:
        size = per_step[step]
        return to[np.repeat(start[self.at[step]] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def _values(self, ends: np.ndarray) -> None:
        """Statistics of the values of every end, over all rows of one id."""
        shape = (len(ends), self.width)
        self.has = np.zeros(len(ends), bool)
        self.stats = {c: np.full(shape, {"h": -np.inf, "l": np.inf}.get(c, 0.0)) for c in STATS}
        for row in self.held.get(VALUES, []):
            x = np.frombuffer(row["b"], np.float64).reshape(-1, self.width)
            valid = ~np.frombuffer(row["gaps"], bool).reshape(-1, self.width) if row["gaps"] else np.ones(x.shape, bool)
            at = _places(ends, _steps(row["a"]))
            x, valid, at = x[at >= 0], valid[at >= 0], at[at >= 0]
            away = np.where(valid, x - self.centre, 0.0)
            self.has[at] = True
            for c, part in (("c", valid.astype(float)), ("s", np.where(valid, x, 0.0)), ("d", away), ("q", away * away)):
                np.add.at(self.stats[c], at, part)
            np.maximum.at(self.stats["h"], at, np.where(valid, x, -np.inf))
            np.fmin.at(self.stats["l"], at, np.where(valid, x, np.inf))

    def _stats(self, u: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, w = u[self.has[w]], w[self.has[w]]
        if not len(u):
            return
        new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        columns, names = [pa.array(self.u[u[new]], pa.int64())], ["u"]
        how = {"h": np.maximum.reduceat, "l": np.fmin.reduceat}
        for c in STATS:
            x = how.get(c, np.add.reduceat)(self.stats[c][w], new, axis=0)
            if c == "c":
                none = x == 0
            columns += [pa.array(x[:, i], mask=none[:, i]) for i in range(self.width)]
            names += [f"{c}{i}" for i in range(self.width)]
        yield pa.record_batch(columns, names=names)


def whole_ids(*steps: DataFrame) -> bool:
    return _whole_ids(steps[0], steps[1])


def sampled_end_stats(
    first: DataFrame, second: DataFrame, hashed, k: int, values: DataFrame, names: list[str],
    without: DataFrame | None = None, parts: int | None = None, ranges: int = RANGES,
) -> DataFrame:
    """``(u, c0.., s0.., d0.., q0.., h0.., l0..)`` over the ``k`` distinct ends of lowest ``hashed(w)`` of every u.

    ``first(u, v)`` and ``second(v, w)`` are distinct pairs of whole numbers; pairs in ``without(u, w)`` are no ends. Per column
    of ``values(w, names..)``: count, sum, highest and lowest value, and sum and squares (``d``, ``q``) less the column's mean.
    Ends without values count towards ``k``.
    """
    centre = np.array([x or 0.0 for x in values.agg(*[F.avg(F.col(c).cast("double")) for c in names]).first()], dtype=float)
    if parts is None:
        size = first.count()
        parts = 1 if size < SMALL else max(16, -(-size // FIRST_PER_TASK))
    ends = second.select("w").distinct().withColumn("h", hashed("w"))
    order = with_position(ends, [], ["h", "w"], "r").select(F.col("w").alias("_w"), F.col("r").cast("bigint").alias("r"))
    order = order.withColumn("side", F.floor(F.col("r") * ranges / F.greatest(F.lit(1), F.lit(order.count()))).cast("bigint"))
    at_w = lambda rows: rows.join(order, F.col("w").eqNullSafe(F.col("_w")))
    group = F.pmod(F.hash(F.col("u").cast("bigint")), F.lit(parts))
    big = lambda c, name: F.col(c).cast("bigint").alias(name)

    starts = first.where("u is not null and v is not null").select(group.cast("bigint").alias("side"), big("u", "a"), big("v", "b"))
    packed = ["span", "kind", "a", "b", "gaps"]
    mine = _packed(starts, FIRST).select(F.col("side").alias("group"), F.lit(-1).alias("span"), "kind", "a", "b", "gaps")
    far = at_w(second.where("v is not null")).select("side", big("v", "a"), big("r", "b"))
    held = at_w(values.where("w is not null")).select(
        "side", big("r", "a"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    )
    if without is not None:
        pairs = at_w(without.where("u is not null and w is not null")).select(
            (F.col("side") * parts + group).cast("bigint").alias("side"), big("u", "a"), big("r", "b")
        )
        mine = mine.unionByName(_packed(pairs, WITHOUT).select(
            (F.col("side") % parts).alias("group"), F.floor(F.col("side") / parts).cast("int").alias("span"), "kind", "a", "b", "gaps"
        ))
    far = _packed(far, SECOND).unionByName(_packed(held, VALUES)).withColumnRenamed("side", "span").repartition(1)
    rows = _once(far.sortWithinPartitions("span"), _dealt_to(mine, F.col("group"), parts).select(*packed), packed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, state = None, _Group(k, centre)
        for batch in batches:
            for row in batch.to_pylist():
                # All rows of the group come with the first row of the ranges.
                for side in "yx":
                    if row[f"{side}_kind"] is None:
                        continue
                    if side == "x" and row["x_span"] != span:
                        if span is not None:
                            yield from state.range_done(span)
                        span = row["x_span"]
                    state.take(row[f"{side}_span"], {c: row[f"{side}_{c}"] for c in ("kind", "a", "b", "gaps")})
        if span is not None:
            yield from state.range_done(span)

    columns = [f"{c}{i}" for c in STATS for i in range(len(names))]
    found = rows.mapInArrow(
        each, "u bigint, " + ", ".join(f"{c} double" for c in columns)
    )
    how = {"h": F.max, "l": F.min}
    return found.groupBy(F.col("u").cast(first.schema["u"].dataType).alias("u")).agg(
        *[how.get(c[0], F.sum)(c).alias(c) for c in columns]
    )
