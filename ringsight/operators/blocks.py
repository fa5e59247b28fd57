"""Distinct pairs over two steps, and sums over them, block by block.

Nodes are dealt into ``parts`` groups by a hash. The task of block (i, j) gets the first steps of group i
and the second steps into group j. Each step is written to a shuffle once, where it lies for all tasks that read its
group, and no pair ever is: a pair (u, w) appears in one block only. Inside, starts are taken a small group at a time,
and paths are written out for a bounded number of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

CHUNK = 1 << 20  # steps packed into one row, and paths written out at a time
EDGES_PER_TASK = 12_000_000  # steps of one kind in a block
TURNS = 8  # groups of starts that a block takes one after the other
FIRST, SECOND, WITHOUT, VALUES = range(4)
NULL = np.iinfo(np.int64).min  # a null id inside a block
PACKED = "side int, kind int, a binary, b binary, gaps binary"


def _groups(ids: np.ndarray, parts: int) -> np.ndarray:
    x = ids.view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


def _shrunk(x: np.ndarray) -> bytes:
    """Whole numbers as the lowest one and narrow differences from it."""
    low = x.min()
    away = x.view(np.uint64) - low.view(np.uint64)
    kind = np.min_scalar_type(away.max())
    return low.tobytes() + bytes([kind.itemsize]) + away.astype(kind).tobytes()


def _grown(data: bytes) -> np.ndarray:
    low, away = np.frombuffer(data, np.uint64, 1), np.frombuffer(data, f"u{data[8]}", offset=9)
    return (away.astype(np.uint64) + low).view(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NULL)).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(rows: DataFrame, kind: int, parts: int) -> DataFrame:
    """Rows ``(a, b)`` as large binary ones, by the group of ``b`` for second steps and of ``a`` for others: sorted ``a``
    in steps, ``b`` as it is.

    Values are ``(a, x0, x1, ..)``: their matrix is ``b``, and ``gaps`` marks its nulls. Steps ``(a, b, weight)`` have
    their weights in ``gaps``.
    """
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        a = _ids(table.column(0).combine_chunks())
        if kind == VALUES:
            columns = [c.combine_chunks() for c in table.columns[1:]]
            b = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
            gaps = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        else:
            b, gaps = _ids(table.column(1).combine_chunks()), None
            if table.num_columns == 3:  # weights of steps
                gaps = table.column(2).combine_chunks().to_numpy(zero_copy_only=False)
        side = _groups(b if kind == SECOND else a, parts)
        order = np.lexsort((a, side))
        side, a, b = side[order], a[order], b[order]
        edges = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1], [True]]))
        out = [[], [], [], [], []]
        for x, y in zip(edges[:-1], edges[1:]):
            steps = np.diff(a[x:y], prepend=a[x : x + 1]).view(np.int64)
            out[0].append(int(side[x]))
            out[1].append(kind)
            out[2].append(a[x : x + 1].tobytes() + _shrunk(steps))
            out[3].append(b[x:y].tobytes() if kind == VALUES else _shrunk(b[x:y]))
            part = gaps[order[x:y]] if gaps is not None else None
            out[4].append(part.tobytes() if part is not None and (kind != VALUES or part.any()) else None)
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["side", "kind", "a", "b", "gaps"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size * max(1, batch.num_columns - 1) >= CHUNK:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(each, PACKED)


def _places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of every ``x`` in the sorted ``known``, -1 where it is not in it; 64 bits, as places are multiplied."""
    if not len(known) or not len(x):
        return np.full(len(x), -1, np.int64)
    span = int(known[-1]) - int(known[0]) + 1
    if span <= 8 * len(known) + (1 << 16):
        table = np.full(span, -1, np.int32)
        table[known - known[0]] = np.arange(len(known), dtype=np.int32)
        inside = (x >= known[0]) & (x <= known[-1])
        return np.where(inside, table[np.where(inside, x, known[0]) - known[0]], -1).astype(np.int64)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return np.where(known[at] == x, at, -1)


def _partition_keys(parts: int) -> list[int]:
    """A whole number for every one of ``parts`` hash partitions that Spark deals to it (Murmur3, seed 42)."""
    keys, i = {}, 0
    while len(keys) < parts:
        x = i * 0xCC9E2D51 & 0xFFFFFFFF
        x = ((x << 15 | x >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF ^ 42
        x = ((x << 13 | x >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF ^ 4
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            x = (x ^ x >> shift) * factor & 0xFFFFFFFF
        keys.setdefault((x - (x >> 31 << 32)) % parts, i)
        i += 1
    return [keys[p] for p in range(parts)]


def _dealt_to(rows: DataFrame, group: Column, parts: int) -> DataFrame:
    """Each of ``parts`` groups in a partition of its own."""
    spread = max(2, parts)
    return rows.withColumn("block", F.get(F.array(*map(F.lit, _partition_keys(spread))), group)).repartition(spread, "block")


def _once(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Each pair of partitions of the two as one partition with every row of both once, ``x_..`` and ``y_..``.

    A Cartesian product reads the partitions from the shuffle that holds them, however often. Of its pairs of rows only
    those with the first row of a partition go on: all of ``second`` with the first one of ``first``, then its others in their order.
    """
    numbered = lambda rows, name: rows.select(
        *[F.col(c).alias(f"{name}_{c}") for c in columns], F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(f"{name}_row")
    )
    pairs = numbered(first, "x").hint("shuffle_replicate_nl").join(numbered(second, "y"), (F.col("x_row") == 0) | (F.col("y_row") == 0))
    return pairs.select(*[
        F.when(F.col(f"{other}_row") == 0, F.col(f"{name}_{c}")).alias(f"{name}_{c}") for name, other in ("xy", "yx") for c in columns
    ])


def _crossed(first: DataFrame, second: DataFrame, parts: int) -> DataFrame:
    """Packed rows ``first``, dealt by ``parts * TURNS`` groups, and ``second``, dealt by ``parts``, block by block."""
    mine = _dealt_to(first, F.floor(F.col("side") / TURNS).cast("int"), parts)
    return _once(mine, _dealt_to(second, F.col("side"), parts), ["side", "kind", "a", "b", "gaps"])


def _taken(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, list[dict]], list[dict]]:
    """The rows of a block: first ones by their group, second ones."""
    mine, other = {}, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["x_kind"] is not None:
                mine.setdefault(row["x_side"], []).append({c: row[f"x_{c}"] for c in ("kind", "a", "b", "gaps")})
            if row["y_kind"] is not None:
                other.append({c: row[f"y_{c}"] for c in ("kind", "a", "b", "gaps")})
    return mine, other


def _both(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """``a`` and ``b`` of the steps of one kind."""
    rows, empty = [r for r in rows if r["kind"] == kind], np.empty(0, np.int64)
    a = [np.frombuffer(r["a"], np.int64, 1) + np.cumsum(_grown(r["a"][8:])) for r in rows]
    return np.concatenate([*a, empty]), np.concatenate([*[_grown(r["b"]) for r in rows], empty])


def _weights(rows: list[dict], kind: int, as_type=np.float64) -> np.ndarray:
    return np.concatenate([*[np.frombuffer(r["gaps"], np.float64) for r in rows if r["kind"] == kind], np.empty(0)]).astype(as_type)


class _Steps:
    """The steps of one block: second ones by v, and first ones by u, a group of u at a time."""

    weight = None  # type of the weights, if the steps have any

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.mine, self.other = _taken(batches)
        if not self.mine:
            return
        v, w = _both(self.other, SECOND)
        self.w = np.unique(w)
        to = _places(self.w, w).astype(np.int32)
        del w
        order = np.argsort(v, kind="stable")
        self.to = to[order]
        if self.weight:
            self.y = _weights(self.other, SECOND, self.weight)[order]
        self.v, start = np.unique(v[order], return_index=True)
        self.start = np.append(start, len(v))
        self.other = [r for r in self.other if r["kind"] == VALUES]

    def turns(self) -> Iterator[list[dict]]:
        """Sets the first steps of one group after the other, and gives the rows of the group."""
        while self.mine:
            rows = self.mine.pop(next(iter(self.mine)))
            u, v = _both(rows, FIRST)
            at = _places(self.v, v)
            known = at >= 0
            u, at = u[known], at[known]
            order = np.argsort(u, kind="stable")
            self.at = at[order]
            if self.weight:
                self.x = _weights(rows, FIRST, self.weight)[known][order]
            self.u, edge = np.unique(u[order], return_index=True)
            self.edge = np.append(edge, len(u))
            self.size = self.start[self.at + 1] - self.start[self.at]
            self.before = np.concatenate([[0], np.cumsum(self.size)])
            yield rows


class _Block(_Steps):
    """Distinct pairs of a block, and the values of their ends."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int):
        super().__init__(batches)
        if width and self.mine:
            self._take_values(width)
        self.other = []

    def turns(self) -> Iterator[None]:
        for rows in super().turns():
            a, b = _both(rows, WITHOUT)
            a, b = _places(self.u, a), _places(self.w, b)
            out = (a >= 0) & (b >= 0)
            self.without = np.unique(a[out] * len(self.w) + b[out])
            yield

    def _take_values(self, width: int) -> None:
        """Values of every w, summed where an id comes more than once; ``valid`` counts those not null."""
        self.values, self.has, self.valid = np.zeros((len(self.w), width)), np.zeros(len(self.w), bool), None
        if any(r["gaps"] for r in self.other):
            self.valid = np.zeros((len(self.w), width))
        for row in self.other:
            at = _places(self.w, np.frombuffer(row["a"], np.int64, 1) + np.cumsum(_grown(row["a"][8:])))
            known = at >= 0
            at, x = at[known], np.frombuffer(row["b"], np.float64).reshape(-1, width)[known]
            np.add.at(self.values, at, x)
            self.has[at] = True
            if self.valid is not None:
                gaps = np.frombuffer(row["gaps"], bool).reshape(-1, width)[known] if row["gaps"] else np.zeros(x.shape, bool)
                np.add.at(self.valid, at, ~gaps)

    def runs(self, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(i, key, paths)``: distinct pairs as sorted ``(u - i) * len(w) + w``, for runs of u of bounded paths."""
        totals, i, wide = self.before[self.edge], 0, len(self.w)
        while i < len(self.u):
            j = max(i + 1, int(np.searchsorted(totals, totals[i] + budget, "right")) - 1)
            if totals[j] - totals[i] > budget:
                key, paths = self._hot(i, budget)
            else:
                span = slice(self.edge[i], self.edge[j])
                u = np.repeat(np.arange(j - i), np.diff(totals[i : j + 1]))
                key = u * wide + self._ends(span)
                key.sort()
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                key, paths = key[new], np.diff(np.append(new, len(key)))
            out = self.without[slice(*np.searchsorted(self.without, [i * wide, j * wide]))] - i * wide
            if len(out) and len(key):
                at = np.searchsorted(key, out)
                at[at == len(key)] = 0
                keep = np.ones(len(key), bool)
                keep[at[key[at] == out]] = False
                key, paths = key[keep], paths[keep]
            yield i, key, paths
            i = j

    def _ends(self, span: slice) -> np.ndarray:
        size = self.size[span]
        begin = np.cumsum(size) - size
        return self.to[np.repeat(self.start[self.at[span]] - begin, size) + np.arange(size.sum())]

    def _hot(self, i: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """A single u with many paths: counted per w, a part of its steps at a time."""
        seen, lo, last = np.zeros(len(self.w), np.int64), int(self.edge[i]), int(self.edge[i + 1])
        while lo < last:
            hi = min(last, max(lo + 1, int(np.searchsorted(self.before, self.before[lo] + budget, "right")) - 1))
            seen += np.bincount(self._ends(slice(lo, hi)), minlength=len(self.w))
            lo = hi
        key = np.flatnonzero(seen)
        return key, seen[key]


class _WeightedBlock(_Steps):
    """Steps with weights; a pair gets the sum of products over its paths."""

    weight = np.float64

    def _paths(self, span: slice) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[span]
        at = np.repeat(self.start[self.at[span]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.to[at], np.repeat(self.x[span], size) * self.y[at]

    def sums(self, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(u, w, sum)`` for runs of u of bounded paths."""
        totals, i, wide = self.before[self.edge], 0, len(self.w)
        while i < len(self.u):
            j = max(i + 1, int(np.searchsorted(totals, totals[i] + budget, "right")) - 1)
            if totals[j] - totals[i] > budget:
                seen, total, lo, last = np.zeros(wide, bool), np.zeros(wide), int(self.edge[i]), int(self.edge[j])
                while lo < last:
                    hi = min(last, max(lo + 1, int(np.searchsorted(self.before, self.before[lo] + budget, "right")) - 1))
                    to, part = self._paths(slice(lo, hi))
                    seen[to] = True
                    total += np.bincount(to, part, wide)
                    lo = hi
                key = np.flatnonzero(seen)
                yield np.full(len(key), self.u[i]), self.w[key], total[key]
            elif totals[j] > totals[i]:
                to, part = self._paths(slice(self.edge[i], self.edge[j]))
                key = np.repeat(np.arange(j - i), np.diff(totals[i : j + 1])) * wide + to
                order = np.argsort(key, kind="stable")
                key = key[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                at, w = np.divmod(key[new], wide)
                yield self.u[i + at], self.w[w], np.add.reduceat(part[order], new)
            i = j


def _column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL)


def _blocks(first: DataFrame, second: DataFrame, without: DataFrame | None, values: DataFrame | None, parts: int | None) -> DataFrame:
    """Packed steps, without pairs and values, a partition for each block."""
    if parts is None:
        most = max(first.count(), second.count())
        parts = max(1 if most < 10_000 else 8, -(-most // EDGES_PER_TASK))
    mine = _packed(first.where("v is not null").select("u", "v"), FIRST, parts * TURNS)
    if without is not None:
        pairs = without.where("u is not null and w is not null").select("u", "w")
        mine = mine.unionByName(_packed(pairs, WITHOUT, parts * TURNS))
    other = _packed(second.where("v is not null").select("v", "w"), SECOND, parts)
    if values is not None:
        other = other.unionByName(_packed(values, VALUES, parts))
    return _crossed(mine, other, parts)


WEIGHTED_PER_TASK = 16_000_000  # weighted steps of one kind in a block


def path_masses(first: DataFrame, second: DataFrame, factor: float, least: float, parts: int | None = None) -> DataFrame:
    """``(u, w, mass)``: ``factor`` times the sum of ``x * y`` over ``first(u, v, x)`` and ``second(v, w, y)``, where it
    is at least ``least``. Steps may repeat; a pair meets in one block, so it is added up and cut there."""
    if not _whole_ids(first.select("u", "v"), second.select("v", "w")):
        moved = first.join(second, "v").groupBy("u", "w").agg((factor * F.sum(F.col("x") * F.col("y"))).alias("mass"))
        return moved.where(F.col("mass") >= least)
    if parts is None:
        most = max(first.count(), second.count())
        parts = 1 if most < 10_000 else max(4, -(-most // WEIGHTED_PER_TASK))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _WeightedBlock(batches)
        for _ in block.turns():
            for u, w, mass in block.sums(CHUNK):
                mass = factor * mass
                keep = mass >= least
                if keep.any():
                    yield pa.record_batch([_column(u[keep]), _column(w[keep]), pa.array(mass[keep])], names=["u", "w", "mass"])

    kinds = [first.schema["u"].dataType, second.schema["w"].dataType]
    mine = _packed(first.where("v is not null").select("u", "v", "x"), FIRST, parts * TURNS)
    other = _packed(second.where("v is not null").select("v", "w", "y"), SECOND, parts)
    found = _crossed(mine, other, parts).mapInArrow(each, "u bigint, w bigint, mass double")
    return found.withColumns({c: F.col(c).cast(kind) for c, kind in zip("uw", kinds)})


TRIANGLES = ("a", "b", "c", "ab", "bc", "ac")


class _TriangleBlock(_Steps):
    """The steps ``a -> b`` and ``b -> c`` of one block, and the pairs ``a -> c`` that close them, each with a number."""

    weight = np.int8

    def turns(self) -> Iterator[None]:
        for rows in super().turns():
            a, c = _both(rows, FIRST)  # a pair that closes is itself a first step
            a, c = _places(self.u, a), _places(self.w, c)
            known = (a >= 0) & (c >= 0)
            a, c = a[known], c[known]
            order = np.lexsort((c, a))
            self.pair, self.z = (a * len(self.w) + c)[order], _weights(rows, FIRST, np.int8)[known][order]
            yield

    def found(self, budget: int) -> Iterator[list[np.ndarray]]:
        """The triangles, those of a bounded number of paths at a time."""
        lo, wide = 0, len(self.w)
        owner = np.repeat(np.arange(len(self.u)), np.diff(self.edge))
        while lo < len(self.at):
            hi = max(lo + 1, int(np.searchsorted(self.before, self.before[lo] + budget, "right")) - 1)
            size = self.size[lo:hi]
            step = np.repeat(np.arange(lo, hi), size)
            second = np.repeat(self.start[self.at[lo:hi]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            begin, end = np.searchsorted(self.pair, [owner[lo] * wide, (owner[hi - 1] + 1) * wide])
            pairs = self.pair[begin:end]
            if len(pairs) and len(step):
                key = owner[step] * wide + self.to[second]
                place = np.searchsorted(pairs, key)
                place[place == len(pairs)] = 0
                hit = np.flatnonzero(pairs[place] == key)
                step, second, place = step[hit], second[hit], place[hit]
                if len(hit):
                    yield [
                        self.u[owner[step]], self.v[self.at[step]], self.w[self.to[second]],
                        self.x[step], self.y[second], self.z[begin + place],
                    ]
            lo = hi


def block_triangles(steps: DataFrame, parts: int | None = None) -> DataFrame:
    """``(a, b, c, ab, bc, ac)``: every ``a -> b -> c`` of ``steps(u, v, x)`` that has ``a -> c``, with the three small numbers ``x``.

    Steps are distinct and none is null. No path is shuffled: a block holds the steps from its a, those to its c, and its own pairs.
    """
    names = list(TRIANGLES)
    if not _whole_ids(steps.select("u"), steps.select("v")):
        first, second, third = (steps.toDF(p, q, p + q) for p, q in ("ab", "bc", "ac"))
        return first.join(second, "b").join(third, ["a", "c"]).select(*names)
    if parts is None:
        most = steps.count()
        parts = 1 if most < 10_000 else max(4, -(-most // WEIGHTED_PER_TASK))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _TriangleBlock(batches)
        for _ in block.turns():
            for a, b, c, *x in block.found(CHUNK):
                yield pa.record_batch([*map(pa.array, (a, b, c)), *[pa.array(part, pa.int8()) for part in x]], names=names)

    rows = steps.select("u", "v", F.col("x").cast("double"))
    found = _crossed(_packed(rows, FIRST, parts * TURNS), _packed(rows, SECOND, parts), parts).mapInArrow(
        each, "a bigint, b bigint, c bigint, ab tinyint, bc tinyint, ac tinyint"
    )
    kind = steps.schema["u"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in "abc"})


def _whole_ids(first: DataFrame, second: DataFrame) -> bool:
    return all(isinstance(f.dataType, IntegralType) for df in (first, second) for f in df.schema.fields)


def block_pairs(
    first: DataFrame, second: DataFrame, without: DataFrame | None = None, paths: str | None = None, parts: int | None = None
) -> DataFrame:
    """Distinct ``(u, w)`` over ``first(u, v)`` and ``second(v, w)``, which must be distinct pairs, without
    those in ``without(u, w)``; ``paths`` names a column with the number of v between them."""
    if not _whole_ids(first, second):
        pairs = first.join(second, "v").groupBy("u", "w").agg(F.count(F.lit(1)).alias(paths or "_n"))
        pairs = pairs if without is None else pairs.join(without, ["u", "w"], "left_anti")
        return pairs if paths else pairs.select("u", "w")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(batches, 0)
        for _ in block.turns():
            for i, key, n in block.runs(CHUNK):
                if len(key):
                    at, w = np.divmod(key, len(block.w))
                    columns = [_column(block.u[i + at]), _column(block.w[w])] + ([pa.array(n, pa.int64())] if paths else [])
                    yield pa.record_batch(columns, names=["u", "w", *([paths] if paths else [])])

    kinds = [first.schema["u"].dataType, second.schema["w"].dataType]
    found = _blocks(first, second, without, None, parts).mapInArrow(
        each, "u bigint, w bigint" + (f", {paths} bigint" if paths else "")
    )
    return found.withColumns({c: F.col(c).cast(kind) for c, kind in zip("uw", kinds)})


def block_sums(
    first: DataFrame, second: DataFrame, values: DataFrame | None, names: list[str], without: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``(u, names..)``: sums of ``values(w, ..)`` over the pairs of ``block_pairs``; ``values=None`` counts them as ``n``."""
    if not _whole_ids(first, second):
        pairs = block_pairs(first, second, without)
        if values is None:
            return pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        return pairs.join(values, "w").groupBy("u").agg(*[F.sum(c).alias(c) for c in names])
    width = 0 if values is None else len(names)
    names = ["n"] if values is None else names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(batches, width)
        for i, key, _ in (run for _ in block.turns() for run in block.runs(CHUNK // (1 + width // 4))):
            at, w = np.divmod(key, max(1, len(block.w)))
            if width:
                at, w = at[block.has[w]], w[block.has[w]]
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            if not width:
                columns = [pa.array(np.diff(np.append(new, len(at))).astype(np.float64))]
            else:
                sums = np.add.reduceat(block.values[w], new, axis=0)
                empty = np.add.reduceat(block.valid[w], new, axis=0) == 0 if block.valid is not None else np.zeros(sums.shape, bool)
                columns = [pa.array(sums[:, c], mask=empty[:, c]) for c in range(width)]
            yield pa.record_batch([_column(block.u[i + at[new]]), *columns], names=["u", *[f"x{c}" for c in range(len(names))]])

    if values is not None:
        whole = [isinstance(values.schema[c].dataType, IntegralType) for c in names]
        values = values.where("w is not null").select(F.col("w").cast("bigint"), *[F.col(c).cast("double").alias(c) for c in names])
    else:
        whole = [True]
    found = _blocks(first, second, without, values, parts).mapInArrow(
        each, "u bigint, " + ", ".join(f"x{c} double" for c in range(len(names)))
    )
    sums = found.groupBy("u").agg(*[
        F.sum(f"x{c}").cast("bigint" if whole[c] else "double").alias(name) for c, name in enumerate(names)
    ])
    return sums.withColumn("u", F.col("u").cast(first.schema["u"].dataType))
