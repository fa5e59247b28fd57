"""Weighted sums over links, block by block.

Links are packed once: nodes are dealt into groups by a hash, and each cell (group of the node, group of the
neighbour) holds its links as a few large rows. A product sends every group of signals to the blocks that read it
and gets one partial sum per node and block back, so a link is never joined to a row of signals in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, IntegralType

from ringsight.operators.blocks import NULL, VALUES, _column, _groups, _grown, _ids, _packed, _shrunk
from ringsight.session import cut_lineage

FINE = 16  # groups of nodes on each side of the packed cells
PACK = 1 << 22  # links packed at a time
LINKS_PER_TASK = 24_000_000
SMALL = 10_000


@dataclass(frozen=True)
class Links:
    """Packed ``(node, nbr, weight)``: rows by cell, and the number of groups a product deals each side into."""

    rows: DataFrame
    parts: int
    kind: DataType

    def held(self) -> "Links":
        """The rows in the partitions of their blocks on local disks, for many products; ``drop`` ends that."""
        spread = self.parts * self.parts
        rows = self.blocks().repartition(1 if spread == 1 else 4 * spread, "block").persist(StorageLevel.DISK_ONLY)
        return Links(rows, self.parts, self.kind)

    def drop(self) -> None:
        self.rows.unpersist()

    def blocks(self) -> DataFrame:
        if "block" in self.rows.columns:
            return self.rows
        coarse = lambda c: F.col(c) % self.parts  # noqa: E731  (parts divides FINE)
        return self.rows.select((coarse("mine") * self.parts + coarse("other")).alias("block"), "a", "b", "weight")


def pack_links(links: DataFrame, parts: int | None = None) -> Links | DataFrame:
    """Links written once in packed form; ids that are not whole numbers stay plain rows."""
    if not all(isinstance(links.schema[c].dataType, IntegralType) for c in ("node", "nbr")):
        return cut_lineage(links)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        a, b = (_ids(table.column(c).combine_chunks()) for c in (0, 1))
        weight = table.column(2).combine_chunks().to_numpy(zero_copy_only=False)
        cell = _groups(a, FINE) * FINE + _groups(b, FINE)
        order = np.lexsort((a, cell))
        cell, a, b, weight = cell[order], a[order], b[order], weight[order]
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        out = [[], [], [], [], [], []]
        for x, y in zip(edges[:-1], edges[1:]):
            w = weight[x:y]
            one = bool((w == w[0]).all())
            parts_of = (
                int(cell[x]) // FINE, int(cell[x]) % FINE, int(y - x),
                a[x : x + 1].tobytes() + _shrunk(np.diff(a[x:y], prepend=a[x : x + 1])), _shrunk(b[x:y]),
                (w[:1] if one else w).tobytes(),
            )
            for column, value in zip(out, parts_of):
                column.append(value)
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(out, types)], names=["mine", "other", "n", "a", "b", "weight"]
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size >= PACK:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    plain = links.where("nbr is not null and weight is not null").select(
        F.col("node").cast("bigint"), F.col("nbr").cast("bigint"), F.col("weight").cast("double")
    )
    rows = cut_lineage(plain.mapInArrow(each, "mine int, other int, n bigint, a binary, b binary, weight binary"))
    if parts is None:
        most = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        parts = 1 if most < SMALL else 4
        while parts < FINE and most > LINKS_PER_TASK * parts * parts:
            parts *= 2
    return Links(rows, parts, links.schema["node"].dataType)


class _Known:
    """Places of ids in a sorted array of distinct ones, -1 for others."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.table = ids, None
        if len(ids) and int(ids[-1]) - int(ids[0]) < 8 * len(ids) + (1 << 16):
            self.table = np.full(int(ids[-1]) - int(ids[0]) + 1, -1, np.int32)
            self.table[ids - ids[0]] = np.arange(len(ids), dtype=np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(x), -1, np.int64)
        if self.table is not None:
            inside = (x >= self.ids[0]) & (x <= self.ids[-1])
            return np.where(inside, self.table[np.where(inside, x, self.ids[0]) - self.ids[0]], -1)
        at = np.searchsorted(self.ids, x)
        at[at == len(self.ids)] = 0
        return np.where(self.ids[at] == x, at, -1)


def _steps(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64, 1) + np.cumsum(_grown(data[8:]))


def _signals(rows: list[dict], width: int) -> tuple[_Known, np.ndarray, np.ndarray | None]:
    """Ids, their values summed over rows of one id, and the number of values that are not null."""
    ids = [_steps(r["a"]) for r in rows]
    known = _Known(np.unique(np.concatenate([*ids, np.empty(0, np.int64)])))
    x = np.zeros((len(known.ids), width))
    valid = np.zeros((len(known.ids), width), np.int32) if any(r["gaps"] for r in rows) else None
    for a, row in zip(ids, rows):
        at = known(a)
        np.add.at(x, at, np.frombuffer(row["b"], np.float64).reshape(-1, width))
        if valid is not None:
            gaps = np.frombuffer(row["gaps"], bool).reshape(-1, width) if row["gaps"] else np.zeros((len(a), width), bool)
            np.add.at(valid, at, (~gaps).astype(np.int32))
    return known, x, valid


def _links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in table.select(["a", "b", "weight"]).to_batches(max_chunksize=1):
        row = batch.to_pylist()[0]
        a, w = _steps(row["a"]), np.frombuffer(row["weight"], np.float64)
        yield a, _grown(row["b"]), w if len(w) == len(a) else np.full(len(a), w[0])


def _per_node(links: pa.Table, width: int, terms) -> pa.Table:
    """Add up ``terms(a, b, weight)``, which gives the rows it uses, their values and counts, per node ``a``."""
    heads = [np.unique(_steps(a.as_py())) for a in links.column("a")]
    nodes = _Known(np.unique(np.concatenate([*heads, np.empty(0, np.int64)])))
    del heads
    sums, counts, seen = np.zeros((len(nodes.ids), width)), None, np.zeros(len(nodes.ids), bool)
    for a, b, weight in _links(links):
        keep, x, valid = terms(a, b, weight)
        a = a[keep]
        if not len(a):
            continue
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        at = nodes(a[new])
        sums[at] += np.add.reduceat(x, new, axis=0)
        seen[at] = True
        if valid is not None:
            if counts is None:
                counts = np.zeros((len(nodes.ids), width), np.int64)
            counts[at] += np.add.reduceat(valid, new, axis=0)
    empty = counts[seen] == 0 if counts is not None else np.zeros((int(seen.sum()), width), bool)
    sums = sums[seen]
    return pa.table(
        [_column(nodes.ids[seen]), *[pa.array(sums[:, c], mask=empty[:, c]) for c in range(width)]],
        names=["node", *[f"x{c}" for c in range(width)]],
    )


def _dealt(signals: DataFrame, columns: list[str], parts: int, own: bool = False) -> DataFrame:
    """Signals packed by group and sent to the blocks that have the group as neighbours, with ``own`` as nodes too."""
    values = signals.where("node_id is not null").select(
        F.col("node_id").cast("bigint").alias("a"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    )
    packed = _packed(values, VALUES, parts).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    block = lambda mine: (F.col("side") * parts + F.col("other") if mine else F.col("other") * parts + F.col("side")).cast("int")
    rows = packed.select(block(False).alias("block"), F.lit(False).alias("own"), "a", "b", "gaps")
    return rows.unionByName(packed.select(block(True).alias("block"), F.lit(True).alias("own"), "a", "b", "gaps")) if own else rows


def _totals(links: Links, values: DataFrame, each, names: list[str]) -> DataFrame:
    found = links.blocks().groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        each, "node bigint, " + ", ".join(f"x{c} double" for c in range(len(names)))
    )
    return found.groupBy(F.col("node").cast(links.kind).alias("node_id")).agg(
        *[F.sum(f"x{c}").alias(name) for c, name in enumerate(names)]
    )


def link_sums(links: Links, signals: DataFrame, columns: list[str]) -> DataFrame:
    """``(node_id, columns..)``: weighted sums over the neighbours that have signals; nulls are left out."""
    width = len(columns)

    def each(links: pa.Table, values: pa.Table) -> pa.Table:
        known, x, valid = _signals(values.select(["a", "b", "gaps"]).to_pylist(), width)

        def terms(a, b, weight):
            at = known(b)
            keep = at >= 0
            at = at[keep]
            return keep, weight[keep, None] * x[at], None if valid is None else valid[at]

        return _per_node(links, width, terms)

    return _totals(links, _dealt(signals, columns, links.parts), each, columns)


def link_differences(links: Links, signals: DataFrame, column: str) -> DataFrame:
    """``(node_id, apart, n)``: sum of the absolute differences to the neighbours, and their number.

    Both ends need a row with a value; ids come once.
    """
    def each(links: pa.Table, values: pa.Table) -> pa.Table:
        rows = values.select(["own", "a", "b", "gaps"]).to_pylist()
        mine, x, _ = _signals([r for r in rows if r["own"]], 1)
        known, y, _ = _signals([r for r in rows if not r["own"]], 1)

        def terms(a, b, weight):
            i, j = mine(a), known(b)
            keep = (i >= 0) & (j >= 0)
            apart = np.abs(x[i[keep]] - y[j[keep]])
            return keep, np.column_stack([apart, np.ones(len(apart))]), None

        return _per_node(links, 2, terms)

    return _totals(links, _dealt(signals.where(F.col(column).isNotNull()), [column], links.parts, True), each, ["apart", "n"])
