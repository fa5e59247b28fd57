"""Unions over two hops, exact, without shuffling their pairs and without expanding hubs once per predecessor.

A hub (more than ``threshold`` second-hop partners) is shared by many first-hop nodes. The set
of hubs a node touches is its signature; what a signature reaches is expanded once and reused
by every node with that signature. Only the lists of ordinary nodes are expanded per node, in
blocks (``operators/blocks.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ringsight.operators.blocks import block_pairs, block_sums
from ringsight.session import cut_lineage

HUB_THRESHOLD = 5000


@dataclass(frozen=True)
class TwoHop:
    """Distinct (u, w) reached over two hops, in two disjoint parts.

    ``light(u, w)``: reached only through ordinary nodes, the steps ``first(u, v)`` and ``second(v, w)``;
    ``signature(u, sig)`` and ``reach(sig, w)``: reached through the hubs of u. Without hubs the
    last two are None.
    """

    first: DataFrame
    second: DataFrame
    signature: DataFrame | None
    reach: DataFrame | None

    def light(self, without: DataFrame | None = None) -> DataFrame:
        """The first part, without the pairs in ``without(u, w)``."""
        pairs = block_pairs(self.first, self.second, without)
        if self.signature is None:
            return pairs
        return pairs.join(self.signature, "u", "left").join(self.reach, ["sig", "w"], "left_anti").select("u", "w")

    def pairs(self, without: DataFrame | None = None) -> DataFrame:
        """All pairs written out; only for operators whose result is the pair list."""
        light = self.light(without)
        if self.signature is None:
            return light
        through = self.signature.join(self.reach, "sig").select("u", "w")
        return light.unionByName(through if without is None else through.join(without, ["u", "w"], "left_anti"))


def two_hop(first: DataFrame, second: DataFrame, threshold: int = HUB_THRESHOLD) -> TwoHop:
    """``first(u, v)`` and ``second(v, w)`` must be distinct pairs."""
    first, second = cut_lineage(first.select("u", "v")), cut_lineage(second.select("v", "w"))
    hub = cut_lineage(second.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > threshold).select("v"))
    hubs = first.join(hub, "v", "left_semi").select("u", "v")
    if hubs.isEmpty():
        return TwoHop(first, second, None, None)
    # The signature names the set of hubs by its size and two 64-bit xors of hashes, so that no
    # list is built however many hubs a node touches. Written once: the parts below read it
    # several times.
    signature = cut_lineage(hubs.groupBy("u").agg(F.concat_ws(
        "-", F.count(F.lit(1)).cast("string"), F.bit_xor(F.xxhash64("v")).cast("string"),
        F.bit_xor(F.xxhash64("v", F.lit(1))).cast("string"),
    ).alias("sig")))
    # One node per signature stands for its hub set.
    leader = signature.groupBy("sig").agg(F.min("u").alias("u"))
    reach = cut_lineage(
        leader.join(hubs, "u").select("sig", "v").join(second, "v").select("sig", "w").distinct()
    )
    plain = lambda rows: rows.join(hub, "v", "left_anti")
    return TwoHop(plain(first).select("u", "v"), plain(second).select("v", "w"), signature, reach)


def _light_sums(hop: TwoHop, values: DataFrame | None, names: list[str], without: DataFrame | None = None) -> DataFrame:
    if hop.signature is None:
        return block_sums(hop.first, hop.second, values, names, without)
    return _add(hop.light(without), "u", values, names)


def _add(rows: DataFrame, key: str, values: DataFrame | None, names: list[str]) -> DataFrame:
    if values is None:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(values, "w").groupBy(key).agg(*[F.sum(c).alias(c) for c in names])


def union_sums(hop: TwoHop, values: DataFrame | None, names: list[str], without: DataFrame | None = None) -> DataFrame:
    """Sum ``names`` of ``values(w, ..)`` over each u's union; ``values=None`` counts as ``n``.

    ``without(u, w)``: pairs left out of the part reached through ordinary nodes.
    """
    light = _light_sums(hop, values, names, without)
    if hop.signature is None:
        return light
    through_hubs = hop.signature.join(_add(hop.reach, "sig", values, names), "sig").drop("sig")
    return light.unionByName(through_hubs).groupBy("u").agg(*[F.sum(c).alias(c) for c in names])


def exclusive_sums(
    hop: TwoHop, near: DataFrame, values: DataFrame, names: list[str]
) -> DataFrame:
    """Like ``union_sums`` without the pairs in ``near(u, w)`` (one hop and the node itself)."""
    full = union_sums(hop, values, names, near)
    if hop.signature is None:
        return full
    overlap = (
        near.join(hop.signature, "u").join(hop.reach, ["sig", "w"], "left_semi")
        .join(values, "w").groupBy("u").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    )
    return full.join(overlap, "u", "left").select(
        "u", *[(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in names]
    )
