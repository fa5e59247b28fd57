"""Prefix trie of conversations by van Emde Boas recursion over depths.

All sequences are cut at half of the (padded) depth: the first half is one piece, what follows is
another piece below a node named after the first. Both halves are cut again in the same way, all
pieces of all conversations at once, until a piece is one turn long. A piece of 2**k turns is named
by a hash of its two halves, so a node's name takes one step per level, not one per turn. Totals
come back the same way: every piece has the totals inside it, and at each level the total of a
cut node (a lower piece's top) is grafted on its ancestors in the upper piece, so a trie of
depth d needs log2(d) rounds.

Rows are turns, never whole conversations: one conversation may hold any share of the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.ordered import with_position
from ringsight.llm.common import WORD, stored
from ringsight.llm.sharding import CRC_TABLE, crc32_sql

GROUP = 20  # conversations that take their first turns from the first of them
HEADS = 4  # first turns taken: a checksum modulo this
CHUNK = 1 << 16  # characters of ids joined at once
ROOT = "root"


def _hash(*parts: Column) -> Column:
    """16 bytes of a sha256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_hash, words)``: the turns without their texts, numbered from 0 in order of turn."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), text.alias("text"),
    ).where("conv_id is not null")
    named = rows.select(
        "conv_id", "turn", _hash(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary")).alias("turn_hash"),
        F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("bigint").alias("words"),
        # Parts equal turns.
        F.monotonically_increasing_id().alias("_row"),
    )
    return with_position(stored(named), ["conv_id"], ["turn", "turn_hash", "_row"], "pos").select("conv_id", "pos", "turn_hash", "words")


def heads_of(conv_id: Column, heads: int = HEADS) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % heads).cast("bigint")


def rebuilt_turns(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, turn_hash, words)`` of the rebuilt conversations, and ``(conv_id, turns)``, turnless ones too.

    Conversation c gets the first h turns of conversation c - c % group, then its own after its first h.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % group
    # At most heads - 1 turns of every first conversation, each for less than 2 * group others.
    first = turns.where((F.col("pos") < heads - 1) & (base == F.col("conv_id"))).select(
        F.col("conv_id").alias("base"), F.struct("pos", "turn_hash", "words").alias("t")
    ).groupBy("base").agg(F.sort_array(F.collect_list("t")).alias("first"))
    plan = lengths.withColumns({"base": base, "h": heads_of(F.col("conv_id"), heads)}).join(first, "base", "left").withColumn(
        "first", F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,turn_hash:binary,words:bigint>>")), F.lit(1), F.col("h").cast("int"))
    ).select("conv_id", "own", "h", F.size("first").cast("bigint").alias("taken"), "first")
    plan = stored(plan)
    taken = plan.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.pos", "t.turn_hash", "t.words")
    own = turns.where(F.col("pos") >= heads_of(F.col("conv_id"), heads)).join(plan.select("conv_id", "h", "taken"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_hash", "words"
    )
    counts = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    return taken.unionByName(own), counts


def named_prefixes(turns: DataFrame, counts: DataFrame) -> tuple[DataFrame, int]:
    """``(conv_id, depth, node, words)``: the node of every prefix of every conversation, and the padded depth.

    The last turn of the prefix is the one counted in ``words``; a row at the end of each
    conversation stands for its whole length.
    """
    deepest = counts.agg(F.max("turns").alias("d")).first().d or 0
    size = 1
    while size < deepest + 1:
        size *= 2
    blocks, length = {1: stored(turns.select("conv_id", F.col("pos").alias("block"), F.col("turn_hash").alias("name")))}, 1
    while 2 * length < size:
        whole = blocks[length].groupBy("conv_id", F.floor(F.col("block") / 2).cast("bigint").alias("pair")).agg(
            F.min(F.when(F.col("block") % 2 == 0, F.col("name"))).alias("a"), F.min(F.when(F.col("block") % 2 == 1, F.col("name"))).alias("b")
        ).where("a is not null and b is not null")
        length *= 2
        blocks[length] = stored(whole.select("conv_id", F.col("pair").alias("block"), _hash(F.col("a"), F.col("b")).alias("name")))
    state = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words").unionByName(
        counts.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"))
    ).withColumn("node", _hash(F.lit(ROOT).cast("binary")))
    half = size // 2
    while half >= 1:
        # The second halves of all pieces of 2 * half turns go below the node named after the first half.
        upper = blocks[half].where(F.col("block") % 2 == 0).select("conv_id", (F.col("block") + 1).alias("part"), "name")
        cut = state.withColumn("part", F.floor(F.col("depth") / half).cast("bigint")).join(upper, ["conv_id", "part"], "left")
        state = stored(cut.select("conv_id", "depth", "words", F.when(F.col("name").isNotNull(), _hash(F.col("node"), F.col("name"))).otherwise(F.col("node")).alias("node")))
        half //= 2
    return state, size


def grafted_totals(nodes: DataFrame, paths: DataFrame, size: int, sums: list[str]) -> DataFrame:
    """``(node, sums..)`` over whole subtrees. ``nodes(node, conv_id, depth, sums..)``; ``paths(conv_id, depth, node)`` has their ancestors."""
    totals = nodes.select("node", "conv_id", "depth", *sums)
    half = 1
    while half < size:
        cut = totals.where(F.floor(F.col("depth") / half) % 2 == 1).where(F.col("depth") % half == 0)
        above = paths.select("conv_id", F.floor(F.col("depth") / half).cast("bigint").alias("part"), F.col("node").alias("up"))
        grafts = cut.withColumn("part", (F.col("depth") / half).cast("bigint") - 1).join(above, ["conv_id", "part"]).select(
            F.col("up").alias("node"), F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("depth"), *sums
        )
        totals = stored(
            totals.unionByName(grafts).groupBy("node").agg(
                F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(s).alias(s) for s in sums]
            )
        )
        half *= 2
    return totals.select("node", *sums)


def id_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of ``ends(node, conv_id)``: sha256 of the ids in order, comma-joined.

    A digest can't be put together from parts, so a node's ids meet in one task at last, but as
    joined text in chunks that pass by one at a time; they are sorted and joined in ranges.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, length, out = None, 0, [], 0, []

        def made() -> pa.RecordBatch:
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))]
            out.clear()
            return pa.record_batch(columns, names=["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (n != node or length > CHUNK):
                    out.append((node, first, ",".join(ids)))
                    ids, length = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                length += len(ids[-1]) + 1
            yield made()
        if ids:
            out.append((node, first, ",".join(ids)))
            yield made()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            names, digests = [], []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if n == node:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        names.append(node)
                        digests.append(state.hexdigest())
                    node, state = n, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    chunks = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        joined, "node binary, first bigint, ids string"
    )
    return chunks.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(
        digested, "node binary, ends_sha256 string"
    )


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are rebuilt first (``rebuilt_turns``). A null role or text counts as empty; a
    null turn comes first; equal turn numbers are ordered by a hash of role and text, and repeated
    rows are turns of their own. Rows with a null conv_id belong to no conversation and are left
    out. A conversation rebuilt without turns is a member of the root. An empty table has no
    nodes. Texts of any length are hashed and counted in place and not moved. Other columns are ignored.
    """
    turns, counts = rebuilt_turns(stored(ordered_turns(conversations)), group, heads)
    turns, counts = stored(turns), stored(counts)
    paths, size = named_prefixes(turns, counts)
    nodes = stored(
        paths.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs")
        )
    )
    # The parent is the node before on the path of the smallest member.
    before = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    parents = stored(nodes.join(before, ["conv_id", "depth"], "left").select("node", "parent"))
    children = parents.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    own = stored(
        nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").select(
            *nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
    )
    totals = grafted_totals(own, paths, size, ["n_leaves", "saved_tokens"])
    ends = paths.join(counts.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"]).select("node", "conv_id")
    above = parents.where("parent is not null").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    whole = own.drop("n_leaves", "saved_tokens").join(totals, "node").join(above.select("node", "parent_conv_id"), "node", "left").join(
        id_digests(ends), "node", "left"
    )
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie_sql(group: int = GROUP, heads: int = HEADS) -> str:
    """The same nodes from whole prefix lists; equal turn numbers are ordered by the same hash."""
    return f"""WITH crc AS MATERIALIZED ({CRC_TABLE}),
t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
        substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS own
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {crc32_sql("encode(conv_id::VARCHAR)", "tab")} % {heads} AS h FROM t, crc),
b AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(f.own, [])[1:h.h], h.own[h.h + 1:]) AS s FROM h LEFT JOIN t AS f ON f.conv_id = h.conv_id - h.conv_id % {group}),
p AS MATERIALIZED (SELECT conv_id, d, s[1:d] AS s, len(s) AS n FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b)),
g AS MATERIALIZED (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs,
      CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(s[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY s, d),
u AS MATERIALIZED (SELECT g.conv_id AS m, g.d AS md, min(a.conv_id) AS parent FROM g LEFT JOIN g AS a ON g.d > 0 AND a.d = g.d - 1 AND a.s = g.s[1:g.d - 1] GROUP BY g.conv_id, g.d),
k AS (SELECT parent, md - 1 AS d, count(*) AS n_children FROM u WHERE md > 0 GROUP BY parent, md),
w AS MATERIALIZED (SELECT g.*, u.parent, coalesce(k.n_children, 0) AS n_children FROM g JOIN u ON u.m = g.conv_id AND u.md = g.d LEFT JOIN k ON k.parent = g.conv_id AND k.d = g.d),
up AS (SELECT a.conv_id, a.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(x.saved) AS saved_tokens
       FROM (SELECT *, unnest(range(d + 1)) AS ad FROM w) AS x JOIN w AS a ON a.d = x.ad AND a.s = x.s[1:x.ad] GROUP BY a.conv_id, a.d)
SELECT w.conv_id, w.d::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN up ON up.conv_id = w.conv_id AND up.d = w.d"""
