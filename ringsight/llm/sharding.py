"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number from a hash of its own number and the record's key; the record goes to
the shard with the least -ln(u) / weight. A shard's draws don't depend on the other shards, so a
new shard only takes the records that it wins, and a removed one gives up only its own. Nothing
but the key and the weights decides: no table of places is kept, and no row is moved to choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.ordered import with_position
from ringsight.llm.common import free_name, stored, whole_text

SHARDS = 16
BITS = 52  # of a draw: 13 hexadecimal digits of the md5
FILE_ROWS = 1_000_000


def _cost(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, BITS // 4)
    # Half a step off both ends, so that the logarithm is finite and below 0.
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << BITS)
    return -F.log(u) / float(weight)


def _best(key: Column, weights: list[float]) -> Column:
    """``struct<cost, shard>`` of the winner. A null key counts as the text ``null``."""
    if not weights or min(weights) < 0 or not max(weights) > 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    costs = [F.struct(_cost(text, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins ``key`` (ties: the smaller number); shards of weight 0 win nothing."""
    return _best(key, weights)["shard"]


def assign_shards(docs: DataFrame, weights: list[float] | None = None, more: float = 1.0, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``shard`` is where the key belongs under ``weights`` (default: SHARDS equal ones), ``grown_shard``
    where it belongs once a shard of weight ``more`` is added: the same or the new one. ``slot``
    numbers the rows of a shard from 0 without gaps, by key, size and checksum; repeated rows take
    slots one after another. A null text has no bytes, so size 1 and the checksum of the empty
    one. Rows with one key, null ones too, share a shard by the law, but not a task: slots come
    from ranges of (shard, key, row). Other columns are ignored.
    """
    weights = [1.0] * SHARDS if weights is None else [float(w) for w in weights]
    body = whole_text().cast("binary")
    rows = docs.select(
        docs[key].alias("doc_id"), (F.length(body) + 1).cast("bigint").alias("size"), F.crc32(body).cast("bigint").alias("text_crc32"),
    )
    grown = _cost(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), len(weights), more)
    drawn = rows.withColumn("_best", _best(F.col("doc_id"), weights)).select(
        *rows.columns, F.col("_best.shard").alias("shard"),
        F.when(grown < F.col("_best.cost"), len(weights)).otherwise(F.col("_best.shard")).alias("grown_shard"),
        # Parts rows that are equal in all else, so that ranges can cut a hot key.
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = with_position(stored(drawn), ["shard"], ["doc_id", "size", "text_crc32", "_row"], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: list[float] | None = None, key: str = "doc_id", parts: int = 1) -> None:
    """Write ``docs`` below ``path`` in one folder per shard, each dealt over ``parts`` tasks and files of FILE_ROWS rows at most.

    The folder column has underscores in front where ``docs`` has a column ``shard``.
    """
    weights = [1.0] * SHARDS if weights is None else [float(w) for w in weights]
    name, deal = free_name(docs, "shard"), free_name(docs, "_deal")
    placed = docs.withColumn(name, shard_of(F.col(key), weights)).withColumn(deal, F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    dealt = placed.repartition(len(weights) * parts, name, deal).drop(deal)
    dealt.write.partitionBy(name).option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def crc32_sql(blob: str, table: str) -> str:
    """DuckDB expression for the CRC-32 of a BLOB expression; ``table`` names the 256 remainders."""
    values = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {values}),"
        f" lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"
    )


CRC_TABLE = (
    "SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],"
    " lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END)) AS c FROM range(256) AS r(b))"
)


def shards_sql(shards: int = SHARDS) -> str:
    """The same rows for equal weights."""
    return f"""WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
bytes AS (SELECT r, doc_id, octet_length(t) + 1 AS size, {crc32_sql("t", "tab")} AS text_crc32 FROM d, crc),
draws AS (SELECT r, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) AS cost
          FROM d, range({shards + 1}) AS g(s)),
won AS (SELECT r, arg_min(s, (cost, s)) FILTER (WHERE s < {shards}) AS shard, arg_min(s, (cost, s)) AS grown_shard FROM draws GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32, r) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM bytes JOIN won USING (r)"""
