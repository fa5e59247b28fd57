"""Mixing sources to target weights, in DataFrame functions only.

A source with token share p gets a weight in proportion to p**a. The exponent a is bisected: the
largest one with at least the target entropy, raised again where a source would be repeated more
often than the limit. The weights are realised over a token budget: each source is cut into
blocks of about equal size, every epoch is a permutation of its blocks (and of the documents in
a block), and the source's stream of epochs is read until its share of the budget is used.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.functions.ordered import running_sums
from ringsight.llm.common import WORD, columns_of, stored

ENTROPY = 0.97  # of the largest possible entropy, log(number of sources)
REPEATS = 4.0  # a source's tokens are read this many times at most
BLOCK_TOKENS = 65_536
SEED = "11"
STEPS, FAN = 10, 16  # every step cuts the interval of the exponent to a sixteenth


def _order(*parts) -> Column:
    return F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *[p if isinstance(p, Column) else F.col(p) for p in parts])), 1, 16)


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the rows with words; a null source is the source ''."""
    words = F.size(F.regexp_extract_all(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD), F.lit(0)))
    return docs.select(
        docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"), words.cast("bigint").alias("n_tokens")
    ).where("n_tokens > 0")


def exponent(sources: DataFrame, budget: float, entropy: float, repeats: float) -> float:
    """Bisect the exponent over ``sources(p, tokens)``; every step is one aggregation of that table."""

    def measured(points: list[float]) -> list[tuple[float, float]]:
        p, t = F.col("p"), F.col("tokens")
        cells = []
        for a in points:
            power = F.pow(p, F.lit(a))
            cells.append(F.struct(F.sum(power).alias("z"), F.sum(power * F.log(p)).alias("l"), F.max(power / t).alias("m")))
        row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
        return [(log(c.z) - a * c.l / c.z, c.m * budget / c.z) for a, c in zip(points, row)]

    most = log(max(sources.count(), 1))

    def narrowed(lo: float, hi: float, low_side) -> tuple[float, float]:
        for _ in range(STEPS):
            grid = [lo + (hi - lo) * k / FAN for k in range(FAN + 1)]
            stays = [low_side(*m) for m in measured(grid[1:-1])]
            k = next((i for i, ok in enumerate(stays) if not ok), len(stays))
            lo, hi = grid[k], grid[k + 1]
        return lo, hi

    even = lambda h, r: h >= entropy * most
    (h1, r1), = measured([1.0])
    a = 1.0 if even(h1, r1) else narrowed(0.0, 1.0, even)[0]
    (_, r), = measured([a])
    if r > repeats:
        a = 1.0 if r1 > repeats else narrowed(a, 1.0, lambda h, r: r > repeats)[1]
    return a


def mix_sources(
    docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per drawn copy: ``doc_id, source, epoch, block, token_start, n_tokens, weight, mix_key``.

    ``token_start`` counts the tokens of the source drawn before; ordering all rows by
    ``mix_key`` interleaves the sources at their weights. ``budget`` is in tokens (words) and
    defaults to those of ``docs``. A row is drawn while its source has budget left, so a source
    exceeds its share by less than its last row. Rows without words hold nothing to draw and are
    left out; a null source is the source ''; a null doc_id is carried through; repeated rows are
    drawn each for itself. An empty table gives an empty mixture. Other columns are ignored.
    """
    rows = stored(sized(columns_of(docs, "doc_id", "source", "text")))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = stored(
        rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    )
    a = exponent(shares, float(budget), entropy, repeats) if total else 1.0
    power = F.pow("p", F.lit(a))
    z = shares.agg(F.sum(F.round(power, 12))).first()[0] or 1.0
    quota = shares.withColumn("weight", F.round(F.round(power, 12) / F.lit(z), 9)).select(
        "source", "tokens", "weight", F.round(F.col("weight") * F.lit(float(budget))).cast("bigint").alias("quota")
    )
    # Blocks: the documents of a source in a fixed random order, cut every block_tokens tokens.
    placed = running_sums(
        rows.withColumn("_h", _order("source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        ["source"], ["_h", "doc_id", "n_tokens"], {"_end": F.col("n_tokens")},
    ).select("doc_id", "source", "n_tokens", F.floor((F.col("_end") - F.col("n_tokens")) / block_tokens).cast("bigint").alias("block"))
    placed = stored(placed)
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")).join(quota, "source")
    epochs = blocks.where("quota > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / F.col("tokens"))))
    ).withColumn("_b", _order("source", F.col("epoch").cast("string"), F.col("block").cast("string")))
    ordered = running_sums(epochs, ["source", "epoch"], ["_b", "block"], {"_end": F.col("size")}).withColumn(
        "_start", F.col("epoch") * F.col("tokens") + F.col("_end") - F.col("size")
    ).where("_start < quota").select("source", "block", "epoch", "_start", "weight", "quota")
    drawn = placed.join(ordered, ["source", "block"])
    # A block holds block_tokens tokens and one document more at most.
    inside = Window.partitionBy("source", "epoch", "block").orderBy(
        _order("source", F.col("epoch").cast("string"), F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "n_tokens"
    ).rowsBetween(Window.unboundedPreceding, 0)
    run = drawn.withColumn("token_start", F.col("_start") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return run.where("token_start < quota").select(
        "doc_id", "source", "epoch", "block", "token_start", "n_tokens", "weight",
        F.round((F.col("token_start") + 0.5) / F.col("quota"), 12).alias("mix_key"),
    )


def mixing_sql() -> str:
    """The same rows in DuckDB SQL over ``documents``."""
    z = "list_sum(list_transform(ps, lambda x: pow(x, {a})))"
    h = f"(ln({z}) - ({{a}}) * list_sum(list_transform(ps, lambda x: pow(x, {{a}}) * ln(x))) / {z})"
    r = f"(list_max(list_transform(list_zip(ps, ts), lambda x: pow(x[1], {{a}}) / x[2])) * total / {z})"
    mid = "((lo + hi) / 2)"
    md5 = lambda *p: f"substr(md5(concat_ws('|', '{SEED}', {', '.join(p)})), 1, 16)"
    doc = "coalesce(cast(doc_id as varchar), '')"
    return f"""with recursive sized as (
  select doc_id, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
rows_ as (select * from sized where n_tokens > 0),
tot as (select sum(n_tokens)::double as total from rows_),
shares as (select source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double / any_value(total) as p from rows_, tot group by source),
lists as (select list(p order by source) as ps, list(tokens::double order by source) as ts, any_value(total) as total, ln(count(*)) as most from shares, tot),
even as (
  select 0 as i, 0.0::double as lo, 1.0::double as hi, * from lists
  union all
  select i + 1, case when {h.format(a=mid)} >= {ENTROPY} * most then {mid} else lo end,
    case when {h.format(a=mid)} >= {ENTROPY} * most then hi else {mid} end, ps, ts, total, most from even where i < {STEPS * 4}),
first_ as (select case when {h.format(a='1.0')} >= {ENTROPY} * most then 1.0 else lo end as a0, ps, ts, total from even where i = {STEPS * 4}),
rep as (
  select 0 as i, a0 as lo, 1.0::double as hi, * from first_
  union all
  select i + 1, case when {r.format(a=mid)} > {REPEATS} then {mid} else lo end,
    case when {r.format(a=mid)} > {REPEATS} then hi else {mid} end, a0, ps, ts, total from rep where i < {STEPS * 4}),
expo as (select case when {r.format(a='a0')} <= {REPEATS} then a0 when {r.format(a='1.0')} > {REPEATS} then 1.0 else hi end as a from rep where i = {STEPS * 4}),
powers as (select source, tokens, round(pow(p, a), 12) as w from shares, expo),
weights as (select source, tokens, round(w / sum(w) over (), 9) as weight from powers),
quotas as (select source, tokens, weight, round(weight * total)::bigint as quota from weights, tot),
placed as (select doc_id, source, n_tokens, cast(floor((sum(n_tokens) over (partition by source order by {md5('source', doc)}, doc_id, n_tokens
    rows unbounded preceding) - n_tokens) / {BLOCK_TOKENS}) as bigint) as block from rows_),
blocks as (select source, block, sum(n_tokens)::bigint as size, any_value(tokens) as tokens, any_value(weight) as weight, any_value(quota) as quota
    from placed join quotas using (source) group by source, block),
epochs as (select *, unnest(range(0, cast(floor((quota - 1) / tokens) as bigint) + 1)) as epoch from blocks where quota > 0),
ordered as (select *, epoch * tokens + sum(size) over (partition by source, epoch order by {md5('source', 'cast(epoch as varchar)', 'cast(block as varchar)')}, block
    rows unbounded preceding) - size as start_ from epochs),
drawn as (select p.doc_id, source, o.epoch, block, p.n_tokens, o.weight, o.quota,
    o.start_ + sum(p.n_tokens) over (partition by source, o.epoch, block order by {md5('source', 'cast(o.epoch as varchar)', "'d'", 'coalesce(cast(p.doc_id as varchar), ' + "'')")}, p.doc_id, p.n_tokens
    rows unbounded preceding) - p.n_tokens as token_start from placed p join ordered o using (source, block) where o.start_ < o.quota)
select doc_id, source, epoch::bigint as epoch, block, token_start::bigint as token_start, n_tokens, weight,
  round((token_start + 0.5) / quota, 12) as mix_key from drawn where token_start < quota"""
