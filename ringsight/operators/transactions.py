"""Operators on the transaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringsight.functions.ordered import blocks_with_halo, running_sums, with_position
from ringsight.functions.scalars import one_row
from ringsight.functions.timeframes import block_size, in_blocks, lookback_sums, own_block, presence_changes
from ringsight.session import cut_lineage

# Look-back lengths, row spans, card spans (seconds), location bands.
GLOBAL_LOOKBACKS = [2, 3, 5, 15, 20, 50, 100, 150, 200, 300, 864, 2590, 5100, 10000, 24000]
SOURCE_LOOKBACKS = [5, 20]
ROW_SPANS = [1, 3, 5, 10, 20, 50, 100, 500]
RADII = [1, 2, 3, 4, 5]
CARD_SPANS = [60, 3600, 86400, 172800, 2628000, 7884000, 15768000, 31536000]
BAND_LIMITS = [(100, 1), (102, 2), (110, 3), (140, 4)]
DISTINCT = ["Target", "Location", "Type"]
ENTROPY_SHIFT = 1e-5


def drop_unlabeled(transactions: DataFrame, unlabeled: int = 2) -> DataFrame:
    """Only rows with a known label."""
    return transactions.where(F.col("Labels") != unlabeled)


def _sample_std(n: Column, s: Column, ss: Column, digits: int) -> Column:
    """Sample std from exact integer sums, centred on the rounded mean before leaving integers."""
    n = n.cast("decimal(19,0)")
    c = F.round(s / n, 0).cast("decimal(19,0)")
    centred = (ss - 2 * c * s + n * c * c).cast("double")
    shift = (s - n * c).cast("double")
    size = n.cast("double")
    var = (centred - shift * shift / size) / (size - 1)
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))) / F.lit(10.0**digits))


def rolling_amount(
    transactions: DataFrame, keys: list[str], lookbacks: list[int], digits: int = 4, at_least: int = 86_400
) -> DataFrame:
    """T1 (no keys) and T2 (``Source``): amount and variety statistics over [t - L, t].

    Amounts are summed as integers of 10^-digits, so differences of running sums are exact.
    """
    lookbacks = sorted(lookbacks)
    reach, size = max(lookbacks), block_size(lookbacks, at_least)
    fixed = F.round(F.col("Amount") * F.lit(10.0**digits), 0).cast("decimal(19,0)")
    wide = "decimal(38,0)"
    amounts = transactions.groupBy(*keys, "Time").agg(
        F.count(F.lit(1)).alias("n"), F.sum(fixed.cast("bigint")).alias("s"), F.sum((fixed * fixed).cast(wide)).cast(wide).alias("ss")
    )
    seen = transactions.select(*keys, "Time", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(c).cast("string").alias("value")) for d, c in enumerate(DISTINCT)
    ])))
    changes = presence_changes(seen, keys, "Time", lookbacks, size)
    sums = lookback_sums(in_blocks(amounts, "Time", size, reach), keys, "Time", ["n", "s", "ss"], lookbacks)
    sums = sums.where(own_block("Time", size)).drop("_block")
    entered = F.count_if(F.col("change") > 0).alias("entered")
    grid = changes.groupBy(*keys, "_block", "Time").agg(entered, *[
        F.sum(F.when((F.col("dim") == d) & (F.col("lo") <= i) & (F.col("hi") >= i), F.col("change")).otherwise(0)).alias(f"d{d}_{i}")
        for d in range(len(DISTINCT)) for i in range(len(lookbacks))
    ])
    variety = [f"d{d}_{i}" for d in range(len(DISTINCT)) for i in range(len(lookbacks))]
    present = lookback_sums(grid, keys, "Time", [], [], variety)
    # Only the times at which something happened are asked for.
    present = present.where(own_block("Time", size) & (F.col("entered") > 0)).select(
        *keys, "Time", *[f"{c}_now" for c in variety]
    )
    framed = sums.join(present, [*keys, "Time"])
    stats = []
    scale = F.lit(10.0**digits)
    for i, length in enumerate(lookbacks):
        n, s, ss = (F.col(f"{c}_{length}") for c in ("n", "s", "ss"))
        stats += [
            (s.cast("double") / n.cast("double") / scale).alias(f"trans_at_avg_{length}"),
            (s.cast("double") / scale).alias(f"trans_at_totl_{length}"),
            F.coalesce(_sample_std(n, s, ss, digits), F.lit(0.0)).alias(f"trans_at_std_{length}"),
            n.cast("bigint").alias(f"trans_at_num_{length}"),
            *[F.col(f"d{d}_{i}_now").alias(f"trans_{c.lower()}_num_{length}") for d, c in enumerate(DISTINCT)],
        ]
    points = framed.select(*keys, "Time", *stats)
    bias = {f"trans_at_bias_{length}": F.col("Amount") - F.col(f"trans_at_avg_{length}") for length in lookbacks}
    return transactions.join(points, [*keys, "Time"]).withColumns(bias)


def rolling_amount_global(transactions: DataFrame, lookbacks: list[int] = GLOBAL_LOOKBACKS) -> DataFrame:
    """Over the whole log."""
    return rolling_amount(transactions, [], lookbacks)


def rolling_amount_by_source(transactions: DataFrame, lookbacks: list[int] = SOURCE_LOOKBACKS) -> DataFrame:
    """Over the rows of the same Source."""
    return rolling_amount(transactions, ["Source"], lookbacks)


def card_location_windows(cards: DataFrame, spans: list[int] = CARD_SPANS, digits: int = 4) -> DataFrame:
    """Per row and county of its card, amounts of that card there over eight look-backs.

    One row per (row_id, county the card has ever used, span). A county the card never used has
    only zeros in every span, so the missing rows of the full grid are known without being stored.

    The amounts up to a time are running sums over ranges of (card, county, time), and a span is the
    difference of two of them: its two ends lie as rows without amounts among the others. So a span may be
    of any length, and a card with a third of all rows is spread over a third of the ranges.
    """
    spans = sorted(spans)
    at = F.unix_seconds("time_stamp")
    rows = cards.withColumn("_t", at)
    money = {"g": "amt_grant", "p": "amt_purch"}
    exact = {k: F.round(F.col(c) * F.lit(10.0**digits), 0).cast("bigint") for k, c in money.items()}
    seen = cut_lineage(rows.groupBy("card_id", "loc_cty", "_t").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in exact.items()]
    ))
    places = seen.select("card_id", "loc_cty").distinct()
    asked = seen.select("card_id", "_t").distinct().join(places, "card_id")
    # The sums up to now, and those before each span: its first second still counts.
    ends = F.array(F.lit(0), *[F.lit(span) for span in spans])
    points = asked.select("card_id", "loc_cty", "_t", F.explode(ends).alias("_span")).select(
        "card_id", "loc_cty", (F.col("_t") - F.when(F.col("_span") > 0, F.col("_span") + 1).otherwise(0)).alias("_at"), F.lit(1).alias("_asks"),
        "_t", "_span", *[F.lit(0).cast("bigint").alias(c) for c in ("n", "g", "p")],
    )
    stream = points.unionByName(seen.select(
        "card_id", "loc_cty", F.col("_t").alias("_at"), F.lit(0).alias("_asks"), "_t", F.lit(0).alias("_span"), "n", "g", "p"
    ))
    upto = running_sums(
        stream, ["card_id", "loc_cty"], ["_at", "_asks", "_t", "_span"], {f"{c}_upto": F.col(c) for c in ("n", "g", "p")}
    ).where("_asks = 1")
    framed = upto.groupBy("card_id", "loc_cty", "_t").agg(*[
        F.max(F.when(F.col("_span") == span, F.col(f"{c}_upto"))).alias(f"{c}_{span}") for c in ("n", "g", "p") for span in (0, *spans)
    ])
    scale = F.lit(10.0**digits)

    def one(span: int) -> Column:
        n, g, p = ((F.col(f"{c}_0") - F.col(f"{c}_{span}")).cast("double") for c in ("n", "g", "p"))
        return F.struct(
            F.lit(span).alias("span"), F.when(n > 0, g / n / scale).otherwise(0.0).alias("avg_grant"),
            (g / scale).alias("total_grant"), F.when(n > 0, p / n / scale).otherwise(0.0).alias("avg_purch"),
            (p / scale).alias("total_purch"), n.alias("num"),
        )

    windows = framed.select("card_id", F.col("loc_cty").alias("county"), "_t", F.inline(F.array(*[one(s) for s in spans])))
    return rows.select("row_id", "card_id", "_t", "amt_grant", "amt_purch", "is_fraud").join(
        windows, ["card_id", "_t"]
    ).drop("_t", "card_id")


# --- row spans -----------------------------------------------------------------------------------

def location_number(location: Column) -> Column:
    return F.regexp_extract(location, r"L(\d+)", 1).cast("int")


def location_band(number: Column) -> Column:
    """100 -> 1, to 102 -> 2, to 110 -> 3, to 140 -> 4, above -> 5; below 100 unchanged."""
    chain = F.when(number < BAND_LIMITS[0][0], number)
    for limit, band in BAND_LIMITS:
        chain = chain.when(number <= limit, F.lit(band))
    return chain.otherwise(F.lit(5))


def numbered_log(transactions: DataFrame) -> DataFrame:
    """The labelled rows with their position ``idx`` in the log."""
    return with_position(drop_unlabeled(transactions), [], ["row_id"], "idx")


def _share_entropy(amount: Column, total: Column) -> Column:
    share = F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(amount, total))
    return -share * F.log(F.lit(ENTROPY_SHIFT) + share)


def trading_entropy(transactions: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of the amount shares of the transaction types of each key."""
    by_type = transactions.groupBy(*keys, "Type").agg(F.sum("Amount").alias("_a"))
    totals = by_type.groupBy(*keys).agg(F.sum("_a").alias("_t"))
    return by_type.join(totals, keys).groupBy(*keys).agg(
        F.sum(_share_entropy(F.col("_a"), F.col("_t"))).alias("trading_entropy")
    )


def _span_sums(log: DataFrame, keys: list[str], sums: list[str], spans: list[int]) -> DataFrame:
    size = block_size(spans, 100_000)
    framed = lookback_sums(in_blocks(log, "idx", size, max(spans)), keys, "idx", sums, spans, include_now=False)
    return framed.where(own_block("idx", size))


def _span_entropies(log: DataFrame, spans: list[int], digits: int, as_written: bool) -> DataFrame:
    """``(row_id, deltas)``: entropy before less entropy with the current row, one element per span.

    The amounts of each type are summed over the spans at every row of the Source, whatever the type of
    that row; the set of types of a Source is small, so a row's sums meet in one array.
    """
    fixed = F.round(F.col("Amount") * F.lit(10.0**digits), 0).cast("bigint")
    point = log.select("row_id", "idx", "Source", "Type", fixed.alias("a"))

    def by_type(keys: list[str]) -> DataFrame:
        kinds = point.groupBy(*keys).agg(F.collect_set("Type").alias("kinds"))
        rows = point.withColumnRenamed("Type", "own")
        rows = rows.join(kinds, keys) if keys else rows.withColumn("kinds", kinds.scalar())
        rows = rows.withColumn("Type", F.explode("kinds")).drop("kinds")
        mine = F.col("own") == F.col("Type")
        rows = rows.select(
            "row_id", "idx", *keys, "Type", F.when(mine, F.col("a")).otherwise(0).cast("bigint").alias("a"),
            mine.cast("bigint").alias("n"),
        )
        return _span_sums(rows, [*keys, "Type"], ["a", "n"], spans)

    def cell(span: int, now: bool) -> Column:
        here = F.col("idx") >= span
        amount = F.when(here, F.col(f"a_{span}")).otherwise(0) + (F.col("a") if now else F.lit(0))
        count = F.when(here, F.col(f"n_{span}")).otherwise(0) + (F.col("n") if now else F.lit(0))
        # Without a row of the type there is nothing to add to the entropy.
        return F.when(count > 0, amount.cast("double"))

    def entropies(rows: DataFrame, kinds: dict[str, bool]) -> DataFrame:
        """Per row and name an array over the spans; ``kinds`` says whether the current row counts."""
        cells = F.array(*[cell(s, now) for now in kinds.values() for s in spans])
        types = rows.groupBy("row_id").agg(F.collect_list(cells).alias("types"))  # one array per type of the Source

        def entropy(i: int) -> Column:
            amounts = F.filter(F.transform("types", lambda t: t[i]), lambda x: x.isNotNull())
            total = F.aggregate(amounts, F.lit(0.0), lambda acc, x: acc + x)
            summed = F.aggregate(amounts, F.lit(0.0), lambda acc, x: acc + _share_entropy(x, total))
            return F.when(F.size(amounts) > 0, summed).otherwise(0.0)

        return types.select("row_id", *[
            F.array(*[entropy(k * len(spans) + i) for i in range(len(spans))]).alias(name) for k, name in enumerate(kinds)
        ])

    same = by_type(["Source"])
    if not as_written:
        both = entropies(same, {"old": False, "new": True})
        return both.select("row_id", F.zip_with("old", "new", lambda o, n: o - n).alias("deltas"))
    # An empty history also empties the window that ends at the current row.
    new = entropies(by_type([]), {"new": True}).join(log.select("row_id", "idx"), "row_id").select("row_id", F.array(*[
        F.when(F.col("idx") >= s, F.col("new")[i]).otherwise(0.0) for i, s in enumerate(spans)
    ]).alias("new"))
    return entropies(same, {"old": False}).join(new, "row_id").select(
        "row_id", F.zip_with("old", "new", lambda o, n: o - n).alias("deltas")
    )


def _span_rows(
    rows: DataFrame, entropies: DataFrame, spans: list[int], sums: list[tuple[str, str, Column | None]], digits: int, extra: str | None
) -> DataFrame:
    """One row per row, span and radius. The entropies join row by row, before the spans are written out."""
    scale = F.lit(10.0**digits)
    cells = []
    for i, span in enumerate(spans):
        here = F.col("idx") >= span
        for s, n, tag in sums:
            total = F.when(here, F.col(f"{s}_{span}").cast("double") / scale).otherwise(0.0)
            fields = [F.lit(span).alias("span")] + ([tag.alias(extra)] if extra else [])
            cells.append(F.struct(
                *fields, (total / span).alias("avg_amount"), total.alias("total_amount"), (F.col("Amount") - total / span).alias("bias_amount"),
                F.when(here, F.col(f"{n}_{span}")).otherwise(0).cast("bigint").alias("number"), F.col("deltas")[i].alias("entropy_delta"),
            ))
    return rows.join(entropies, "row_id").select("row_id", F.inline(F.array(*cells)))


def span_2d(
    transactions: DataFrame, spans: list[int] = ROW_SPANS, digits: int = 4, as_written: bool = False
) -> DataFrame:
    """T4: the last w rows of the log that share the Source: mean over w, total, bias, count, entropy change.

    Before row w of the log the history is empty. ``as_written`` takes the entropy that includes
    the current row over all sources. Amounts are summed as integers of 10^-digits; a sum beyond a
    long is an error.
    """
    log = cut_lineage(numbered_log(transactions))
    fixed = F.round(F.col("Amount") * F.lit(10.0**digits), 0).cast("bigint")
    rows = _span_sums(log.withColumns({"a": fixed, "n": F.lit(1).cast("bigint")}), ["Source"], ["a", "n"], spans)
    return _span_rows(rows, _span_entropies(log, spans, digits, as_written), spans, [("a", "n", None)], digits, None)


def span_3d(
    transactions: DataFrame, spans: list[int] = ROW_SPANS, radii: list[int] = RADII, digits: int = 4,
    as_written: bool = False,
) -> DataFrame:
    """T5: T4 within location radii: only history whose band lies less than r away.

    A row is offered to each band it can be seen from, so the radius becomes an equality on the
    band and the same look-back sums apply.
    """
    log = cut_lineage(numbered_log(transactions).withColumn("band", location_band(location_number(F.col("Location")))))
    fixed = F.round(F.col("Amount") * F.lit(10.0**digits), 0).cast("bigint")
    far = max(radii) - 1
    spread = log.select(
        "row_id", "idx", "Source", "Amount", fixed.alias("a"), F.explode(F.sequence(F.lit(-far), F.lit(far))).alias("off"), "band"
    )
    sums = {}
    for r in radii:
        inside = F.abs("off") < r
        sums[f"a{r}"] = F.when(inside, F.col("a")).otherwise(0).cast("bigint")
        sums[f"n{r}"] = inside.cast("bigint")
    offered = spread.withColumns({"band": F.col("band") + F.col("off"), **sums})
    rows = _span_sums(offered, ["Source", "band"], list(sums), spans).where(F.col("off") == 0)
    return _span_rows(
        rows, _span_entropies(log, spans, digits, as_written), spans, [(f"a{r}", f"n{r}", F.lit(r)) for r in radii], digits, "radius"
    )


# --- graph of transactions ------------------------------------------------------------------------

def sequence_edges(
    transactions: DataFrame, steps: int = 2, columns: tuple[str, ...] = ("Source", "Target", "Location", "Type"),
    with_self: bool = False, block: int = 100_000,
) -> DataFrame:
    """Link each transaction to the next ones that share a column value, in time order."""
    long = transactions.select("row_id", "Time", F.inline(F.array(*[
        F.struct(F.lit(c).alias("relation"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    placed = with_position(long, ["relation", "value"], ["Time", "row_id"])
    blocks = blocks_with_halo(placed, "pos", after=steps, size=block)
    w = Window.partitionBy("relation", "value", "_block").orderBy("pos")
    offsets = range(0 if with_self else 1, steps + 1)
    linked = blocks.withColumn("next", F.array(*[F.lead("row_id", j).over(w) if j else F.col("row_id") for j in offsets]))
    return linked.where(~F.col("_halo")).select("relation", F.col("row_id").alias("src"), F.explode("next").alias("dst")).where(
        F.col("dst").isNotNull()
    )


def label_dictionary(values: DataFrame) -> DataFrame:
    """``(column, value, code)``: 0-based rank of every distinct text in its column."""
    return with_position(values.select("column", "value").distinct(), ["column"], ["value"], "code")


def label_encode(transactions: DataFrame, columns: tuple[str, ...] = ("Source", "Target", "Location", "Type")) -> DataFrame:
    """Replace texts by their rank in sorted order."""
    values = transactions.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    codes = label_dictionary(values)
    out = transactions
    for c in columns:
        mine = codes.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"_{c}"))
        out = out.join(mine, c)
    return out.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in transactions.columns])


def account_graph(transactions: DataFrame) -> DataFrame:
    """Account edges with the z-scored amount and the position of the one-hot location.

    The one-hot block is stored as the index of its single 1.
    """
    rows = drop_unlabeled(transactions)
    accounts = rows.select(F.inline(F.array(
        F.struct(F.lit("account").alias("column"), F.col("Source").alias("value")),
        F.struct(F.lit("account").alias("column"), F.col("Target").alias("value")),
        F.struct(F.lit("location").alias("column"), F.col("Location").alias("value")),
    )))
    codes = label_dictionary(accounts)
    account = codes.where(F.col("column") == "account").select("value", "code")
    place = codes.where(F.col("column") == "location").select(F.col("value").alias("Location"), F.col("code").alias("location_code"))
    m = one_row(rows.agg(F.avg("Amount").alias("mean"), F.stddev_pop("Amount").alias("std")))
    return (
        rows.join(account.withColumnsRenamed({"value": "Source", "code": "src"}), "Source")
        .join(account.withColumnsRenamed({"value": "Target", "code": "dst"}), "Target")
        .join(place, "Location")
        .select("row_id", "src", "dst", ((F.col("Amount") - m["mean"]) / m["std"]).alias("amount_z"), "location_code")
    )
