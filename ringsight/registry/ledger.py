"""Transaction-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import transactions as T
from ringsight.registry.base import CARDS, TRANSACTIONS, Registry, settle, settled
from ringsight.sources.warehouse import event_transactions, order_cards

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def log(op, keys):
    return lambda spark, folder: settle(op(event_transactions(spark, folder)), keys)


def features_only(op):
    def run(spark, folder):
        rows = op(event_transactions(spark, folder))
        return settle(rows.select("row_id", *[c for c in rows.columns if c.startswith("trans_")]), ("row_id",))

    return run


def rolling_sql(lookbacks, partition=""):
    def w(length):
        return f'over ({partition} order by "Time" range between {length} preceding and current row)'

    cols = ", ".join(
        f'avg("Amount") {w(n)} as trans_at_avg_{n}, sum("Amount") {w(n)} as trans_at_totl_{n}, '
        f'stddev_samp("Amount") {w(n)} as trans_at_std_{n}, "Amount" - avg("Amount") {w(n)} as trans_at_bias_{n}, '
        f'count(*) {w(n)} as trans_at_num_{n}, ' + ", ".join(
            f'count(distinct "{c}") {w(n)} as trans_{c.lower()}_num_{n}' for c in T.DISTINCT) for n in lookbacks)
    return settled([TRANSACTIONS], f"select row_id, {cols} from trans", ("row_id",))


R.add("t1_rolling_amount_global", features_only(T.rolling_amount_global), rolling_sql(T.GLOBAL_LOOKBACKS))
R.add("t2_rolling_amount_by_source", features_only(T.rolling_amount_by_source),
      rolling_sql(T.SOURCE_LOOKBACKS, 'partition by "Source"'))

CARD_W = "c.card_id = r.card_id and c.loc_cty = p.loc_cty and c.time_stamp <= r.time_stamp and c.time_stamp >= r.time_stamp - to_seconds(s.span)"
R.add("t3_card_location_windows", lambda spark, folder: settle(
    T.card_location_windows(order_cards(spark, folder)), ("row_id", "county", "span", "is_fraud")), settled(
    [CARDS, "places as (select distinct card_id, loc_cty from cards)",
     f"s as (select unnest({T.CARD_SPANS})::int as span)"], f"""
  select r.row_id, r.amt_grant, r.amt_purch, r.is_fraud, p.loc_cty as county, s.span, avg(c.amt_grant) as avg_grant,
    sum(c.amt_grant) as total_grant, avg(c.amt_purch) as avg_purch, sum(c.amt_purch) as total_purch, count(c.row_id) as num
  from cards r join places p on p.card_id = r.card_id cross join s left join cards c on {CARD_W}
  group by r.row_id, r.amt_grant, r.amt_purch, r.is_fraud, p.loc_cty, s.span""",
    ("row_id", "county", "span", "is_fraud")))

LOG = 'flog as (select *, row_number() over (order by row_id) - 1 as idx from trans where "Labels" <> 2)'
SPANS = f"s as (select unnest({T.ROW_SPANS})::int as span)"
BAND = """(case when l < 100 then l when l <= 100 then 1 when l <= 102 then 2 when l <= 110 then 3 when l <= 140 then 4 else 5 end)"""
BANDED = f"""banded as (select *, {BAND} as band from (select *, cast(substr("Location", 2) as int) as l from flog))"""
ENTROPY = "-sum((case when tot = 0 then 1 else amt/tot end) * ln(1e-5 + (case when tot = 0 then 1 else amt/tot end)))"


def entropy_ctes(as_written=False):
    prev = 'h."Source" = r."Source" and r.idx >= s.span and h.idx >= r.idx - s.span and h.idx < r.idx'
    now = f'({prev}) or h.idx = r.idx'
    if as_written:
        now = "r.idx >= s.span and h.idx >= r.idx - s.span and h.idx <= r.idx"

    def ent(name, cond):
        return (f'{name} as (select row_id, span, {ENTROPY} as e from (select *, sum(amt) over (partition by row_id, span) as tot from '
                f'(select r.row_id, s.span, h."Type", sum(h."Amount") as amt from flog r cross join s join flog h on {cond} group by 1, 2, 3)) group by row_id, span)')

    return [SPANS, ent("old_e", prev), ent("new_e", now)]


def span_sql(as_written=False):
    return settled([TRANSACTIONS, LOG] + entropy_ctes(as_written), """
  select r.row_id, s.span, coalesce(a,0)/s.span as avg_amount, coalesce(a,0) as total_amount, r."Amount" - coalesce(a,0)/s.span as bias_amount,
    coalesce(n,0) as number, coalesce(o.e,0) - coalesce(w.e,0) as entropy_delta
  from flog r cross join s left join (select r.row_id, s.span, sum(h."Amount") as a, count(*) as n from flog r cross join s join flog h
     on h."Source" = r."Source" and r.idx >= s.span and h.idx >= r.idx - s.span and h.idx < r.idx group by 1, 2) g on g.row_id = r.row_id and g.span = s.span
  left join old_e o on o.row_id = r.row_id and o.span = s.span left join new_e w on w.row_id = r.row_id and w.span = s.span""",
                   ("row_id", "span"))


R.add("t4_span_2d", log(T.span_2d, ("row_id", "span")), span_sql())
R.add("t4_span_2d_as_written", log(lambda t: T.span_2d(t, as_written=True), ("row_id", "span")), span_sql(as_written=True))
R.add("t5_span_3d", log(T.span_3d, ("row_id", "span", "radius")), settled(
    [TRANSACTIONS, LOG, BANDED] + entropy_ctes() + ["rad as (select unnest([1,2,3,4,5])::int as radius)"], """
  select r.row_id, s.span, rad.radius, coalesce(a,0)/s.span as avg_amount, coalesce(a,0) as total_amount, r."Amount" - coalesce(a,0)/s.span as bias_amount,
    coalesce(n,0) as number, coalesce(o.e,0) - coalesce(w.e,0) as entropy_delta
  from flog r cross join s cross join rad left join (select r.row_id, s.span, rad.radius, sum(h."Amount") as a, count(*) as n
     from banded r cross join s join banded h on h."Source" = r."Source" and r.idx >= s.span and h.idx >= r.idx - s.span and h.idx < r.idx
     join rad on abs(h.band - r.band) < rad.radius group by 1, 2, 3) g on g.row_id = r.row_id and g.span = s.span and g.radius = rad.radius
  left join old_e o on o.row_id = r.row_id and o.span = s.span left join new_e w on w.row_id = r.row_id and w.span = s.span""",
    ("row_id", "span", "radius")))
R.add("t6_trading_entropy", log(lambda t: T.trading_entropy(t, ["Source"]), ("Source",)), settled([TRANSACTIONS], f"""
  select "Source", {ENTROPY} as trading_entropy from (select *, sum(amt) over (partition by "Source") as tot from
    (select "Source", "Type", sum("Amount") as amt from trans group by 1, 2)) group by "Source" """, ("Source",)))
R.add("t7_location_band", lambda spark, folder: event_transactions(spark, folder).select(
    "row_id", T.location_band(T.location_number(F.col("Location"))).alias("band")),
    f"""with {TRANSACTIONS} select row_id, {BAND} as band from (select row_id, cast(substr("Location", 2) as int) as l from trans)""")


def sequence_sql(offsets):
    parts = []
    for c in ("Source", "Target", "Location", "Type"):
        for j in offsets:
            nxt = f'lead(row_id, {j}) over (partition by "{c}" order by "Time", row_id)' if j else "row_id"
            parts.append(f"select '{c}' as relation, row_id as src, {nxt} as dst from trans")
    return f"with {TRANSACTIONS} select * from (" + " union all ".join(parts) + ") where dst is not null"


R.add("t8_sequence_edges", lambda spark, folder: T.sequence_edges(event_transactions(spark, folder)), sequence_sql((1, 2)))
R.add("t8_sequence_edges_with_self", lambda spark, folder: T.sequence_edges(
    event_transactions(spark, folder), with_self=True), sequence_sql((0, 1, 2)))
CODES = ", ".join(f'dense_rank() over (order by "{c}") - 1 as "{c}"' for c in ("Source", "Target", "Location", "Type"))
R.add("t9_label_encode", lambda spark, folder: T.label_encode(event_transactions(spark, folder)),
      f'with {TRANSACTIONS} select row_id, "Time", "Amount", "Labels", {CODES} from trans')
R.add("t10_account_graph", log(T.account_graph, ("row_id", "src", "dst", "location_code")), settled(
    [TRANSACTIONS, 'known as (select * from trans where "Labels" <> 2)',
     'acc as (select v, row_number() over (order by v) - 1 as code from (select "Source" as v from known union select "Target" from known))',
     'loc as (select v, row_number() over (order by v) - 1 as code from (select distinct "Location" as v from known))'], """
  select row_id, a.code as src, b.code as dst, ("Amount" - avg("Amount") over ())/(stddev_pop("Amount") over ()) as amount_z,
    l.code as location_code from known join acc a on a.v = "Source" join acc b on b.v = "Target" join loc l on l.v = "Location" """,
    ("row_id", "src", "dst", "location_code")))
R.add("t11_drop_unlabeled", lambda spark, folder: T.drop_unlabeled(event_transactions(spark, folder)),
      f'with {TRANSACTIONS} select * from trans where "Labels" <> 2')
