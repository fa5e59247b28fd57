"""Helpers to write a query next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ringsight.functions.scalars import finite

# Results are compared on at most 12 significant digits and 9 decimals, before they become floats.
DIGITS, DECIMALS = 12, 9

EDGES = """edges as (select l_orderkey*10+l_linenumber as edge_id, o_custkey as src,
  l_partkey % (select count(*) from customer) as dst,
  (case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end
   + case l_linestatus when 'F' then 0 else 1 end) as edge_type,
  date_diff('day', timestamp '1995-01-01', o_orderdate) + 1 as ts
  from lineitem join orders on l_orderkey = o_orderkey)"""

NODES = """nodes as (select c_custkey as node_id, c_acctbal as f0, cast(c_nationkey as double) as f1,
  cast(dense_rank() over (order by c_mktsegment)-1 as double) as f2,
  cast(count(o_orderkey) as double) as f3, coalesce(sum(cast(o_totalprice as decimal(18,4)))::double,-1.0) as f4,
  coalesce(sum(cast(o_totalprice as decimal(18,4)))::double/count(o_totalprice),-1.0) as f5, coalesce(max(o_totalprice),-1.0) as f6,
  coalesce(min(o_totalprice),-1.0) as f7, cast(count(distinct o_orderpriority) as double) as f8,
  cast(count(case when o_orderstatus='F' then 1 end) as double) as f9,
  case when c_acctbal<0 then 1 when c_mktsegment='BUILDING' then 2
       when c_mktsegment='MACHINERY' then 3 else 0 end as label,
  case when md5(concat_ws('|','42',cast(c_custkey as varchar))) < '9' then 'train'
       when md5(concat_ws('|','42',cast(c_custkey as varchar))) < 'd' then 'valid' else 'test' end as split
  from customer left join orders on o_custkey = c_custkey
  group by c_custkey, c_acctbal, c_nationkey, c_mktsegment)"""

GAPPED = "gapped as (select node_id, label, split, " + ", ".join(
    f"case when substr(md5(concat_ws('|','null','{i}',cast(node_id as varchar))),1,1) < '3' then -1.0 else f{i} end as f{i}"
    for i in range(10)
) + " from nodes)"

ENDS = """ends as (select src as node, dst as nbr, 1 as is_out, edge_id, edge_type, ts from edges
  union all select dst, src, 0, edge_id, edge_type, ts from edges)"""

UND = """und as (select distinct node, nbr from (select src as node, dst as nbr from edges
  union all select dst, src from edges))"""

TRANSACTIONS = """trans as (select event_id as row_id,
  cast(epoch(date_trunc('second', ts)) - epoch(timestamp '2024-01-01') as bigint) as "Time",
  'S'||user_id as "Source", 'T'||(event_id % 37) as "Target", value as "Amount",
  'L'||(95 + event_id % 60) as "Location", event_type as "Type",
  case when event_id%5=0 then 2 when event_id%11=0 then 1 else 0 end as "Labels" from events)"""

CARDS = """cards as (select o_orderkey as row_id, o_custkey as card_id, c_nationkey as loc_cty,
  o_custkey as loc_merch, o_orderdate as time_stamp, o_totalprice as amt_grant,
  o_totalprice*0.8 as amt_purch, cast(c_acctbal<0 as int) as is_fraud
  from orders join customer on o_custkey = c_custkey)"""

SCORED = """scored as (select l.doc_id as id, toxic as y, cast(n_chars % 1000 as double)/1000 as p,
  cast(l.doc_id % 5 as int) as fold from labels l join documents d on l.doc_id = d.doc_id)"""


def settle(df: DataFrame, keys=("node_id",)) -> DataFrame:
    """Common output form: keys as they are, every other column a finite float.

    Cutting the last digits first removes what depends on the order of a sum, so that the float
    next to it is the same in every run.
    """
    names = [c for c in df.columns if c not in set(keys)]

    def tidy(x):
        scale = F.pow(F.lit(10.0), F.least(F.lit(DECIMALS), F.lit(DIGITS - 1) - F.floor(F.log10(F.abs(x)))).cast("double"))
        return F.when(finite(x) == 0, 0.0).otherwise(F.floor(x * scale + 0.5) / scale).cast("float")

    # One lambda for all columns: a table of 800 columns would otherwise generate 800 copies of it.
    cells = F.transform(F.array(*[F.col(f"`{c}`").cast("double") for c in names]), tidy)
    packed = df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(keys)], cells.alias("_cells"))
    place = {c: i for i, c in enumerate(names)}
    return packed.select(*[
        F.col("_cells")[place[c]].alias(c) if c in place else F.col(f"`{c}`") for c in df.columns
    ])


def settled(ctes: list[str], select: str, keys=("node_id",)) -> str:
    """The same output form in SQL."""
    names = ", ".join(f'"{k}"' for k in keys)
    raw = f"cast(columns(* exclude ({names})) as double)"
    every = f"columns(* exclude ({names}))"
    x = f"case when {raw} is null or not isfinite({raw}) then 0 else {raw} end"
    scale = f"pow(10.0::double, least({DECIMALS}, {DIGITS - 1} - floor(log10(abs({every})))))"
    return (
        f"with {', '.join(ctes)}, answer as ({select}), clean as (select {names}, {x} from answer) "
        f"select {names}, cast(case when {every} = 0 then 0 else floor({every} * {scale} + 0.5) / {scale} end as float) from clean"
    )


def div(a: str, b: str, fill: str = "0") -> str:
    return f"(case when ({b}) is null or ({b}) = 0 or ({a}) is null then {fill} else cast(({a}) as double) / ({b}) end)"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql
