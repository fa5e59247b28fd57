"""Run registered queries next to their SQL in DuckDB and compare the rows.

Usage: python tests/compare.py [folder] [name-prefix ...]
With ONLY_SQL=1 in the environment, queries without SQL are left out.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(normal(r[i]) for i in order) for r in rows])


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())


def difference(spark_side, duck_side) -> str | None:
    (sc, sr), (dc, dr) = spark_side, duck_side
    if sc != dc:
        return f"columns: only spark {sorted(set(sc) - set(dc))[:8]}, only sql {sorted(set(dc) - set(sc))[:8]}"
    if len(sr) != len(dr):
        return f"rows: spark {len(sr)}, sql {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(sc, a, b) if x != y][:4]
        return f"{len(bad)} of {len(sr)} rows differ, first {a[:2]}: {cells}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from ringsight.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(folder), oracle_sql(), 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if os.environ.get("ONLY_SQL") and name not in sqls:
            continue
        try:
            t0 = time.time()
            got = spark_rows(query(spark, folder))
            t1 = time.time()
            if name in sqls:
                verdict = difference(got, duck_rows(con, sqls[name])) or "ok"
            else:
                verdict = "rows only"
            t2 = time.time()
            note = f"{len(got[1])} rows x {len(got[0])}, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
        except Exception as error:  # report every query, then fail
            verdict, note = "ERROR " + str(error).strip()[:600], ""
        failed += verdict not in ("ok", "rows only")
        print(f"{name}: {verdict} [{note}]", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
