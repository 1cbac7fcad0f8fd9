"""Compare queries with their SQL: python tools/check_oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    found = normal(df.columns, df.collect())
    if sql is None:
        return len(found[1]), None
    con.execute(sql)
    wanted = normal([d[0] for d in con.description], con.fetchall())
    if found == wanted:
        return len(found[1]), None
    if found[0] != wanted[0]:
        return len(found[1]), f"columns {found[0]} != {wanted[0]}"
    a, b = set(found[1]), set(wanted[1])
    return len(found[1]), f"rows {len(found[1])} / {len(wanted[1])}; only here {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"


def main():
    from bindings import ORACLE, QUERIES
    from hearthline.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            n, problem = compare(spark, con, sf, fn, ORACLE.get(name))
        except Exception as e:
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        kind = "sql" if name in ORACLE else "rows only"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {n} rows {time.time() - began:.1f}s {kind} {problem or ''}", flush=True)
    print(f"{bad} of {len(QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
