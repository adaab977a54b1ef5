"""Run registered Spark queries and their DuckDB oracle side by side.

Mirrors the driver's check: same column names, same row count and an
order-insensitive comparison of all values (floats rounded).

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from revlens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bytes):
        return v.hex()
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
    ts = time.time() - t
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rows_of(d_cols, rel.fetchall())
    res = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows), "sec": round(ts, 2)}
    res["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    res["rows_ok"] = len(s_rows) == len(d_rows)
    res["values_ok"] = res["cols_ok"] and s_rows == d_rows
    if not res["values_ok"]:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
        diff_s = [r for r in s_rows if r not in set(d_rows)][:3]
        diff_d = [r for r in d_rows if r not in set(s_rows)][:3]
        res["diff"] = (diff_s, diff_d)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from revlens.plans.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    todo = names or sorted(qs)
    bad = 0
    for n in todo:
        if n not in sql:
            t = time.time()
            cnt = qs[n](spark, sf_dir).count()
            print(f"{n:28s} rows-only {cnt} ({time.time() - t:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, con, n, qs[n], sql[n], sf_dir)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{n:28s} ERROR {type(exc).__name__}: {str(exc)[:400]}", flush=True)
            continue
        ok = r["values_ok"]
        bad += not ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} rows {r['spark_rows']}/{r['duck_rows']} {r['sec']}s", flush=True)
        if not ok:
            print("    ", {k: v for k, v in r.items() if k in ("cols", "diff")}, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
