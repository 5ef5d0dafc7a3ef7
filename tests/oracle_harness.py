"""Compare a registered Spark query with its DuckDB oracle (driver-style)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def compare(spark, key: str, sf_dir: str, fn, sql: str) -> dict:
    sdf = fn(spark, sf_dir)
    scols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in scols) for r in sdf.collect()]
    rel = duck(sf_dir).sql(sql)
    dcols = list(rel.columns)
    drows_raw = rel.fetchall()
    idx = [dcols.index(c) if c in dcols else None for c in scols]
    res = {"key": key, "spark_rows": len(srows), "oracle_rows": len(drows_raw),
           "cols_match": sorted(dcols) == scols}
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = scols, sorted(dcols)
        res["ok"] = False
        return res
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    cs, cd = Counter(srows), Counter(drows)
    res["ok"] = cs == cd
    if not res["ok"]:
        res["only_spark"] = list((cs - cd).elements())[:3]
        res["only_oracle"] = list((cd - cs).elements())[:3]
    return res


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import time

    import __spark_entry__ as E
    from triagekit.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = get_session("local[8]")
    Q, O = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or list(Q)):
        t = time.time()
        if k not in O:
            n = Q[k](spark, sf).count()
            print(f"{k:28s} rows-only {n} ({time.time()-t:.1f}s)")
            continue
        try:
            r = compare(spark, k, sf, Q[k], O[k])
        except Exception as ex:  # report and continue
            r = {"key": k, "ok": False, "error": repr(ex)[:500]}
        bad += not r["ok"]
        print(f"{k:28s} {'OK ' if r['ok'] else 'BAD'} {r} ({time.time()-t:.1f}s)", flush=True)
    print("failures:", bad)
