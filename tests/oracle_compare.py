"""Side-by-side check of a registered Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive hash of the
values (columns sorted by name, floats compared as printed with 6 decimals).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return f"{float(v):.6f}"
    except Exception:
        pass
    return str(v)


def digest(cols, rows) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows)}
    if sql is None:
        out["match"] = None
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out["duck_rows"] = len(d_rows)
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    out["hash_match"] = digest(s_cols, s_rows) == digest(d_cols, d_rows)
    out["match"] = out["cols_match"] and out["hash_match"] and len(s_rows) == len(d_rows)
    if not out["match"]:
        out["spark_cols"] = s_cols
        out["duck_cols"] = d_cols
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ls = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        ld = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        diff_s = [x for x in ls if x not in set(ld)][:3]
        diff_d = [x for x in ld if x not in set(ls)][:3]
        out["only_spark"] = diff_s
        out["only_duck"] = diff_d
    return out


def main():
    import json
    import time

    from matchspark.session import local_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = local_session(8)
    qs = entry.queries()
    oracle = entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            r = compare(spark, name, qs[name], oracle.get(name), sf_dir, con)
        except Exception as ex:  # report and continue
            r = {"name": name, "error": repr(ex)[:500]}
        r["sec"] = round(time.time() - t, 2)
        if r.get("match") is False or "error" in r:
            bad += 1
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"failed": bad}))


if __name__ == "__main__":
    main()
