"""Run each registered query on Spark and its SQL on DuckDB; compare rows, schema and values.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v


def _rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(t[i]) for i in order) for t in tuples]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in r))


def _kind_spark(t) -> str:
    s = t.simpleString()
    if s in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if s in ("double", "float") or s.startswith("decimal"):
        return "float"
    if s.startswith("timestamp"):
        return "timestamp"
    return s


def _kind_duck(t: str) -> str:
    t = t.upper()
    if t in ("BIGINT", "INTEGER", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER"):
        return "int"
    if t in ("DOUBLE", "FLOAT") or t.startswith("DECIMAL"):
        return "float"
    if t.startswith("TIMESTAMP"):
        return "timestamp"
    return {"VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}.get(t, t.lower())


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_names = sdf.columns
    s_kinds = {f.name: _kind_spark(f.dataType) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_names = rel.columns
    d_kinds = {n: _kind_duck(str(t)) for n, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    t2 = time.time()
    res = {
        "query": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
        "names_match": sorted(s_names) == sorted(d_names),
        "schema_match": s_kinds == d_kinds,
        "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2),
    }
    res["values_match"] = res["names_match"] and _rows(s_names, s_rows) == _rows(d_names, d_rows)
    res["ok"] = res["names_match"] and res["schema_match"] and res["values_match"]
    if not res["schema_match"]:
        res["spark_schema"], res["oracle_schema"] = s_kinds, d_kinds
    return res


def main(argv):
    from streamwatch.session import get_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        if n not in sqls:
            print({"query": n, "oracle": "none"})
            continue
        try:
            r = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        except Exception as e:  # report and continue
            r = {"query": n, "ok": False, "error": repr(e)[:800]}
        bad += not r["ok"]
        print(r, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
