"""Run a registered query in Spark and its SQL twin in DuckDB; compare.

Mirrors the driver's check: row count, column names, and an
order-insensitive multiset of rows with columns sorted by name.
Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, tol):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, tol) if tol is not None else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, tol) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x, tol) for x in v)
    return v


def rows_of(cols, rows, tol=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], tol) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    o_cols = [c[0] for c in cur.description]
    o_rows = cur.fetchall()
    res["oracle_rows"] = len(o_rows)
    if sorted(s_cols) != sorted(o_cols):
        res["status"] = f"COLUMNS spark={sorted(s_cols)} oracle={sorted(o_cols)}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    if a == b:
        res["status"] = "exact"
    elif rows_of(s_cols, s_rows, 6) == rows_of(o_cols, o_rows, 6):
        res["status"] = "approx6"
    else:
        res["status"] = "MISMATCH"
        sa, sb = set(a), set(b)
        res["only_spark"] = [x for x in a if x not in sb][:3]
        res["only_oracle"] = [x for x in b if x not in sa][:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from parlance.session import get_session
    import __spark_entry__ as ent
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = ent.queries(), ent.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("exact", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs)} queries, {bad} not exact")


if __name__ == "__main__":
    main(sys.argv)
