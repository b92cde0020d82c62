"""Run queries next to their SQL twins: python tests/oracle_check.py SF_DIR [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_df, con, sql):
    got = canon(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = canon([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        extra = set(got[1]) - set(want[1])
        miss = set(want[1]) - set(got[1])
        return f"rows {len(got[1])} != {len(want[1])}; extra {list(extra)[:2]} missing {list(miss)[:2]}", len(got[1])
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {bad[:2]}", len(got[1])
    return None, len(got[1])


def types(spark_df, con, sql):
    rel = con.sql(sql)
    kind = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    return {c: (t, theirs.get(c)) for c, t in spark_df.dtypes if kind.get(t, t) != theirs.get(c)}


if __name__ == "__main__":
    from engram.session import local_session
    from engram.plans.catalog import ORACLE, QUERIES
    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf)
    fails = []
    for name in names or QUERIES:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                err, n = compare(df, con, ORACLE[name])
                ty = types(df, con, ORACLE[name])
                note = f" types {ty}" if ty else ""
            else:
                err, n, note = None, len(df.collect()), " (rows only)"
        except Exception as e:  # report and go on
            err, n, note = f"{type(e).__name__}: {str(e)[:600]}", 0, ""
        state = "ok  " if err is None else "FAIL"
        print(f"{state} {name:24s} {n:8d} rows {time.time() - t0:6.1f}s{note}{' ' + err if err else ''}", flush=True)
        if err:
            fails.append(name)
    print("failed:", fails)
