"""Compare queries with their SQL on one data directory: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def compare(spark, sf_dir: str, name: str, query, sql: str | None):
    df = query(spark, sf_dir)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(mine), None, None
    names, rows = oracle_rows(sf_dir, sql)
    theirs = normal(rows, names)
    same = sorted(names) == sorted(df.columns) and mine == theirs
    first = next(((a, b) for a, b in zip(mine, theirs) if a != b), (sorted(names), sorted(df.columns))) if not same else None
    return len(mine), len(theirs), first


if __name__ == "__main__":
    import __spark_entry__ as e
    from tracelode.session import build_session

    s = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            n, m, first = compare(s, sys.argv[1], name, queries[name], sqls.get(name))
            print(name, n, m, "OK" if m is not None and first is None else "rows only" if m is None else f"DIFFER {first}", f"{time.time() - t:.1f}s", flush=True)
        except Exception as err:  # noqa: BLE001
            print(name, "FAILED", str(err)[:1500], flush=True)
