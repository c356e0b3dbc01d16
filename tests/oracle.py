"""Run registered queries next to their SQL in DuckDB and compare whole results.

Usage: python tests/oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, float):
            return None if v != v else (float(f"{v:.9g}") + 0.0)
        if isinstance(v, bool):
            return v
        return v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, function, sql: str | None):
    """(ok, message) for one query."""
    df = function(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} vs {len(b)} rows, first differences {diff}"
    return True, f"{len(a)} rows"


def main() -> int:
    from punctua.session import build_session

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), e.oracle_sql(), 0
    for name, function in e.queries().items():
        if wanted and not any(name.startswith(p) for p in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, name, function, sqls.get(name))
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
