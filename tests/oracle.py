"""Run registered queries beside their SQL and compare the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

#: Queries that SQL cannot express; their own tests compare them with plain versions.
NO_SQL = re.compile(r"op\d+_|pipeline$")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir, name):
    """(message, row count): an empty message means both sides agree."""
    df = contract.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "" if NO_SQL.match(name) else "there is no SQL to compare with", len(got)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(got)
    a, b = _rows(df.columns, got), _rows(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(got)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}", len(got)
        if [type(v) for v in x] != [type(v) for v in y] and None not in x:
            return f"types {x} != {y}", len(got)
    return "", len(got)


if __name__ == "__main__":
    from logloom.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    names = [n for n in contract.queries() if not args or any(a in n for a in args)]
    for n in names:
        t = time.time()
        try:
            msg, rows = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001
            msg, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(msg)
        grade = "ok " if not msg else "BAD"
        print(f"{grade} {n:32s} {rows:7d} rows {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
