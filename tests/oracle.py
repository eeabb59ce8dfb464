"""Compares a query's result with its SQL run by DuckDB over the same tables: columns, row count and values, in any order."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "\x00" if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names, kinds = [d[0] for d in got.description], [str(d[1]) for d in got.description]
    return names, kinds, got.fetchall()


def compare(df, sql, sf_dir):
    names, kinds, data = run_sql(sql, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    other = rows(names, data)
    assert mine[0] == other[0], (mine[0], other[0])
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    for name, kind in df.dtypes:
        theirs = kinds[names.index(name)]
        assert same.get(kind, theirs) in (theirs, {"NUMBER": "BIGINT", "STRING": "VARCHAR", "bool": "BOOLEAN"}.get(theirs, theirs)), (name, kind, theirs)
    if mine[1] != other[1]:
        a, b = set(mine[1]), set(other[1])
        raise AssertionError((len(mine[1]), len(other[1]), sorted(a - b)[:3], sorted(b - a)[:3]))
    return len(mine[1])
