"""Compare a query with its SQL in DuckDB, as sets of rows with columns in order of name."""

import datetime
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        at = f"{d}/{f}" + ("/*.parquet" if os.path.isdir(f"{d}/{f}") else "")
        con.sql(f"create view {f.split('.')[0]} as select * from '{at}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows(data):
    return sorted((tuple(plain(x) for x in r) for r in data), key=repr)


def check(spark, d, query, sql):
    df = query(spark, d)
    cols = sorted(df.columns)
    con = connect(d)
    expected = con.sql(sql)
    assert cols == sorted(expected.columns)
    names = ",".join(f'"{c}"' for c in cols)
    assert rows(df.select(cols).collect()) == rows(con.sql(f"select {names} from ({sql})").fetchall())
