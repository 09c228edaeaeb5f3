"""Spark results against DuckDB on the same Parquet tables."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/"


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _value(x)) for k, x in v.items()))
    if isinstance(v, (float, int)):
        return round(float(v), 6)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf="sf0.01"):
    con = duckdb.connect()
    for p in Path(DATA, sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def compare(spark, name, sf="sf0.01"):
    import __spark_entry__ as e

    df = e.queries()[name](spark, DATA + sf)
    columns, rows = duck(e.oracle_sql()[name], sf)
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]
    return len(got)
