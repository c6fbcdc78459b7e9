"""Rows of a query and of its SQL twin, made comparable."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(norm(v.asDict(True) if hasattr(v, "asDict") else v) for v in r) for r in df.select(*(f"`{c}`" for c in names)).collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    r = con.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())
