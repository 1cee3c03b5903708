"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import math
import os
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if isinstance(v, Decimal) else v


def database(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    other = database(sf_dir).sql(sql)
    assert sorted(other.columns) == names
    at = [other.columns.index(n) for n in names]
    left = sorted(repr(tuple(plain(r[n]) for n in names)) for r in got.collect())
    right = sorted(repr(tuple(plain(r[i]) for i in at)) for r in other.fetchall())
    assert left == right
