"""Runs a query and its SQL over the same tables and compares their rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _value(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if type(v).__name__.startswith(("int", "uint")):
        return int(v)
    if type(v).__name__.startswith("float"):
        return int(v) if float(v).is_integer() else round(float(v), 9)
    return str(v)


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(map(_value, r)) for r in frame[names].itertuples(index=False, name=None)), key=str)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    ours = query(spark, sf_dir).toPandas()
    theirs = connect(sf_dir).execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
