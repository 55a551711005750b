"""Hold a query's rows against SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def sql_rows(sf_dir: str, sql: str):
    with duckdb.connect() as c:
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        found = c.sql(sql)
        order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
        return [found.columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v
