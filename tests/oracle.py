"""Compare a query's rows with DuckDB's over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr(tuple(_plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(spark, query, sql: str, sf_dir: str) -> None:
    c = duckdb.connect()
    for f in glob.glob(sf_dir + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = c.execute(sql).df(), query(spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
