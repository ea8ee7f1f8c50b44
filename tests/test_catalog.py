"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from spindrift.plans.catalog import ORACLES, QUERIES


def shaped(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind == "f":
            df[c] = df[c].astype(float).round(6)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else v)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        pd.testing.assert_frame_equal(shaped(got), shaped(duck.execute(ORACLES[name]).df()), check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
