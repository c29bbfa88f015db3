"""Every query with SQL gives what another engine gives, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from missive.plans import registry

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5)
        return v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, other, name):
    got = rows(registry.queries()[name](spark, FOLDER).toPandas())
    assert got == rows(other.execute(registry.oracle_sql()[name]).df())
