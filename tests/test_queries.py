"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewater import plans
from tidewater.plans import registry
from tidewater.sources.tables import TABLES

plans.load()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist") and not isinstance(value, pd.Timestamp):
        value = value.tolist()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return int(value)
    return float(f"{value:.9g}") if isinstance(value, (int, float)) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.SQL:
        assert len(found.columns) > 0
        return
    wanted = duck.execute(registry.SQL[name]).df()
    assert set(found.columns) == set(wanted.columns)
    assert rows(found) == rows(wanted)
