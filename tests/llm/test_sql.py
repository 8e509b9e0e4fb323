"""The operators that SQL states, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidewater.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = con.execute(llm.SQL[name])
    columns = [c[0] for c in wanted.description]
    plain = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in rows)
    found = llm.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.select(*columns).collect()) == plain(wanted.fetchall())
