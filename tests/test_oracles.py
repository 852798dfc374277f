"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidegrain import queries, queries_link, queries_rules, queries_spatial  # noqa: F401  they add to queries.QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, con, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    order = lambda df: df[cols].sort_values(cols, ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12)
