"""Queries against their SQL on keys and places that only larger tables have."""

import duckdb
import pandas as pd
import pytest

from tidegrain import queries, queries_link, queries_rules, queries_spatial  # noqa: F401  they add to queries.QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Whether a query gives the rows of its SQL over sf0.001 with some tables replaced: {table: a DuckDB query}."""

    def check(name: str, **replaced: str) -> pd.DataFrame:
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            rows = replaced.get(t, "select * from base").replace("base", f"'{DATA}/{t}.parquet'")
            con.sql(f"copy ({rows}) to '{tmp_path}/{t}.parquet'")
            con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
        got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLES[name]).df()
        cols = sorted(want.columns)
        order = lambda df: df[cols].sort_values(cols, ignore_index=True)
        pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12)
        return got

    return check


def test_table_report_with_part_keys_of_six_digits(same_as_sql):
    got = same_as_sql("v3_table_report", lineitem="select * replace (l_partkey + 100000 * (l_orderkey % 3) as l_partkey) from base")
    assert got.n_rows[0] > 0


def test_disks_that_only_touch_a_box(same_as_sql):
    # episodes whose disks touch a box in a point or nearly, where areas are as good as the formula behind them
    got = same_as_sql(
        "g4_exact_overlap",
        supplier="select * replace (k::bigint as s_suppkey) from (select * from base limit 1) s, unnest([383, 1333, 2210, 2407, 4498, 5826, 5857]) t(k)",
        orders="select * replace (k::bigint as o_orderkey) from (select * from base limit 1) s, unnest([1123, 1722, 1816, 2316, 6160, 8577, 14961, 16843, 17378, 21123, 18706]) t(k)",
    )
    assert ((got.episode_id == 1722) & (got.unit == 1333)).any()
    pairs = got.groupby("episode_id").weight.apply(sorted)
    assert pairs[1123] == pairs[21123]  # one place
