"""Filings, peers and macro series beside slabs: no row for every concept, session and name is written."""

import duckdb
import numpy as np
import pytest

from tessera import session
from tessera.operators import filings, slabs
from tessera.plans import catalog, coefficient_queries, feature_queries

DAYS = np.arange(6.0)


def test_steps_hold_and_missing_ones_count():
    import pyarrow as pa

    s = slabs.Slab(np.array([3, 9]), np.ones((1, 6, 2)), names=("close",))
    row = {f"v{i}": None for i in range(7)}
    rows = [  # a later missing figure hides the one before it; of two on a session the later day counts
        {"kind": filings.STOCK, "symbol": 9, "day": 1, "t0": 1, **row, "v0": 4.0},
        {"kind": filings.STOCK, "symbol": 9, "day": 5, "t0": 3, **row, "v0": 7.0},
        {"kind": filings.STOCK, "symbol": 9, "day": 4, "t0": 3, **row, "v0": 8.0},
        {"kind": filings.STOCK, "symbol": 9, "day": 6, "t0": 5, **row},
        {"kind": filings.ANNUAL, "symbol": 3, "day": 2, "t0": 2, **row, "v0": 5.0},
    ]
    schema = pa.schema([("kind", pa.int32()), ("symbol", pa.int64()), ("day", pa.int32()), ("t0", pa.int32()), *((f"v{i}", pa.float64()) for i in range(7))])
    filings.opened(DAYS)(s, pa.Table.from_pylist(rows, schema=schema))
    np.testing.assert_array_equal(s["assets"][:, 1], [np.nan, 4, 4, 7, 7, np.nan])
    np.testing.assert_array_equal(s["revenue"][:, 0], [np.nan, np.nan, 5, 5, 5, 5])
    assert np.isnan(s["assets"][:, 0]).all() and np.isnan(s["f_days_since_filing"]).all()


@pytest.mark.parametrize("name", ["feature_ic_all", "features_fundamental"])
def test_no_row_a_session_and_name_is_written(spark, small, monkeypatch, name):
    wrote = []

    def counted(df):
        out = session.cut(df)
        wrote.append(set(out.columns))
        return out

    for module in (slabs, feature_queries, coefficient_queries, __import__("tessera.plans.sql", fromlist=["cut"])):
        monkeypatch.setattr(module, "cut", counted)
    catalog.queries()[name](spark, small).count()
    assert wrote and not [w for w in wrote if {"symbol", "t_idx"} <= w]


@pytest.mark.parametrize("name", ["features_fundamental"])
def test_lines_without_a_name(spark, small, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"create table lineitem as select * replace (case when l_orderkey % 9 > 0 then l_suppkey end as l_suppkey) from '{small}/lineitem.parquet'")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"create table orders as select * from '{small}/orders.parquet'")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    ours = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    theirs = con.execute(catalog.oracles()[name]).df()[list(ours.columns)]
    assert ours["symbol"].isna().any() and len(ours) == len(theirs)
    a, b = (x.sort_values(["symbol", "t_idx"]).to_numpy(float) for x in (ours, theirs))
    np.testing.assert_allclose(a, b, atol=1e-9)
