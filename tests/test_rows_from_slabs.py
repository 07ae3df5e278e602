"""Columns of the dense panel from slabs, and quantiles of many windows at once."""

import contextlib
import io

import duckdb
import numpy as np
import pytest

from tessera.operators import slabs as S
from tessera.plans import catalog, series_queries


@pytest.mark.parametrize("name", ["features_reversal", "features_volatility", "ema_macd"])
def test_no_panel_is_sorted(spark, small, name):
    df = catalog.queries()[name](spark, small)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    assert not [w for w in ("Window", "Exchange", "Join", "Sort") if w in plan.getvalue()]
    assert df.count() == 10 * 357


def test_moving_average_holds_over_gaps():
    x = np.array([[np.nan, 1.0], [2.0, np.nan], [np.nan, 4.0], [5.0, np.nan]])
    np.testing.assert_allclose(S.ema(x, 3), [[np.nan, 1], [2, 1], [2, 2.5], [3.5, 2.5]])


def test_quantiles_of_many_windows_at_once(monkeypatch):
    x = np.random.default_rng(1).normal(size=(500, 21)).round(2)
    x[np.random.default_rng(2).random(x.shape) < 0.4] = np.nan
    x[0], x[1, 1:] = np.nan, np.nan
    want = np.full(500, np.nan)
    want[1:] = np.nanquantile(x[1:], 0.9, axis=1) - np.nanquantile(x[1:], 0.1, axis=1)
    monkeypatch.setattr(np, "nanquantile", None)  # it takes windows one by one
    np.testing.assert_allclose(series_queries.quantile_range(x, 1), want, atol=1e-12)


@pytest.mark.parametrize("name", ["features_reversal", "features_volume"])
def test_lines_without_a_name(spark, small, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"create table lineitem as select * replace (case when l_orderkey % 9 > 0 then l_suppkey end as l_suppkey) from '{small}/lineitem.parquet'")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    ours = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    theirs = con.execute(catalog.oracles()[name]).df()[list(ours.columns)]
    assert ours["symbol"].isna().any() and len(ours) == len(theirs)
    a, b = (x.sort_values(["symbol", "t_idx"]).to_numpy(float) for x in (ours, theirs))
    np.testing.assert_allclose(a, b, atol=1e-9)
