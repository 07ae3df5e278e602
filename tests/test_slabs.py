"""Queries from slabs of whole histories: the same results as their relations, and little written on the way."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.functions import metrics
from tessera.operators import slabs
from tessera.operators.features import PRICE_FEATURES, price_features
from tessera.plans import catalog, driver_queries, evaluation_queries
from tessera.plans.sql import to_spark

BIG = "/root/testdata/sf0.1"
IC = ("feature_ic_table", "family_ic_rollup")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Lines of few names with gaps, missing values, prices that stand still, sink below a dollar or have no volume, and names of one bar."""
    rng, rows = np.random.default_rng(5), []
    for name in range(30):
        for week in range(120):
            if rng.random() < 0.25 or (name >= 27 and week != 40 + name):
                continue
            drop = 0.05 if name in (3, 4) else 0.0 if name == 5 else round(rng.integers(0, 11) / 100, 2)
            if name == 6 and 20 <= week < 60:
                continue
            rows.append((name * 7, pd.Timestamp("2000-01-03") + pd.Timedelta(weeks=week), None if rng.random() < 0.02 else drop, None if rng.random() < 0.02 else round(rng.integers(0, 9) / 100, 2), None if rng.random() < 0.02 else 0.0 if name == 8 else float(rng.integers(1, 51))))
    # A price under a dollar needs shocks that the weekly mean of one line allows.
    rows += [(900, pd.Timestamp("2000-01-03") + pd.Timedelta(weeks=w), -0.3 if w < 40 else 0.2, 0.02, 3.0) for w in range(120)]
    rows += [(None, pd.Timestamp("2000-01-05"), 0.03, 0.02, 5.0)]
    at = tmp_path_factory.mktemp("odd")
    df = pd.DataFrame(rows, columns=["l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_quantity"]).astype({"l_suppkey": "Int64"})
    df["l_shipdate"] = df["l_shipdate"].astype("datetime64[us]")
    df.to_parquet(at / "lineitem.parquet")
    return str(at)


def same(a: pd.DataFrame, b: pd.DataFrame, by: list[str], atol: float = 2e-6) -> None:
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b[list(a.columns)], check_dtype=False, rtol=0, atol=atol)


@pytest.mark.parametrize("name", IC)
def test_coefficients_from_slabs_are_those_of_the_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{odd}/lineitem.parquet'")
    same(catalog.queries()[name](spark, odd).toPandas(), con.execute(catalog.oracles()[name]).df(), ["feature" if name == IC[0] else "family"])


def test_features_of_slabs_are_those_of_the_relations(spark, odd, tmp_path):
    def text(c):
        price_features(c)
        return c.select(f"select symbol, t_idx, tradable, {', '.join(PRICE_FEATURES)} from feats where symbol is not null")

    want = to_spark(text)(spark, odd).toPandas()
    s = slabs.Slabs(spark, odd, str(tmp_path / "slabs"))
    for slab in slabs._unpack(iter(s.rows.toArrow().to_batches()), s.n_t, s.mkt):
        for i, symbol in enumerate(slab.symbols):
            rows = want[want["symbol"] == symbol].sort_values("t_idx")
            assert (rows["tradable"].to_numpy(bool) == slab["tradable"][:, i]).all()
            for n in PRICE_FEATURES:
                np.testing.assert_allclose(slab[n][:, i], rows[n].to_numpy(float), rtol=1e-7, atol=1e-8, err_msg=f"{n} of {symbol}")


@pytest.mark.parametrize("at", ["/root/testdata/sf0.01", "odd"])
def test_attribution_from_slabs_is_that_of_the_relations(spark, request, at):
    at = request.getfixturevalue(at) if at == "odd" else at
    names = evaluation_queries.SPREADS

    def text(c):
        evaluation_queries.variants(c)
        return c.select(f"select t_idx, {', '.join(f'''max(case when strategy = '{s}' then x end) as f_{s}''' for s in names)} from var group by t_idx")

    joined = driver_queries._daily(spark, at).join(to_spark(text)(spark, at), "t_idx")
    r = metrics.hac_ols(joined, "ret", [f"f_{s}" for s in names])
    got = driver_queries.attribution(spark, at).toPandas()
    if r is None:
        assert got.empty
    else:
        same(got, pd.DataFrame([(n, r["beta"][n], r["t"][n]) for n in r["beta"]], columns=["factor", "beta", "t"]), ["factor"], atol=1e-4)
    # Day by day, too: the book, its benchmark, and every spread.
    s = slabs.Slabs(spark, at, f"{request.getfixturevalue('tmp_path')}/slabs")

    def backtest(c):
        from tessera.operators import evaluation as E

        E.backtest(c, k=25, rb=5)
        return c.select("select * from bt")

    same(to_spark(backtest, **s.momentum_book(25, 5))(spark, at).toPandas(), driver_queries._daily(spark, at).toPandas(), ["t_idx"], atol=1e-9)
    want = to_spark(text)(spark, at).toPandas().melt("t_idx", var_name="strategy", value_name="x").dropna()
    want["strategy"] = want["strategy"].str.removeprefix("f_")
    same(s.spreads(names).toPandas().dropna(), want, ["strategy", "t_idx"], atol=1e-9)


@pytest.mark.parametrize("x", [[], [np.nan], [0.0, -1.0, np.nan, 255.0, 2.0**52], [0.1, np.nan, -1e300, np.inf]])
def test_doubles_come_back_from_their_bytes(x):
    x = np.array(x)
    kind, u = slabs.coded(x)
    np.testing.assert_array_equal(slabs.spread(slabs.squeezed(kind, u), x.shape), x)


def written(spark) -> dict[int, int]:
    """Bytes that every stage so far has written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("name", ["factor_attribution", "feature_ic_table", "family_ic_rollup"])
def test_shuffles_stay_below_four_times_the_input(spark, name):
    before = written(spark)
    assert catalog.queries()[name](spark, BIG).count()
    assert sum(n for k, n in written(spark).items() if k not in before) < 4 * os.path.getsize(f"{BIG}/lineitem.parquet")
