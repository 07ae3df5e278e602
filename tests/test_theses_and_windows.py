"""Theses on arrays of tickers, and windows by any function, against loops in numpy."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.rolling import roll_apply
from tessera.plans import relation_queries as R
from tessera.plans.sql import to_spark
from tessera.sources import panel as P
from tessera.sources import readers

BIG = "/root/testdata/sf0.01"


def panel(spark):
    def text(c):
        P.returns(c)
        return c.select("select symbol, t_idx, date, ret, tradable from rets")

    df = to_spark(text)(spark, BIG).toPandas()
    wide = {c: df.pivot(index="t_idx", columns="symbol", values=c) for c in ("ret", "tradable")}
    dates = pd.to_datetime(df.groupby("t_idx")["date"].first().sort_index()).to_numpy()
    return wide["ret"].to_numpy(float), wide["tradable"].to_numpy(bool), list(wide["ret"].columns), dates


def excess(ret, ok, names, tickers, lo, hi):
    cols = [names.index(t) for t in tickers if t in names]
    if not cols or hi - lo < 20:
        return None
    before = np.vstack([np.zeros((1, ok.shape[1]), bool), ok[:-1]])
    bench = (before * ret).sum(1) / np.maximum(before.sum(1), 1)
    held = before[lo:hi][:, cols].copy()
    held[0] = False
    basket = (held * ret[lo:hi][:, cols]).sum(1) / np.maximum(held.sum(1), 1)

    def ann(x):
        return np.prod(1 + x) ** (252 / len(x)) - 1

    return ann(basket) - ann(bench[lo:hi])


def test_stored_theses_are_scored_on_both_sides_of_their_day(spark, tmp_path):
    ret, ok, names, dates = panel(spark)
    day = [str(d)[:10] for d in dates]
    claims = [{"id": "a", "statement": "x", "proxy": {"tickers": ["3", "11", "3", "999999"]}}, {"id": "b", "statement": "y", "proxy": None}, {"id": "c", "proxy": {"tickers": ["999999"]}}]
    store = {"updated": "now", "theses": [
        {"id": "old", "captured": day[3], "claims": [{"id": "z", "proxy": {"tickers": ["1"]}}]},
        {"id": "mid", "captured": day[200], "claims": claims},
        {"id": "late", "recorded": f"{day[345]}T10:00:00", "claims": claims[:1]},
        {"id": "ahead", "captured": "2030-01-01", "claims": claims[:1]},
        {"id": "bare", "captured": day[5], "claims": []},
        {"id": "old", "captured": day[10], "claims": [{"id": "z", "proxy": {"tickers": ["5", "7"]}}]},
    ]}
    path = tmp_path / "theses.json"
    path.write_text(json.dumps(store))
    rows = readers.theses(spark, str(path))
    assert sorted((r["thesis"], r["claim"]) for r in rows.collect()) == [("ahead", "a"), ("late", "a"), ("mid", "a"), ("mid", "b"), ("mid", "c"), ("old", "z")]

    def text(c):
        R.thesis_scores(c)
        return c.select("select * from ths")

    given = rows.select(F.concat_ws("/", "thesis", "claim").alias("thesis"), F.transform("tickers", lambda t: t.cast("long")).alias("tickers"), "since")
    got = to_spark(text, thesis=given)(spark, BIG).toPandas().set_index("thesis")
    n = len(dates)
    for key, tickers, at in (("mid/a", [3, 11, 999999], 200), ("mid/b", [], 200), ("mid/c", [999999], 200), ("late/a", [3, 11], 345), ("ahead/a", [3, 11], n), ("old/z", [5, 7], 10)):
        row = got.loc[key]
        assert row["sessions"] == n - at
        for col, lo, hi in (("trailing_x", max(0, at - 252), at), ("forward_x", at, n)):
            want = excess(ret, ok, names, tickers, lo, hi)
            assert pd.isna(row[col]) if want is None else row[col] == pytest.approx(want, abs=1e-9), (key, col)
        forward = excess(ret, ok, names, tickers, at, n)
        assert row["verdict"] == ("too early" if forward is None else "holding" if forward > 0.02 else "not holding" if forward < -0.02 else "flat")
    assert got.loc["mid/b", "named"] == 0 and got.loc["mid/a", "named"] == 3


@pytest.mark.parametrize("past", [True, False])
def test_windows_by_any_function(spark, past):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(s, t, None if np.isnan(x[t, s]) else float(x[t, s]), "k") for s in range(4) for t in range(50)]
    df = spark.createDataFrame(rows, "symbol long, t_idx int, x double, other string")
    functions = {"last_less_first": lambda a, axis: a[:, -1] - a[:, 0], "spread": lambda a, axis: np.nanmax(a, axis=axis) - np.nanmin(a, axis=axis), "infinite": lambda a, axis: np.nansum(a, axis=axis) / 0.0}
    for name, fn in functions.items():
        got = roll_apply(df, F.col("x"), fn, 7, "y", past=past).toPandas()
        assert list(got.columns) == ["symbol", "t_idx", "x", "other", "y"] and len(got) == 200
        y = got.pivot(index="t_idx", columns="symbol", values="y").to_numpy(float)
        for t in range(50):
            lo = t - 7 if past else max(0, t - 6)
            want = np.full(4, np.nan)
            if lo >= 0:
                with np.errstate(all="ignore"):
                    want = fn(x[lo : t if past else t + 1].T, axis=1)
            want[~np.isfinite(want)] = np.nan
            assert np.allclose(y[t], want, equal_nan=True), (name, t)
    assert roll_apply(df.limit(0), F.col("x"), functions["spread"], 7, "y").collect() == []
