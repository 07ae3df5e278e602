"""Strategies from slabs: their plans read no panel, and the pick's curves neither."""

import numpy as np
import pytest

from tessera.operators import slab_signals as G
from tessera.operators.slabs import Slab
from tessera.plans import catalog, driver_queries, strategy_queries
from tessera.session import cut


def test_every_ranked_strategy_has_forms():
    own = {id for id, s in strategy_queries.REGISTRY.items() if "bk" in _parts(s)}
    assert own == set(strategy_queries.FORMS)


def _parts(s):
    from tessera.plans.sql import Chain, Dialect

    c = Chain(Dialect("x"))
    s.text.build(c)
    return c.parts


def test_beta_and_residual_by_loops():
    rng = np.random.default_rng(4)
    close = np.exp(np.cumsum(rng.normal(0, 0.02, (40, 3)), axis=0))
    s = Slab(np.arange(3), np.stack([close]), names=("close",))
    s.made["mk"] = rng.normal(0, 0.01, (40, 1))
    b, e = G.beta(10)(s), G.residual(10)(s)
    assert np.isnan(b[:10]).all() and np.isnan(e[:10]).all()
    for t in range(10, 40):
        for j in range(3):
            y, x = s["ret"][t - 10 : t, j], s.made["mk"][t - 10 : t, 0]
            cov = np.mean((y - y.mean()) * (x - x.mean()))
            assert b[t, j] == pytest.approx(cov / x.var())
            assert e[t, j] == pytest.approx(np.sqrt(max(y.var() - cov**2 / x.var(), 0)))


@pytest.mark.parametrize("name", ["stk_bab", "cry_trend", "multiple_testing_summary"])
def test_books_alone_are_written(spark, small, monkeypatch, name):
    wrote = []

    def counted(df):
        out = cut(df)
        wrote.append(set(out.columns))
        return out

    for module in (strategy_queries, __import__("tessera.plans.sql", fromlist=["cut"])):
        monkeypatch.setattr(module, "cut", counted)
    catalog.queries()[name](spark, small).count()
    assert wrote and not [w for w in wrote if {"symbol", "t_idx", "close"} <= w]


def test_pick_reads_no_panel(spark, small, monkeypatch):
    def never(*_):
        raise AssertionError("the curves come from slabs")

    monkeypatch.setattr(driver_queries.evaluation_queries, "variants", never)
    assert driver_queries.decorrelated_pick(spark, small).columns == ["place", "strategy", "t"]
