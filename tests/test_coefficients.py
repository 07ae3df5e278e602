"""Coefficients of all eighty features, by pandas and by their reasons."""

import numpy as np
import pytest

from tessera.operators import evaluation as E
from tessera.operators.features import FAMILIES
from tessera.plans import catalog
from tessera.plans import coefficient_queries as Q
from tessera.plans.sql import to_spark

BIG = "/root/testdata/sf0.01"


def test_every_feature_has_a_coefficient_or_a_reason(spark):
    got = catalog.queries()["feature_ic_all"](spark, BIG).toPandas().set_index("feature")
    assert len(Q.FEATURES) == 80 and set(got.index) == set(Q.FEATURES) and set(got["family"]) == set(FAMILIES)
    macro = got[got["family"] == "macro"]
    assert len(macro) == 16 and set(macro["reason"]) == {"constant"} and macro["mean_ic"].isna().all()
    assert ((got["reason"] == "ok") == got["mean_ic"].notna()).all()

    def text(c):
        Q.others(c)
        E.ic_series(c, "ofw", "macd_hist", "z")
        return c.select("select o.symbol, o.t_idx, o.macd_hist, o.f_roa, o.peer_rel_mom_21, f.fwd from ofw o join fwd_h f on f.symbol = o.symbol and f.t_idx = o.t_idx where f.tradable and f.fwd is not null")

    df = to_spark(text)(spark, BIG).toPandas()
    for name in ("macd_hist", "f_roa", "peer_rel_mom_21"):
        ics = []
        for _, day in df.dropna(subset=[name]).groupby("t_idx"):
            x, y = day[name].round(8).rank(), day["fwd"].rank()
            if len(day) >= 20 and x.std() > 0 and y.std() > 0:
                ics.append(np.corrcoef(x, y)[0, 1])
        if len(ics) < 60:
            assert got.loc[name, "reason"] == "too few sessions"
            continue
        assert got.loc[name, "n"] == len(ics) and got.loc[name, "mean_ic"] == pytest.approx(np.mean(ics), abs=2e-6), name
        assert got.loc[name, "t_stat"] == pytest.approx(np.mean(ics) / np.std(ics, ddof=1) * np.sqrt(len(ics) / 5), abs=2e-5)
