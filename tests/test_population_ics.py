"""Coefficients of a population from slabs: those of the relations, and no panel on the way."""

from test_slab_scores import TREES
from test_slabs import odd, same  # noqa: F401

from tessera.operators import evaluation as E
from tessera.operators import expression as X
from tessera.operators import search, slab_scores
from tessera.operators.features import price_features
from tessera.operators.slabs import Slabs
from tessera.plans import driver_queries
from tessera.plans.sql import to_spark
from tessera.sources import panel as P

ALL = {f"s_{t.fingerprint()}": t for t in TREES}


def test_coefficients_are_those_of_the_relations(spark, odd, tmp_path):  # noqa: F811
    def text(c):
        price_features(c)
        c.kept.add(X.compile_population(c, "feats", ALL))
        c.add("long_scores", " union all ".join(f"select '{k}' as id, symbol, t_idx, round({k}, 8) as x from scored" for k in ALL))
        E.ic_series(c, "long_scores", "x", "pic", h=5, least=10, key="id")
        return c.select("select g as id, t_idx, ic, n from pic")

    want = to_spark(text)(spark, odd).toPandas()
    got = slab_scores.coefficients(Slabs(spark, odd, f"{tmp_path}/bars"), str(tmp_path), ALL, 5, 10).toPandas()
    assert want["id"].nunique() >= len(ALL) - 1  # ranks among equal names have ties broken by symbol, so they count, too
    same(got, want, ["id", "t_idx"], atol=1e-9)


def test_no_panel_is_formed(spark, small, monkeypatch):
    def never(*_):
        raise AssertionError("scores come from slabs")

    monkeypatch.setattr(P, "panel", never)
    trees = {"s_a": X.feat("mom_5"), "s_b": X.un("rank", X.un("zscore", X.feat("clv")))}
    assert set(search.score_population(spark, small, trees)) == set(trees)
    assert driver_queries.evolution(spark, small).columns == ["size_bin", "n_features", "expression", "fitness"]
