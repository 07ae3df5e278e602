"""Populations from slabs: the picks of the relations, and no dense panel on the way."""

import pytest
from test_slabs import odd, same  # noqa: F401

from tessera.operators import expression as X
from tessera.operators import population as N
from tessera.operators import slab_scores
from tessera.operators.features import price_features
from tessera.operators.genome import Genome
from tessera.operators.slabs import Slabs
from tessera.plans import catalog
from tessera.plans import population_queries as Q
from tessera.plans.sql import Chain, Dialect, to_spark

A, B, V = X.feat("mom_5"), X.feat("clv"), X.feat("vol_10")
RANK = X.un("rank", B)
TREES = [
    X.un("rank", A),
    X.un("tsmean", X.un("rank", X.un("tsstd", RANK, 5)), 10),  # a rank of a rank
    X.bi("add", X.un("rank", X.bi("sub", RANK, X.const(0.5))), X.un("zscore", X.un("demean", A))),
    X.un("zscore", X.un("delta", V, 5)),
    X.bi("min", A, X.bi("max", X.feat("mom_252"), X.un("tsrank", B, 10))),  # a missing side is passed over
    X.ite(X.bi("sub", A, V), X.un("sigmoid", B), X.un("neg", X.un("demean", RANK))),
    X.bi("div", X.un("log1p", A), X.un("sqrt_abs", X.un("square", X.bi("mul", B, V)))),
    X.un("rank", X.const(1.0)),  # all tied
    X.bi("div", X.un("zscore", X.bi("max", X.const(2.93), X.feat("rev_21"))), X.un("square", X.feat("pct_52w_range"))),  # nearly all equal
]
GENOMES = [Genome(t, k, rb, how) for t, k, rb, how in zip(TREES, (10, 15, 20, 25, 10, 15, 20, 10, 50), (1, 2, 5, 10, 21, 5, 2, 5, 10), ("equal", "score") * 5, strict=False)]


def test_picks_and_days_from_slabs_are_those_of_the_relations(spark, odd, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(slab_scores, "BLOCK", 1)  # ranks of a level in several passes

    def text(select):
        def build(c):
            price_features(c)
            N.evaluate(c, "feats", GENOMES, folds=2)
            return c.select(select)

        return build

    picks, days = text("select strategy, f, blk, symbol, w from pick"), text("select strategy, f, t_idx, ret, bench, turnover, trades from day")
    s = Slabs(spark, odd, f"{tmp_path}/bars")
    given = slab_scores.books(s, str(tmp_path), {g.id: g.tree for g in GENOMES}, Q.rebalances(spark, odd, picks, s.sessions))
    for q, by in ((picks, ["strategy", "f", "blk", "symbol"]), (days, ["strategy", "f", "t_idx"])):
        got, want = (to_spark(q, **g)(spark, odd).toPandas() for g in (given, {}))
        assert set(want["strategy"]) == {g.id for g in GENOMES}
        same(got, want, by, atol=1e-6)


@pytest.mark.parametrize("name", list(Q.GENOMES))
def test_no_dense_panel_is_formed(spark, small, name, monkeypatch):
    """Of the relations that grow with the names, only those given from slabs are read."""
    seen = []

    def spy(text, **given):
        def run(spark, sf_dir):
            c = Chain(Dialect(sf_dir))
            for n in given:
                c.add(n, "select 1")
            text(c)
            seen.append(set(c.reached(c.final)))
            return spark.range(0)

        return run

    monkeypatch.setattr(Q, "to_spark", spy)
    catalog.queries()[name](spark, small)
    assert seen and not seen[0] & {"bars", "dense", "panel", "feats1", "feats", "scored", "lng_all"}


def test_levels_leave_out_a_rank_at_the_root():
    got = slab_scores.crossings({"a": X.un("rank", A), "b": X.un("rank", X.un("tsmean", RANK, 5)), "c": X.un("demean", RANK)})
    assert [[n.canonical() for n in level] for level in got] == [["rank(clv)"], ["demean(rank(clv))"]]
