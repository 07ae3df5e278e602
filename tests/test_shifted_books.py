"""Replicas of the flagship from slabs: the books and days of the relations, and no panel on the way."""

import pytest
from test_slabs import odd, same  # noqa: F401

from tessera.operators import population as N
from tessera.operators import slabs
from tessera.plans import catalog, sql
from tessera.plans import population_queries as Q
from tessera.plans.sql import to_spark
from tessera.session import cut


@pytest.mark.parametrize("select, by", [("strategy, f, blk, symbol, w from pick", ["strategy", "f", "blk", "symbol"]), ("strategy, f, t_idx, ret, bench, turnover, trades from day", ["strategy", "f", "t_idx"])])
def test_books_and_days_are_those_of_the_relations(spark, odd, monkeypatch, select, by):  # noqa: F811
    monkeypatch.setattr(Q, "BOOK", 7)  # fewer than the names that there are
    monkeypatch.setattr(Q, "SHIFTS", 6)
    pieces, whole = N.pieces, Q._shuffle
    monkeypatch.setattr(N, "pieces", lambda c: pieces(c, folds=2))

    def text(c):
        whole(c)
        return c.select(f"select {select}")

    want = to_spark(text)(spark, odd).toPandas()
    # The registered way, stopped at the same relation.
    monkeypatch.setattr(Q, "_shuffle", text)
    got = Q.shuffled(spark, odd).toPandas()
    assert want["strategy"].nunique() == 7
    same(got, want, by, atol=1e-9)


def test_no_panel_is_written(spark, small, monkeypatch):
    wrote = []

    def counted(df):
        wrote.append(set(df.columns))
        return cut(df)

    for module in (slabs, sql):
        monkeypatch.setattr(module, "cut", counted)
    assert catalog.queries()["shuffle_folds"](spark, small).count() == 1
    assert wrote and not [w for w in wrote if "close" in w]
