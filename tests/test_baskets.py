"""Baskets of theses from slabs: the results of the relations on odd names, and no panel on the way."""

import shutil

import duckdb
from test_slabs import odd, same  # noqa: F401

from tessera.operators import slabs
from tessera.plans import catalog, relation_queries, sql
from tessera.plans.sql import to_spark
from tessera.session import cut


def test_baskets_are_those_of_the_relations(spark, odd, small, tmp_path, monkeypatch):  # noqa: F811
    shutil.copy(f"{odd}/lineitem.parquet", tmp_path)
    # Events far enough apart that theses fall before, in and after the sessions.
    duckdb.sql(f"copy (select event_id, ts + to_days(cast(event_id % 300 as int)) as ts, user_id, event_type, value, props from '{small}/events.parquet') to '{tmp_path}/events.parquet'")
    want = to_spark(relation_queries.TEXTS["basket_excess"])(spark, str(tmp_path)).toPandas()
    wrote = []

    def counted(df):
        wrote.append(set(df.columns))
        return cut(df)

    for module in (relation_queries, slabs, sql):
        monkeypatch.setattr(module, "cut", counted)
    got = catalog.queries()["basket_excess"](spark, str(tmp_path)).toPandas()
    assert wrote and not [w for w in wrote if "close" in w]
    assert want["forward_x"].notna().any() and want["trailing_x"].notna().any()
    same(got, want, ["thesis"], atol=1e-6)
