"""Disclosures without prices: names and sessions come from their keys, and no bar is written."""

import shutil

import duckdb
import pytest

from tessera.plans import catalog, relation_queries
from tessera.session import cut


@pytest.mark.parametrize("name", ["interval_expand_decay", "disclosure_summary"])
def test_no_bar_is_written_and_the_result_is_that_of_the_sql(spark, small, name, tmp_path, monkeypatch):
    shutil.copy(f"{small}/lineitem.parquet", tmp_path)
    con = duckdb.connect()
    # Every trade three times: several of a name and session, on both sides.
    con.execute(f"copy (select event_id * 3 + i as event_id, ts, user_id, case when i = 2 then 'error' else event_type end as event_type, value + i as value, props from '{small}/events.parquet', range(3) r(i)) to '{tmp_path}/events.parquet'")
    for t in ("lineitem", "events"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    wrote = []

    def counted(df):
        wrote.append(set(df.columns))
        return cut(df)

    for module in (relation_queries, __import__("tessera.plans.sql", fromlist=["cut"])):
        monkeypatch.setattr(module, "cut", counted)
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    assert wrote and not [w for w in wrote if "close" in w]
    want = con.execute(catalog.oracles()[name]).df()[list(got.columns)]
    by = ["symbol", "t_idx"] if "symbol" in got else ["side"]
    got, want = (x.sort_values(by).reset_index(drop=True) for x in (got, want))
    assert len(got) and got.equals(want.astype(got.dtypes.to_dict()))
