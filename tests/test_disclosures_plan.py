"""Disclosures meet their symbols by equal keys."""

import contextlib
import io

import duckdb

from tessera.plans.sql import to_oracle, to_spark
from tessera.sources import panel as P


def test_events_meet_symbols_by_equal_keys(spark, small):
    def text(c):
        P.disclosures(c)
        return c.select("select event_id, member, symbol, side, transaction_date, filing_date from disclosures")

    df = to_spark(text)(spark, small)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    assert "NestedLoop" not in plan.getvalue() and "Cartesian" not in plan.getvalue()
    con = duckdb.connect()
    for name in ("lineitem", "events"):
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    want = con.execute(to_oracle(text)).fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
