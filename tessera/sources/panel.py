"""Relations over the test tables: bars, the dense panel, and the tables beside it.

Every function adds its relation (and those it needs) to a chain and returns
its name.
"""

from __future__ import annotations

from tessera.functions.series import pct_change, shift, trailing
from tessera.plans.sql import Chain

MIN_PRICE = 1.0
MIN_DOLLAR_VOLUME = 1.0


def bars(c: Chain) -> str:
    """Weekly bars of each supplier: discounts as shocks, integrated to a price path."""
    t = c.d.table("lineitem")
    c.add("wk", f"""select l_suppkey as symbol, cast(date_trunc('week', l_shipdate) as date) as date,
        avg(l_discount) as d, avg(l_tax) as x, max(l_discount) as mx, sum(l_quantity) as v from {t} group by 1, 2""")
    c.add("px", "select *, 100*exp(sum(0.6*(d-0.05)) over (partition by symbol order by date)) as c from wk")
    c.add("op", "select *, coalesce(lag(c) over (partition by symbol order by date)*(1+0.05*(x-0.04)), c) as o from px")
    c.add("bars", """select symbol, date, round(o, 6) as open, round(greatest(o,c)*(1+0.1*mx), 6) as high,
        round(least(o,c)*(1-0.1*mx), 6) as low, round(c, 6) as close, v as volume from op""", keep=True)
    return "bars"


def sessions(c: Chain) -> str:
    bars(c)
    c.add("sessions", "select date, cast(row_number() over (order by date) - 1 as int) as t_idx from (select distinct date from bars) q", keep=True)
    return "sessions"


def day_sessions(c: Chain) -> str:
    """Every calendar day with the first session at or after it: as-of joins become joins of equal days.

    Days before the first session are to be clamped to it, see ``at_session``; those after the last have none.
    """
    sessions(c)
    c.add("sess_gap", f"select t_idx, date, cast(coalesce({c.d.days('date', 'lag(date) over (order by date)')}, 1) as int) as gap from sessions")
    c.add("fwd_day", f"select t_idx, {c.d.add_days('date', '-k')} as day from sess_gap {c.d.explode(c.d.sequence('0', 'gap - 1'), 'k')}")
    return "fwd_day"


def at_session(c: Chain, frm: str, day: str, name: str, keep: str = "left") -> str:
    """Relation ``name``: ``frm`` with ``t0``, the first session at or after ``day``; without one it is missing (or the row is, if ``keep`` is empty)."""
    day_sessions(c)
    c.add(f"{name}_d", f"select q.*, greatest({day}, (select min(date) from sessions)) as at_day from {frm} q")
    c.add(name, f"select q.*, y.t_idx as t0 from {name}_d q {keep} join fwd_day y on y.day = q.at_day")
    return name


def expand(c: Chain, frm: str, first: str, last: str, name: str) -> str:
    """Relation ``name``: a row of ``frm`` for every session ``t_idx`` from ``first`` to ``last``, none if that is before it."""
    seq = c.d.sequence(first, f"greatest({last}, {first})")
    c.add(f"{name}_e", f"select * from {frm} {c.d.explode(seq, 't_idx')}")
    c.add(name, f"select * from {name}_e where t_idx <= {last}")
    return name


def panel(c: Chain) -> str:
    """Dense sessions x symbols with membership, the tradable mask and the one-session return."""
    sessions(c)
    c.add("spans", "select symbol, min(date) as first_date, max(date) as last_date, count(*) as n_bars from bars group by symbol")
    c.add("dense", """select s.symbol, t.t_idx, t.date, b.open, b.high, b.low, b.close, b.volume,
        t.date >= s.first_date and t.date <= s.last_date as member
        from sessions t cross join spans s left join bars b on b.symbol = s.symbol and b.date = t.date""")
    c.add("liq", f"""select *, {c.d.median('close*volume', trailing(20))} as dv_med, {pct_change('close', 1)} as r1 from dense""")
    c.add("panel", f"""select symbol, t_idx, date, open, high, low, close, volume, member, r1, close*volume as dv,
        member and close is not null and close > 0 and coalesce(dv_med >= {MIN_DOLLAR_VOLUME}, false)
        and coalesce(close >= {MIN_PRICE}, false) as tradable from liq""", keep=True)
    return "panel"


def returns(c: Chain) -> str:
    """The panel with ``ret``, the simple return that counts a missing price as no move."""
    panel(c)
    c.add("rets", f"select *, coalesce((close - {shift('close', 1)}) / nullif({shift('close', 1)}, 0), 0.0) as ret from panel", keep=True)
    return "rets"


def market(c: Chain) -> str:
    """Each supplier's market: the region of its nation."""
    s, n, r = (c.d.table(t) for t in ("supplier", "nation", "region"))
    c.add("market", f"select s_suppkey as symbol, r_name as market from {s} s join {n} n on s_nationkey = n_nationkey join {r} r on n_regionkey = r_regionkey")
    return "market"


def facts(c: Chain) -> str:
    """Bitemporal filings: quarter end, day it became known, value; some are restated later."""
    o, li = c.d.table("orders"), c.d.table("lineitem")
    c.add("ship", f"select l_orderkey, max(l_shipdate) as shipped from {li} group by 1")
    c.add("qtr", f"""select o_custkey as symbol, cast(date_trunc('quarter', o_orderdate) as date) as q,
        sum(o_totalprice) as val, max(cast(case when shipped >= o_orderdate then shipped end as date)) as shipped
        from {o} o left join ship s on o_orderkey = l_orderkey group by 1, 2""")
    c.add("filed", f"select symbol, q as start_date, {c.d.add_days('q', '90')} as end_date, round(val + 1.7e-4, 2) as val, greatest({c.d.add_days('q', '91')}, shipped) as filed from qtr")
    c.add("facts", f"""select symbol, start_date, end_date, filed, val, 'first' as form from filed
        union all select symbol, start_date, end_date, {c.d.add_days('filed', '60')}, round(val * 1.1 + 1.7e-4, 2), 'restated' from filed where symbol % 7 = 0""")
    return "facts"


def disclosures(c: Chain) -> str:
    """Trades disclosed with a delay, from purchase and error events."""
    e = c.d.table("events")
    sessions(c)
    c.add("syms", "select symbol, row_number() over (order by symbol) - 1 as k, count(*) over () as n from (select distinct symbol from bars) q")
    gap = c.d.days("e1", "cast(ts as date)")
    if c.d.name == "spark":  # The number of symbols on the events' side, so that both meet by equal keys and not in a nested loop.
        place, meets = ", user_id % (select count(*) from (select distinct symbol from bars) z) as place", "q.place = y.k"
    else:
        place, meets = "", "q.user_id % y.n = y.k"
    c.add("disclosures", f"""select event_id, user_id as member, y.symbol, case when event_type = 'purchase' then 'buy' else 'sell' end as side,
        tx as transaction_date, {c.d.add_days('tx', 'user_id % 46')} as filing_date, user_id % 46 as lag_days, value as amount_mid
        from (select *, {c.d.add_days('d1', f'-8 * {gap} - 60')} as tx{place}
            from (select *, (select max(date) from sessions) as d1, (select max(cast(ts as date)) from {e}) as e1 from {e} where event_type in ('purchase', 'error')) r) q
        join syms y on {meets}""")
    return "disclosures"


def macro(c: Chain) -> str:
    """Daily-series stand-ins: one row of aggregates per session."""
    panel(c)
    c.add("macro", """select t_idx, min(date) as date, sum(volume) as m_vol, avg(close) as m_px, stddev_samp(r1) as m_disp,
        count(close) as m_n from panel group by t_idx""")
    return "macro"


def features_base(c: Chain) -> str:
    """The panel with the market return beside every row."""
    panel(c)
    c.add("mkt", "select t_idx, avg(r1) as mkt from panel where member group by t_idx")
    c.add("fb", "select p.*, m.mkt from panel p left join mkt m on p.t_idx = m.t_idx")
    return "fb"


