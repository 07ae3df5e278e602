"""Queries that bring relations together: membership, filings, disclosures, books, warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import series as S
from tessera.operators import evaluation as E
from tessera.operators.slabs import Slabs
from tessera.session import cut, scratch
from tessera.sources import panel as P

from .sql import Chain, Dialect, Text, rounded, to_spark

TEXTS: dict[str, Text] = {}
#: Quarters back that anything reads of what is known at a day: this one and the four before it.
QUARTERS = 5


def query(name: str):
    def add(f: Text) -> Text:
        TEXTS[name] = f
        return f

    return add


# ---- membership -------------------------------------------------------------


def membership(c: Chain, size: int = 50, every: int = 21, lookback: int = 60, least: float = 1.0) -> str:
    """Top names by lagged median dollar volume at each refresh, held flat until the next."""
    P.panel(c)
    med = f"{c.d.percentile('case when dv > 0 then dv end', 0.5)} over {S.before(lookback)}"
    c.add("ml", f"select symbol, t_idx, close, round({med}, 4) as liq from panel")
    c.add("mr", f"select symbol, t_idx, row_number() over (partition by t_idx order by liq desc, symbol) as rn from ml where t_idx % {every} = 0 and t_idx >= {lookback} and liq >= {least} and close >= {P.MIN_PRICE}")
    c.add("mem", f"select p.symbol, p.t_idx from panel p join mr m on m.symbol = p.symbol and m.t_idx = p.t_idx - p.t_idx % {every} and m.rn <= {size}")
    return "mem"


def change_log(c: Chain) -> str:
    """Membership as intervals: from the first session to the day after the last."""
    P.bars(c)
    c.add("log", f"select symbol, min(date) as valid_from, {c.d.add_days('max(date)', '1')} as valid_to from bars group by symbol")
    return "log"


@query("universe_rule_membership")
def _membership(c: Chain) -> str:
    membership(c)
    return c.select("select symbol, t_idx from mem")


@query("universe_churn")
def _churn(c: Chain) -> str:
    membership(c)
    c.add("a", "select symbol, t_idx as t from mem where t_idx % 21 = 0")
    c.add("b", "select symbol, t_idx + 21 as t from mem where t_idx % 21 = 0")
    c.add("j", "select coalesce(a.t, b.t) as t, case when a.symbol is null or b.symbol is null then 1 else 0 end as moved from a full outer join b on a.symbol = b.symbol and a.t = b.t")
    return c.select("select t, cast(sum(moved) as bigint) as moved, count(*) as n from j group by t")


@query("universe_summary")
def _summary(c: Chain) -> str:
    membership(c)
    c.add("d", "select t_idx, count(*) as n from mem group by t_idx")
    c.add("e", "select count(distinct symbol) as ever from mem")
    return c.select(f"select e.ever, {c.d.percentile('d.n', 0.5)} as median_n, min(d.n) as min_n, max(d.n) as max_n from d, e group by e.ever")


@query("membership_asof")
def _asof(c: Chain) -> str:
    """Whether a symbol is a member at every session of the calendar, those before its first change included."""
    change_log(c)
    P.at_session(c, "log", "valid_from", "log_in")
    c.add("log_v", "select symbol, t0 as t_in, valid_to from log_in")
    P.at_session(c, "log_v", "valid_to", "log_out")
    n = "(select max(t_idx) from sessions)"
    c.add("log_t", f"select symbol, t_in, coalesce(t0, {n} + 1) as t_out, {n} as n from log_out")
    P.expand(c, "log_t", "0", "n", "lx")
    return c.select("select symbol, t_idx, t_idx >= t_in and t_idx < t_out as member from lx")


@query("active_between")
def _active(c: Chain) -> str:
    change_log(c)
    return c.select("select symbol from log where valid_from <= date '1996-12-31' and valid_to > date '1996-01-01'")


@query("semi_active")
def _semi(c: Chain) -> str:
    change_log(c)
    s = c.d.table("supplier")
    return c.select(f"select s_suppkey, s_name from {s} s where exists (select 1 from log l where l.symbol = s.s_suppkey and l.valid_to > date '2001-10-15')")


@query("anti_departed")
def _anti(c: Chain) -> str:
    change_log(c)
    s = c.d.table("supplier")
    return c.select(f"select s_suppkey, s_name from {s} s where not exists (select 1 from log l where l.symbol = s.s_suppkey and l.valid_to > date '2001-10-15')")


@query("survivorship_report")
def _survivors(c: Chain) -> str:
    change_log(c)
    return c.select("select count(*) as ever, count(case when valid_to > date '2001-10-15' then 1 end) as today, count(case when valid_to <= date '2001-10-15' then 1 end) as departed from log")


@query("set_operations")
def _sets(c: Chain) -> str:
    P.bars(c)
    a, b = "select symbol from bars where date < date '1996-01-01'", "select symbol from bars where date >= date '2001-06-01'"
    return c.select(f"select 'both' as kind, symbol from ({a} intersect {b}) q union all select 'early', symbol from ({a} except {b}) q union all select 'any', symbol from ({a} union {b}) q")


# ---- as-of and bitemporal ----------------------------------------------------


def filing_sessions(c: Chain) -> str:
    """Relation ``fs``: for every session from a symbol's first filing on, the last filing known at it."""
    P.facts(c)
    c.add("k", "select symbol, filed, max(val) as val from facts group by symbol, filed")
    P.at_session(c, "k", "filed", "kt", keep="")
    c.add("iv", "select symbol, filed, val, t0, coalesce(lead(t0) over (partition by symbol order by filed) - 1, (select max(t_idx) from sessions)) as t1 from kt")
    return P.expand(c, "iv", "t0", "t1", "fs")


@query("asof_backward")
def _backward(c: Chain) -> str:
    filing_sessions(c)
    return c.select("select symbol, t_idx, val, filed from fs")


@query("asof_forward")
def _forward(c: Chain) -> str:
    P.disclosures(c)
    P.at_session(c, "disclosures", "filing_date", "da", keep="")
    return c.select("select event_id, t0 as t_idx from da")


def known_quarters(c: Chain, frm: str, keys: tuple[str, ...], quarters: int, name: str) -> str:
    """Relation ``name``: (keys, known_on, end_date, val, q), the last ``quarters`` periods known at every filing day.

    A version counts from its own filing day to the next version's, and no
    longer than until that many later periods are all known, so a version meets
    a bounded number of days; periods beyond may be listed or not.
    """
    by = ", ".join(keys)

    def on(a: str, b: str) -> str:
        return " and ".join(f"{a}.{k} = {b}.{k}" for k in keys)

    of = ", ".join(f"v.{k}" for k in keys)
    c.add(f"{name}_days", f"select {by}, filed as known_on, cast(row_number() over (partition by {by} order by filed) as int) as k from (select distinct {by}, filed from {frm}) q")
    c.add(f"{name}_first", f"select {by}, end_date, min(filed) as first_filed from {frm} group by {by}, end_date")
    ahead = f"over (partition by {by} order by end_date rows between 1 following and {quarters} following)"
    c.add(f"{name}_later", f"select {by}, end_date, case when count(*) {ahead} = {quarters} then max(first_filed) {ahead} end as gone from {name}_first")
    c.add(f"{name}_one", f"select {by}, end_date, filed, val, row_number() over (partition by {by}, end_date, filed order by form desc) as v from {frm}")
    c.add(f"{name}_next", f"select {by}, end_date, filed, val, lead(filed) over (partition by {by}, end_date order by filed) as next_filed from {name}_one where v = 1")
    c.add(f"{name}_till", f"select {of}, v.end_date, v.val, v.filed, least(coalesce(v.next_filed, l.gone), coalesce(l.gone, v.next_filed)) as until from {name}_next v join {name}_later l on {on('l', 'v')} and l.end_date = v.end_date")
    c.add(f"{name}_last", f"select {by}, max(k) as n from {name}_days group by {by}")
    c.add(f"{name}_span", f"select {of}, v.end_date, v.val, a.k as k0, cast(coalesce(b.k - 1, n.n) as int) as k1 from {name}_till v join {name}_days a on {on('a', 'v')} and a.known_on = v.filed join {name}_last n on {on('n', 'v')} left join {name}_days b on {on('b', 'v')} and b.known_on = v.until")
    P.expand(c, f"{name}_span", "k0", "k1", f"{name}_at")
    part = ", ".join(f"v.{k}" for k in keys)
    c.add(name, f"select {of}, d.known_on, v.end_date, v.val, row_number() over (partition by {part}, d.known_on order by v.end_date desc) as q from {name}_at v join {name}_days d on {on('d', 'v')} and d.k = v.t_idx", keep=True)
    return name


def known(c: Chain) -> str:
    """What is known of the last quarters at every filing day of its symbol: the latest version filed by then."""
    P.facts(c)
    return known_quarters(c, "facts", ("symbol",), QUARTERS, "known")


@query("bitemporal_known")
def _known(c: Chain) -> str:
    known(c)
    return c.select("select symbol, known_on, end_date, val from known where q = 1")


@query("bitemporal_ttm")
def _ttm(c: Chain) -> str:
    known(c)
    return c.select("select symbol, known_on, case when count(*) = 4 then round(sum(val), 2) end as ttm from known where q <= 4 group by symbol, known_on")


@query("days_since_filing")
def _days_since(c: Chain) -> str:
    filing_sessions(c)
    return c.select(f"select f.symbol, f.t_idx, least({c.d.days('s.date', 'f.filed')}, 50) as days from fs f join sessions s on s.t_idx = f.t_idx")


@query("filing_run_rates")
def _fundamental(c: Chain) -> str:
    known(c)
    c.add("ttm", "select symbol, known_on, sum(case when q <= 4 then val end) as ttm, count(case when q <= 4 then 1 end) as n, max(case when q = 1 then val end) as last_q, max(case when q = 5 then val end) as year_ago from known group by symbol, known_on")
    c.add("o", f"select symbol, known_on, case when n = 4 then {S.clip('last_q * 4 / nullif(ttm, 0)', '-50', '50')} end as run_rate, {S.clip('last_q / nullif(year_ago, 0) - 1', '-50', '50')} as growth from ttm")
    return c.select(f"select symbol, known_on, {rounded('run_rate', 'growth')} from o")


# ---- disclosures ------------------------------------------------------------


@query("interval_expand_decay")
def _decay(c: Chain) -> str:
    """Each disclosed trade counts from its filing on, less every session, for 13 sessions."""
    P.disclosures(c)
    P.at_session(c, "disclosures", "filing_date", "da", keep="")
    if c.d.name == "spark":  # Trades of a name and session decay alike, so their sum is dealt out, where the name is.
        c.add("dn", "select symbol, t0, least(t0 + 12, (select max(t_idx) from sessions)) as t1, sum((case when side = 'buy' then 1 else -1 end) * ln(1 + amount_mid / 1e4)) as amount from (select * from da distribute by symbol) q group by symbol, t0")
        P.expand(c, "dn", "t0", "t1", "dx")
        c.add("x", "select symbol, t_idx, sum(amount * (1 - (t_idx - t0) / 13e0)) as signal, max(t0) as last_t from dx group by symbol, t_idx")
    else:
        c.add("dn", "select symbol, side, amount_mid, t0, least(t0 + 12, (select max(t_idx) from sessions)) as t1 from da")
        P.expand(c, "dn", "t0", "t1", "dx")
        c.add("x", "select symbol, t_idx, sum((case when side = 'buy' then 1 else -1 end) * (1 - (t_idx - t0) / 13e0) * ln(1 + amount_mid / 1e4)) as signal, max(t0) as last_t from dx group by symbol, t_idx")
    return c.select(f"select symbol, t_idx, {rounded('signal', digits=8)}, t_idx - last_t as since from x")


@query("disclosure_summary")
def _disclosed(c: Chain) -> str:
    P.disclosures(c)
    return c.select(f"select side, count(*) as n, count(distinct member) as members, count(distinct symbol) as symbols, {c.d.percentile('lag_days', 0.5)} as median_lag, {c.d.percentile('lag_days', 0.9)} as p90_lag, round(avg(case when lag_days > 40 then 1e0 else 0e0 end), 6) as late from disclosures group by side")


def event_returns(c: Chain) -> str:
    P.disclosures(c)
    P.returns(c)
    P.at_session(c, "disclosures", "filing_date", "ev_at", keep="")
    c.add("f5", f"select symbol, t_idx, {S.shift('close', -6)} / nullif({S.shift('close', -1)}, 0) - 1 as fwd from panel")
    c.add("f5x", "select *, fwd - avg(fwd) over (partition by t_idx) as excess from f5")
    c.add("er", "select a.event_id, a.member, a.t0, (case when a.side = 'buy' then 1 else -1 end) * f.excess as x from ev_at a join f5x f on f.symbol = a.symbol and f.t_idx = a.t0 where f.excess is not null", keep=True)
    return "er"


@query("event_study_clustered")
def _event_study(c: Chain) -> str:
    event_returns(c)
    c.add("by_day", "select t0, avg(x) as m from er group by t0")
    c.add("by_md", "select t0, member, avg(x) as m from er group by t0, member")
    t = "avg(m) / nullif(stddev_samp(m) / sqrt(count(*)), 0)"
    c.add("o", f"select 'event' as unit, count(*) as n, avg(x) as mean, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) as t from er union all select 'day', count(*), avg(m), {t} from by_day union all select 'day_member', count(*), avg(m), {t} from by_md")
    return c.select(f"select unit, n, {rounded('mean', 't')} from o")


@query("winsorised_t")
def _winsor(c: Chain) -> str:
    event_returns(c)
    c.add("p", f"select {c.d.percentile('x', 0.01)} as lo, {c.d.percentile('x', 0.99)} as hi from er")
    c.add("w", "select least(greatest(x, lo), hi) as x from er, p")
    c.add("o", "select count(*) as n, avg(x) as mean, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) as t from w")
    return c.select(f"select n, {rounded('mean', 't')} from o")


@query("parse_filing_text")
def _parse(c: Chain) -> str:
    """Two-line rows of a filing text: the asset line, then the ticker with dates and amount."""
    text = "P 01/04/2021 01/20/2021 $1,001 - $15,000\\nApple Inc (AAPL)\\nnoise\\nS 02/05/2021 02/25/2021 $15,001 - $50,000\\nMicrosoft (MSFT) [ST]"
    lines = c.d.string_list("doc", "\\n")
    c.add("t", f"select '{text}' as doc" if c.d.name == "spark" else f"select '{text}'.replace('\\n', chr(10)) as doc")
    if c.d.name == "spark":
        c.add("l", f"select pos as n, col as line from t lateral view posexplode({lines}) e")
    else:
        c.add("l", "select generate_subscripts(string_split(doc, chr(10)), 1) - 1 as n, unnest(string_split(doc, chr(10))) as line from t")
    c.add("p", "select *, lead(line) over (order by n) as next_line from l")
    pat = "^([PS]) ([0-9/]+) ([0-9/]+) [$]([0-9,]+) - [$]([0-9,]+)"
    tick = c.d.extract("next_line", "[(]([A-Z]+)[)]")
    parts = ", ".join(f"{c.d.extract('line', pat, i)} as {n}" for i, n in enumerate(("side", "traded", "notified", "low", "high"), 1))
    return c.select(f"select {parts}, {tick} as ticker from p where {c.d.matches('line', pat)}")


# ---- warehouse --------------------------------------------------------------


@query("wh_symbols")
def _symbols(c: Chain) -> str:
    P.bars(c)
    P.market(c)
    return c.select("select m.market, b.symbol, min(b.date) as first_date, max(b.date) as last_date, count(*) as n_bars from bars b join market m on b.symbol = m.symbol group by m.market, b.symbol")


@query("wh_markets")
def _markets(c: Chain) -> str:
    P.bars(c)
    P.market(c)
    return c.select("select market, count(distinct b.symbol) as n_symbols, min(date) as starts, max(date) as ends from bars b join market m using (symbol) group by market")


@query("wh_counts")
def _counts(c: Chain) -> str:
    names = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events")
    return c.select(" union all ".join(f"select '{n}' as name, count(*) as n from {c.d.table(n)}" for n in names))


@query("wh_group_by_all")
def _group_all(c: Chain) -> str:
    P.returns(c)
    P.market(c)
    return c.select("select market, date_part('year', date) as yr, round(avg(ret) + 1.73e-10, 8) as avg_ret, count(*) as n from rets join market using (symbol) group by all")


@query("coverage_join_using")
def _using(c: Chain) -> str:
    P.bars(c)
    P.market(c)
    c.add("sy", "select symbol, count(*) as n from bars group by symbol")
    return c.select("select market, count(*) as n_symbols, round(avg(n), 4) as avg_bars from sy join market using (symbol) group by market order by market")


@query("wh_top_t_limit")
def _top(c: Chain) -> str:
    P.returns(c)
    c.add("t", "select symbol, avg(ret) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) as t_stat from rets group by symbol")
    return c.select(f"select symbol, {rounded('t_stat')} from t order by abs(t_stat) desc, symbol limit 5")


# ---- records ----------------------------------------------------------------


def experience(c: Chain) -> str:
    e = c.d.table("events")
    c.add("xp", f"select event_type as method, user_id as fingerprint, cast(ts as date) as day, round(max(value) / 100 - 0.5, 6) as fwd_alpha from {e} group by 1, 2, 3")
    return "xp"


@query("experience_summary")
def _experience(c: Chain) -> str:
    experience(c)
    return c.select("select method, count(*) as n_rows, count(distinct fingerprint) as distinct_n, count(case when fwd_alpha > 0 then 1 end) as good, round(avg(fwd_alpha) + 1.73e-8, 6) as mean_alpha from xp group by method")


@query("experience_since")
def _since(c: Chain) -> str:
    experience(c)
    return c.select("select method, fingerprint, day, fwd_alpha from xp where day >= (select max(day) from xp) - interval 5 day and method in ('click', 'purchase')" if c.d.name == "duckdb" else "select method, fingerprint, day, fwd_alpha from xp where day >= date_sub((select max(day) from xp), 5) and method in ('click', 'purchase')")


@query("family_forward_rates")
def _rates(c: Chain) -> str:
    experience(c)
    c.add("fam", "select *, case when fingerprint % 2 = 0 then 'momentum,volume' else 'volume,peer' end as families from xp")
    items = c.d.string_list("families", ",")
    c.add("one", f"select fwd_alpha, family from fam {c.d.explode(items, 'family')}")
    return c.select("select family, count(*) as n, count(case when fwd_alpha > 0 then 1 end) as good, round(avg(case when fwd_alpha > 0 then 1e0 else 0e0 end), 6) as rate from one group by family")


@query("method_posteriors")
def _posteriors(c: Chain) -> str:
    experience(c)
    c.add("vote", "select method, fingerprint, max(fwd_alpha) as best from xp group by method, fingerprint")
    return c.select("select method, 1 + count(case when best > 0.2 then 1 end) as a, 1 + count(case when best <= 0.2 then 1 end) as b from vote group by method")


@query("worker_liveness")
def _liveness(c: Chain) -> str:
    e = c.d.table("events")
    c.add("hb", f"select user_id as worker, max({c.d.epoch('ts')}) as seen from {e} group by 1")
    c.add("now", "select max(seen) + 300 as now_s from hb")
    return c.select("select worker, now_s - seen as age, case when now_s - seen <= 180 then 'live' when now_s - seen <= 900 then 'stale' else 'dead' end as state from hb, now")


@query("hypothesis_bar")
def _bar(c: Chain) -> str:
    experience(c)
    return c.select("select count(distinct fingerprint) as n, round(sqrt(2 * ln(count(distinct fingerprint))), 6) as bar from xp")


@query("ledger_dedupe")
def _ledger(c: Chain) -> str:
    e = c.d.table("events")
    key = c.d.sha(f"concat(event_type, ':', coalesce({c.d.json('props', 'k')}, ''))")
    c.add("lg", f"select event_id, ts, {key} as fingerprint from {e}")
    c.add("n", "select *, row_number() over (partition by fingerprint order by ts, event_id) as rn from lg")
    return c.select("select event_id, fingerprint from n where rn = 1")


@query("content_digest")
def _digest(c: Chain) -> str:
    P.bars(c)
    line = "concat(cast(symbol as string), ':', cast(date as string))" if c.d.name == "spark" else "concat(cast(symbol as varchar), ':', cast(date as varchar))"
    c.add("k", f"select symbol, {c.d.concat_sorted(line, 'date')} as body from bars group by symbol")
    return c.select(f"select symbol, {c.d.sha('body')} as digest from k")


@query("json_and_numbers")
def _json(c: Chain) -> str:
    e = c.d.table("events")
    return c.select(f"select event_id, {c.d.try_cast(c.d.json('props', 'k'), 'int')} as k, {c.d.try_cast('event_type', 'double')} as bad from {e}")


@query("stall_length")
def _stall(c: Chain) -> str:
    experience(c)
    c.add("gen", "select day, max(fwd_alpha) as best from xp group by day")
    c.add("k", "select *, row_number() over (order by day) as g from gen")
    return c.select(f"select max(g) - {c.d.argmax('g', c.d.pair('best', 'g'))} as stalled from k")


@query("business_days")
def _business(c: Chain) -> str:
    """Business days after the order up to its first shipment, and back where that is earlier."""
    o, li = c.d.table("orders"), c.d.table("lineitem")

    def upto(d: str) -> str:  # business days since a Monday long ago
        n = c.d.days(d, "date '1970-01-05'")
        return f"(5 * floor({n} / 7e0) + least({n} - 7 * floor({n} / 7e0) + 1, 5))"

    c.add("sh", f"select l_orderkey, cast(min(l_shipdate) as date) as b from {li} group by l_orderkey")
    c.add("od", f"select o_orderkey, cast(o_orderdate as date) as a, b from {o} join sh on l_orderkey = o_orderkey")
    return c.select(f"select o_orderkey, a, b, cast({upto('b')} - {upto('a')} as bigint) as n from od")


@query("event_study_by_year")
def _by_year(c: Chain) -> str:
    event_returns(c)
    c.add("ey", "select e.t0, e.x, date_part('year', s.date) as yr from er e join sessions s on s.t_idx = e.t0")
    c.add("o", "select cast(yr as bigint) as yr, count(*) as n, count(distinct t0) as days, avg(x) as mean, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) as t from ey group by yr")
    return c.select(f"select yr, n, days, {rounded('mean', 't')} from o")


@query("filing_cache_summary")
def _cache(c: Chain) -> str:
    P.facts(c)
    return c.select("select symbol, count(*) as facts, min(filed) as earliest, count(distinct end_date) as quarters from facts group by symbol")


@query("volatility_join")
def _vol_join(c: Chain) -> str:
    """Days that the market and the fast volatility have in common, with the slow one where it is there."""
    P.returns(c)
    c.add("ix", "select t_idx, avg(ret) as r from rets group by t_idx")
    c.add("v1", "select t_idx, stddev_pop(r) over (order by t_idx rows between 20 preceding and current row) as v from ix where t_idx % 7 <> 3")
    c.add("v3", "select t_idx, stddev_pop(r) over (order by t_idx rows between 62 preceding and current row) as v from ix where t_idx % 5 <> 2")
    return c.select("select a.t_idx, round(a.v + 1.73e-10, 8) + 0e0 as fast, round(b.v + 1.73e-10, 8) + 0e0 as slow, b.v is not null and b.v > a.v as contango from ix i join v1 a on a.t_idx = i.t_idx left join v3 b on b.t_idx = a.t_idx")


#: Sessions before a thesis that its trailing figure looks at, those that a figure needs, and what counts as moved or holding.
THESIS_BACK, THESIS_LEAST, MOVED, HOLDS = 252, 20, 0.25, 0.02


def monthly_theses(c: Chain) -> str:
    """Relation ``thesis``: (thesis, tickers, since), all names that members disclosed in a month to have bought, as of the month's last filing."""
    P.disclosures(c)
    c.add("thesis", "select cast(date_trunc('month', filing_date) as date) as thesis, array_agg(distinct symbol) as tickers, max(filing_date) as since from disclosures where side = 'buy' group by 1")
    return "thesis"


def thesis_scores(c: Chain) -> str:
    """Relation ``ths``: every row of ``thesis`` with the annualised excess of its equal-weight basket before and since its day.

    A basket holds the names that could be traded the session before; it starts
    flat on a window's first session. Tickers that the panel lacks are passed
    over; a window of too few sessions, or without a name, has no figure.
    """
    E.benchmark(c)
    P.at_session(c, "thesis", "since", "th_at")
    c.add("th_n", "select max(t_idx) + 1 as n_t from sessions")
    c.add("th_c", "select thesis, tickers, coalesce(t0, n_t) as at_t, n_t from th_at cross join th_n")
    c.add("th_w", f"select thesis, 'before' as part, greatest(at_t - {THESIS_BACK}, 0) as lo, at_t as hi from th_c union all select thesis, 'since', at_t, n_t from th_c")
    c.add("th_s", f"select distinct thesis, symbol from (select thesis, symbol from thesis {c.d.explode('tickers', 'symbol')}) q")
    c.add("th_p", f"select symbol, t_idx, ret, case when {S.shift('tradable', 1)} then 1 else 0 end as m from rets")
    c.add("th_b", """select s.thesis, w.part, p.t_idx, sum(case when p.t_idx > w.lo then p.m * p.ret else 0 end) / greatest(sum(case when p.t_idx > w.lo then p.m else 0 end), 1) as r
        from th_s s join th_w w on w.thesis = s.thesis join th_p p on p.symbol = s.symbol and p.t_idx >= w.lo and p.t_idx < w.hi group by s.thesis, w.part, p.t_idx""")
    year = f"pow({{}}, {S.YEAR}e0 / count(*)) - 1"
    c.add("th_x", f"select b.thesis, b.part, {year.format(S.growth('b.r'))} - ({year.format(S.growth('k.bench'))}) as x from th_b b join bench k on k.t_idx = b.t_idx group by b.thesis, b.part having count(*) >= {THESIS_LEAST}")
    c.add("th_k", "select thesis, count(distinct symbol) as named from th_s group by thesis")
    c.add("th_o", "select c.thesis, coalesce(k.named, 0) as named, c.n_t - c.at_t as sessions, max(case when x.part = 'before' then x.x end) as trailing_x, max(case when x.part = 'since' then x.x end) as forward_x from th_c c left join th_k k on k.thesis = c.thesis left join th_x x on x.thesis = c.thesis group by c.thesis, k.named, c.n_t, c.at_t")
    c.add("ths", f"select *, coalesce(trailing_x > {MOVED}, false) as already_moved, case when forward_x is null or sessions < {THESIS_LEAST} then 'too early' when forward_x > {HOLDS} then 'holding' when forward_x < -{HOLDS} then 'not holding' else 'flat' end as verdict from th_o")
    return "ths"


@query("basket_excess")
def _basket(c: Chain) -> str:
    """Every thesis's basket against the equal-weight market before and since its day, and the verdict."""
    monthly_theses(c)
    thesis_scores(c)
    return c.select(f"select thesis, named, sessions, {rounded('trailing_x', 'forward_x')}, already_moved, verdict from ths")


# ---- from keys --------------------------------------------------------------


def keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What disclosures read of the bars: ``sessions``, and ``bars`` with every name once; no bar is formed."""
    c = Chain(Dialect(sf_dir))
    t = c.d.table("lineitem")
    c.add("bars", f"select distinct cast(date_trunc('week', l_shipdate) as date) as date from {t}")
    P.sessions(c)
    return {"sessions": cut(spark.sql(c.select("select date, t_idx from sessions"))), "bars": cut(spark.sql(f"select distinct l_suppkey as symbol from {t}"))}


def from_keys(text: Text) -> Callable[[SparkSession, str], DataFrame]:
    """A text that reads disclosures and no price."""
    return lambda spark, sf_dir: to_spark(text, **keys(spark, sf_dir))(spark, sf_dir)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``basket_excess`` from slabs: theses meet their names where these lie, and sums of a thesis and session alone leave them."""

    def members(c: Chain) -> str:
        P.disclosures(c)
        return c.select("select cast(date_trunc('month', filing_date) as date) as thesis, symbol, max(filing_date) as since from disclosures where side = 'buy' group by 1, 2")

    def windows(c: Chain) -> str:
        thesis_scores(c)
        return c.select("select thesis, part, lo, hi from th_w")

    with scratch(spark, "slabs") as at:
        s = Slabs(spark, sf_dir, at)
        named = cut(to_spark(members, **{**keys(spark, sf_dir), "sessions": s.sessions})(spark, sf_dir))
        thesis = cut(named.groupBy("thesis").agg(F.max("since").alias("since")).withColumn("tickers", F.array().cast("array<bigint>")))
        count = named.filter("symbol is not null").groupBy("thesis").agg(F.count("*").alias("named"))
        sums = s.group_sums(named.filter("symbol is not null and thesis is not null").selectExpr("cast(symbol as long) as symbol", "unix_date(thesis) as g"))
        given = {"thesis": thesis, "sessions": s.sessions, "bench": cut(s.benchmark())}
        w = to_spark(windows, **given)(spark, sf_dir)
        b = sums.withColumn("thesis", F.expr("date_from_unix_date(g)")).join(F.broadcast(w), "thesis").filter("t_idx >= lo and t_idx < hi")
        # A basket is empty on its window's first session.
        b = b.selectExpr("thesis", "part", "t_idx", "case when t_idx > lo then s / greatest(c, 1) else 0e0 end as r")
        return to_spark(_basket, th_b=cut(b), th_k=cut(count), **given)(spark, sf_dir)


QUERIES = {name: from_keys(TEXTS[name]) for name in ("interval_expand_decay", "disclosure_summary")} | {"basket_excess": baskets}
