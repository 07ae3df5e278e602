"""The registered strategies, their statistics table, and the trading queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import series as S
from tessera.operators import evaluation as E
from tessera.operators import slab_signals as G
from tessera.operators.slabs import Slabs
from tessera.session import cut, scratch, tidy
from tessera.sources import panel as P

from .sql import Chain, Text, rounded, to_spark

TEXTS: dict[str, Text] = {}
COST_BPS = {"stocks": 2.6, "crypto": 10.0, "forex": 2.0, "options": 50.0}
PERIODS = {"stocks": S.YEAR, "crypto": 365, "forex": S.YEAR, "options": 12}
#: Names on each side. Stock books take as many as the test tables have room for.
NAMES = {"stocks": 25, "crypto": 6, "forex": 10}
#: Sessions an option position is held, and the windows of its volatility and of the median it is timed by.
OPTION_HOLD, FAST, SLOW, MEDIAN = 21, 21, 63, 252


@dataclass(frozen=True)
class Strategy:
    """What is traded, how, and the caveat that goes with every result."""

    id: str
    title: str
    market: str
    caveat: str
    text: Text


REGISTRY: dict[str, Strategy] = {}


def register(id: str, title: str, market: str, caveat: str):
    """Add a function chain -> relation (t_idx, ret) of net returns to the registry."""

    def add(build) -> Text:
        def text(c: Chain) -> str:
            build(c)
            return c.select(f"select t_idx, {rounded('ret', digits=8)} from sr")

        text.build = build
        if not caveat:
            raise ValueError(f"{id} has no caveat")
        REGISTRY[id] = Strategy(id, title, market, caveat, text)
        TEXTS[id] = text
        return build

    return add


def prices(c: Chain) -> None:
    """Returns with the running quantities that strict-past windows read."""
    P.returns(c)
    c.add("mkr", "select t_idx, avg(case when tradable then ret end) as mk from rets group by t_idx")
    c.add("pr", "select r.*, coalesce(m.mk, 0) as mk from rets r join mkr m on r.t_idx = m.t_idx", keep=True)


def book(c: Chain, signal: str, hold: int, n_long: int, n_short: int, bps: float) -> None:
    """Relation ``sr`` from ``sg`` (symbol, t_idx, tradable, ret, s): long the top, short the bottom, held ``hold`` sessions.

    A rebalance row with too few names keeps the book before it: every session
    takes the last valid rebalance at or before it. Weights of t earn at t + 1;
    turnover is charged when the book changes.
    """
    c.add("sg", f"select symbol, t_idx, tradable, ret, round({signal}, 9) as s from sx", keep=True)
    need = max(4, n_long + n_short)
    c.add("el", f"""select symbol, t_idx, s, count(*) over (partition by t_idx) as n, row_number() over (partition by t_idx order by s desc, symbol) as up,
        row_number() over (partition by t_idx order by s, symbol desc) as dn from sg where t_idx % {hold} = 0 and tradable and s is not null""")
    half = "cast(floor(n / 2) as int)"
    c.add("bk", f"""select t_idx as t0, symbol, case when up <= least({n_long}, {half}) then 1e0 / least({n_long}, {half}) else 0e0 end
        - case when dn <= least({n_short}, {half}) then 1e0 / greatest(least({n_short}, {half}), 1) else 0e0 end as w from el
        where n >= {need} and (up <= least({n_long}, {half}) or dn <= least({n_short}, {half}))""", keep=True)
    c.add("reb", "select t0, lead(t0) over (order by t0) as t1 from (select distinct t0 from bk) q")
    c.add("held", "select b.symbol, r.t_idx, b.t0, b.w from bk b join reb x on b.t0 = x.t0 join sg r on r.symbol = b.symbol and r.t_idx > b.t0 and (x.t1 is null or r.t_idx <= x.t1)")
    c.add("gr", "select h.t_idx, sum(h.w * r.ret) as g from held h join sg r on r.symbol = h.symbol and r.t_idx = h.t_idx group by h.t_idx")
    c.add("chg", "select t0, symbol, w as w_new, 0e0 as w_old from bk union all select x.t1, b.symbol, 0e0, b.w from bk b join reb x on b.t0 = x.t0 where x.t1 is not null")
    c.add("tn", "select t0, sum(d) as tno from (select t0, symbol, abs(sum(w_new) - sum(w_old)) as d from chg group by t0, symbol) q group by t0")
    c.add("cal", "select distinct t_idx from sg")
    c.add("sr", f"select a.t_idx, coalesce(g.g, 0) - coalesce(t.tno, 0) * {bps} / 1e4 as ret from cal a left join gr g on g.t_idx = a.t_idx left join tn t on t.t0 = a.t_idx")


def ranked(id: str, title: str, market: str, caveat: str, stages: dict[str, str], signal: str, hold: int, n: int | None = None) -> None:
    """A long/short strategy on the average-tie rank of a signal built in one stage."""

    def build(c: Chain) -> None:
        prices(c)
        cols = ", ".join(f"{e} as {k}" for k, e in stages.items())
        c.add("sx0", f"select *, {cols} from pr")
        c.add("sx", f"select *, {S.cs_rank_avg(f'case when tradable then round({signal}, 9) end')} as rk from sx0")
        book(c, "rk", hold, n or NAMES[market], n or NAMES[market], COST_BPS[market])

    register(id, title, market, caveat)(build)


def _mom(back: int, skip: int = 0) -> str:
    return f"{S.shift('close', skip) if skip else 'close'} / nullif({S.shift('close', back)}, 0) - 1"


def _past(agg: str, x: str, w: int) -> str:
    return S.strict_past(agg, x, w)


def _beta(w: int) -> str:
    f = S.before(w)
    return f"case when t_idx >= {w} then covar_pop(ret, mk) over {f} / nullif(var_pop(mk) over {f}, 0) end"


_VOL = {"v": _past("stddev_pop", "ret", 63)}
SURVIVORS = "listed survivors only; failed names are missing"
THIN = "few instruments; one regime"
ranked("stk_lowvol", "Low volatility", "stocks", SURVIVORS, _VOL, "-v", 21)
ranked("stk_mom121", "Momentum 12-1", "stocks", SURVIVORS, {"m": _mom(252, 21)}, "m", 21)
ranked("stk_strev", "Short-term reversal", "stocks", SURVIVORS, {"m": _mom(21)}, "-m", 21)
ranked("stk_ltrev", "Long-term reversal", "stocks", SURVIVORS, {"m": _mom(756, 21)}, "-m", 63)
ranked("stk_52whigh", "52-week high", "stocks", SURVIVORS, {"h": f"close / nullif({_past('max', 'close', 252)}, 0)"}, "h", 21)
# The look-back windows below are refreshed every 21 sessions, which are the rebalance rows.
ranked("stk_bab", "Betting against beta", "stocks", SURVIVORS, {"b": _beta(252)}, "-b", 21)
ranked("stk_ivol", "Idiosyncratic volatility", "stocks", SURVIVORS, {"i": S.residual_std("ret", "mk", 126)}, "-i", 21)
ranked("stk_max", "Lottery demand", "stocks", SURVIVORS, {"x": _past("max", "ret", 21)}, "-x", 21)
ranked("stk_illiq", "Illiquidity", "stocks", SURVIVORS, {"a": _past("avg", "(abs(ret) / nullif(dv, 0)) * 1e6", 21)}, "a", 21, 20)
ranked("stk_turnover", "Low turnover", "stocks", SURVIVORS, {"u": _past("avg", "volume", 21)}, "-u", 21)
ranked("stk_mom_intermediate", "Intermediate momentum", "stocks", SURVIVORS, {"m": _mom(252, 126)}, "m", 21)
ranked("cry_xmom", "Crypto cross-sectional momentum", "crypto", THIN, {"m": _mom(30)}, "m", 7)
ranked("cry_strev", "Crypto short-term reversal", "crypto", THIN, {"m": _mom(7)}, "-m", 7)
ranked("fx_trend", "Currency trend", "forex", THIN, {"m": _mom(60)}, "m", 21)
ranked("fx_reversal", "Currency reversal", "forex", THIN, {"m": _mom(5)}, "-m", 5)
ranked("fx_ppp", "Currency long reversal", "forex", THIN, {"m": _mom(756)}, "-m", 63)


def _two(id: str, title: str, combine) -> None:
    def build(c: Chain) -> None:
        prices(c)
        c.add("sx0", f"select *, {_VOL['v']} as v, {_mom(252, 21)} as m from pr")
        lv = S.cs_rank_avg("case when tradable then round(-v, 9) end")
        mo = S.cs_rank_avg("case when tradable then round(m, 9) end")
        c.add("sx1", f"select *, {lv} as rv, {mo} as rm from sx0")
        c.add("sx", f"select *, {combine} as rk from sx1")
        book(c, "rk", 21, NAMES["stocks"], NAMES["stocks"], COST_BPS["stocks"])

    register(id, title, "stocks", SURVIVORS)(build)


_two("stk_lowvol_mom", "Low volatility and momentum", "(rv + rm) / 2")
_two("stk_vol_scaled_mom", "Volatility-scaled momentum", "(rm - 0.5) / nullif(v, 0)")


def _single(c: Chain, weight: str, bps: float, base: str = "mk") -> None:
    """Relation ``sr`` of one held series ``ms`` (t_idx, mk, ...): yesterday's weight earns today's move."""
    c.add("wt", f"select t_idx, {base} as mk, coalesce({weight}, 0) as w from ms")
    c.add("wl", "select t_idx, mk, w, coalesce(lag(w) over (order by t_idx), 0) as w0 from wt")
    c.add("sr", f"select t_idx, w0 * mk - abs(w - w0) * {bps} / 1e4 as ret from wl")


def _market(c: Chain) -> None:
    prices(c)
    c.add("ms0", "select 1 as symbol, m.t_idx, m.mk, s.date from mkr m join sessions s on s.t_idx = m.t_idx")
    c.add("ms", "select *, exp(sum(ln(1 + coalesce(mk, 0))) over (order by t_idx rows between unbounded preceding and current row)) as lvl from ms0")


@register("stk_turn_of_month", "Turn of the month", "stocks", "calendar effects are heavily mined")
def _tom(c: Chain) -> None:
    _market(c)
    last = "date = max(date) over (partition by date_trunc('month', date))"
    _single(c, f"case when {last} or date_part('day', date) <= 3 then 1e0 else 0e0 end", COST_BPS["stocks"], "coalesce(mk, 0)")


@register("stk_sell_in_may", "November to April", "stocks", "few independent seasons")
def _may(c: Chain) -> None:
    _market(c)
    _single(c, "case when date_part('month', date) >= 11 or date_part('month', date) <= 4 then 1e0 else 0e0 end", COST_BPS["stocks"], "coalesce(mk, 0)")


@register("fx_dollar", "Dollar basket trend", "forex", THIN)
def _dollar(c: Chain) -> None:
    _market(c)
    _single(c, "sign(round(lvl / nullif(lag(lvl, 60) over (order by t_idx), 0) - 1, 9))", COST_BPS["forex"], "coalesce(mk, 0)")


def _trend(c: Chain) -> None:
    """Equal weight over the names above their strict-past 100-session mean."""
    prices(c)
    c.add("tr0", f"select symbol, t_idx, ret, case when tradable and close > {_past('avg', 'close', 100)} + 1e-9 then 1e0 else 0e0 end as up from pr")
    c.add("tr1", "select *, up / greatest(sum(up) over (partition by t_idx), 1) as w from tr0")
    c.add("tr2", f"select t_idx, ret, w, coalesce({S.shift('w', 1)}, 0) as w0 from tr1")
    c.add("ts", f"select t_idx, sum(w0 * ret) - sum(abs(w - w0)) * {COST_BPS['crypto']} / 1e4 as r from tr2 group by t_idx")


@register("cry_trend", "Crypto trend", "crypto", THIN)
def _cry_trend(c: Chain) -> None:
    _trend(c)
    c.add("sr", "select t_idx, r as ret from ts")


@register("cry_vol_target", "Crypto trend at a volatility target", "crypto", THIN)
def _vol_target(c: Chain) -> None:
    _trend(c)
    c.add("vt", "select t_idx, r, case when t_idx >= 63 then stddev_pop(r) over (order by t_idx rows between 63 preceding and 1 preceding) * sqrt(365e0) end as rv from ts")
    c.add("sr", "select t_idx, coalesce(least(greatest(0.4 / nullif(round(rv, 9), 0), 0), 3) * r, 0) as ret from vt")


@register("cry_btc_relative", "Crypto leaders against the first coin", "crypto", THIN)
def _relative(c: Chain, hold: int = 7, back: int = 30, n: int = NAMES["crypto"]) -> None:
    """Long the coins that gained most on the first one, short that one; flat while there are too few."""
    prices(c)
    c.add("sg", f"select p.symbol, p.t_idx, p.tradable, p.ret, round({_mom(back)}, 9) as s, (select min(symbol) from pr) as base from pr p", keep=True)
    c.add("bm", "select t_idx from sg where symbol = base and s is not null")
    c.add("el", f"select g.symbol, g.t_idx, g.base, count(*) over (partition by g.t_idx) as n, row_number() over (partition by g.t_idx order by g.s desc, g.symbol) as up from sg g join bm b on b.t_idx = g.t_idx where g.t_idx % {hold} = 0 and g.symbol <> g.base and g.tradable and g.s is not null")
    c.add("pk", f"select * from el where n >= {n} and up <= {n}")
    c.add("bk", f"select t_idx as t0, symbol, 1e0 / {n} as w from pk union all select t_idx, base, -1e0 from pk where up = 1", keep=True)
    c.add("gr", f"select r.t_idx, sum(b.w * r.ret) as g from sg r join bk b on b.symbol = r.symbol and b.t0 = cast(floor((r.t_idx - 1) / {hold}e0) as int) * {hold} where r.t_idx >= 1 group by r.t_idx")
    c.add("chg", f"select t0, symbol, w from bk union all select t0 + {hold}, symbol, -w from bk")
    c.add("tn", "select t0, sum(d) as tno from (select t0, symbol, abs(sum(w)) as d from chg group by t0, symbol) q group by t0")
    c.add("cal", "select distinct t_idx from sg")
    c.add("sr", f"select a.t_idx, coalesce(g.g, 0) - coalesce(t.tno, 0) * {COST_BPS['crypto']} / 1e4 as ret from cal a left join gr g on g.t_idx = a.t_idx left join tn t on t.t0 = a.t_idx")


def _options(c: Chain) -> None:
    """Blocks of the market level with its trailing volatilities: (t0, t_idx, sig, slow, med, move).

    The market level and the volatility series have calendars of their own; a
    block needs a day that both have, and the slow series where it is there.
    """
    _market(c)

    def vol(w: int) -> str:
        return f"case when t_idx >= {w} then round(stddev_pop(coalesce(mk, 0)) over (order by t_idx rows between {w} preceding and 1 preceding) * sqrt({S.YEAR}e0), 9) end"

    c.add("spot", "select t_idx, lvl from ms")
    c.add("iv_fast", f"select t_idx, sig from (select t_idx, {vol(FAST)} as sig from ms) q where sig is not null")
    c.add("iv_slow", f"select t_idx, slow from (select t_idx, {vol(SLOW)} as slow from ms) q where slow is not null")
    c.add("om", f"select s.t_idx, s.lvl, f.sig, w.slow, case when s.t_idx >= {MEDIAN} then {c.d.percentile('f.sig', 0.5)} over (order by s.t_idx rows between {MEDIAN} preceding and 1 preceding) end as med from spot s join iv_fast f on f.t_idx = s.t_idx left join iv_slow w on w.t_idx = s.t_idx")
    c.add("ob", f"select a.t_idx as t0, b.t_idx, a.sig, a.slow, a.med, b.lvl / a.lvl - 1 as move, {OPTION_HOLD}e0 / {S.YEAR} as tau from om a join spot b on b.t_idx = a.t_idx + {OPTION_HOLD} where a.t_idx % {OPTION_HOLD} = 0")


_FEE = f"{COST_BPS['options']} / 1e4"
THETA = f"(0.8 * sig * sqrt(tau) - abs(move)) - {_FEE}"
_WING = "0.5 * sig * sqrt(tau)"


def _option(id: str, title: str, payoff: str, since: int = 0) -> None:
    def build(c: Chain) -> None:
        _options(c)
        c.add("sr", f"select t_idx, {payoff} as ret from ob where t0 >= {since}")

    register(id, title, "options", "implied volatility stands in for traded prices")(build)


_option("opt_theta", "Short straddle", THETA)
_option("opt_condor", "Iron condor", f"0.33 * {_WING} - least(greatest(abs(move) - sig * sqrt(tau), 0), {_WING}) - {_FEE}")
_option("opt_vrp_timed", "Straddle when volatility is high", f"case when sig > med then {THETA} else 0e0 end", MEDIAN)
_option("opt_vix_carry", "Straddle in contango", f"case when slow > sig then {THETA} else 0e0 end")
_option("opt_put_write", "Put write", f"0.4 * sig * sqrt(tau) + least(move, 0) - {_FEE}")

#: The strategies as such; what follows are the same on windows that the test tables' 357 sessions can fill.
SPECIFIED = tuple(REGISTRY)
ranked("stk_ltrev_156", "Long-term reversal, three years of weeks", "stocks", SURVIVORS, {"m": _mom(156, 21)}, "-m", 63)
ranked("fx_ppp_156", "Currency long reversal, three years of weeks", "forex", THIN, {"m": _mom(156)}, "-m", 63)


def all_curves(c: Chain, ids: tuple[str, ...]) -> str:
    """Relation ``curves`` (id, t_idx, ret): strategies side by side, each in its own names."""
    parts = []
    for i, id in enumerate(ids):
        own = Chain(c.d)
        REGISTRY[id].text.build(own)
        shared = {"wk", "px", "op", "bars", "sessions", "spans", "dense", "liq", "panel", "rets", "mkr", "pr"}
        names = [n for n in own.parts if n not in shared]
        for n, sql in own.parts.items():
            for m in names:
                sql = _rename(sql, m, f"{m}_{i}")
            c.add(n if n in shared else f"{n}_{i}", sql, keep=n in shared and n in own.kept)
        parts.append(f"select '{id}' as id, t_idx, ret from sr_{i}")
    c.add("curves", " union all ".join(parts), keep=True)
    return "curves"


def _rename(sql: str, name: str, to: str) -> str:
    return re.sub(rf"(?<=from |join )({name})(?=[\s,)]|$)", to, sql)


def _table(c: Chain) -> str:
    """Every strategy's record, annualised by its market's periods, and its excess over the equal-weight benchmark."""
    all_curves(c, SPECIFIED)
    E.benchmark(c)
    periods = " ".join(f"when '{s.id}' then {PERIODS[s.market]}e0" for s in REGISTRY.values())
    up = "(partition by id order by t_idx rows between unbounded preceding and current row)"
    c.add("sq", f"select v.id, v.t_idx, v.ret, v.ret - b.bench as excess, case v.id {periods} end as per, exp(sum(ln(1 + v.ret)) over {up.replace('id', 'v.id', 1).replace('order by t_idx', 'order by v.t_idx')}) as eq from curves v join bench b on b.t_idx = v.t_idx")
    c.add("sd", f"select *, eq / greatest(max(eq) over {up}, 1) - 1 as dd from sq")
    c.add("o", """select id, count(*) as n, exp(sum(ln(1 + ret))) - 1 as total, exp(sum(ln(1 + ret)) * max(per) / count(*)) - 1 as cagr,
        count(case when ret > 0 then 1 end) / nullif(cast(count(case when ret <> 0 then 1 end) as double), 0) as win_rate,
        min(dd) as max_dd, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(max(per)) as sharpe, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(*)) as t_stat,
        avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(count(*)) as excess_t from sd group by id""")
    return c.select(f"select id, n, {rounded('total', 'cagr', 'win_rate', 'max_dd', 'sharpe', 't_stat', 'excess_t')} from o")


def _tests(c: Chain) -> str:
    all_curves(c, SPECIFIED)
    c.add("ts_", "select id, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(*)) as t from curves group by id")
    c.add("bar_", "select greatest(2e0, sqrt(2 * ln(count(*)))) as bar from ts_")
    return c.select("select count(*) as n, round(max(bar), 6) as bar, count(case when abs(t) >= bar then 1 end) as clears from ts_, bar_")


TEXTS |= {"strategy_stats_table": _table, "multiple_testing_summary": _tests}


# ---- from slabs -------------------------------------------------------------

#: Ranked strategies: sessions held, and the stages of the signal as forms over a slab.
FORMS: dict[str, tuple[int, dict[str, G.Form]]] = {
    "stk_lowvol": (21, {"v": G.volatility}),
    "stk_mom121": (21, {"m": G.moved(252, 21)}),
    "stk_strev": (21, {"m": G.moved(21)}),
    "stk_ltrev": (63, {"m": G.moved(756, 21)}),
    "stk_52whigh": (21, {"h": G.to_high}),
    "stk_bab": (21, {"b": G.beta(252)}),
    "stk_ivol": (21, {"i": G.residual(126)}),
    "stk_max": (21, {"x": G.largest}),
    "stk_illiq": (21, {"a": G.illiquidity}),
    "stk_turnover": (21, {"u": G.turnover}),
    "stk_mom_intermediate": (21, {"m": G.moved(252, 126)}),
    "cry_xmom": (7, {"m": G.moved(30)}),
    "cry_strev": (7, {"m": G.moved(7)}),
    "cry_btc_relative": (7, {"m": G.moved(30)}),
    "fx_trend": (21, {"m": G.moved(60)}),
    "fx_reversal": (5, {"m": G.moved(5)}),
    "fx_ppp": (63, {"m": G.moved(756)}),
    "stk_lowvol_mom": (21, {"v": G.volatility, "m": G.moved(252, 21)}),
    "stk_vol_scaled_mom": (21, {"v": G.volatility, "m": G.moved(252, 21)}),
    "stk_ltrev_156": (63, {"m": G.moved(156, 21)}),
    "fx_ppp_156": (63, {"m": G.moved(156)}),
}
RELATIVE, TRENDS = "cry_btc_relative", ("cry_trend", "cry_vol_target")


def relations(s: Slabs, sf_dir: str, ids: tuple[str, ...]) -> dict[str, DataFrame]:
    """What ``all_curves`` reads of the panel: books of the ranked strategies, returns of the names in them, the market, sessions.

    Signals are formed in slabs; of them only rebalance rows travel, one pass for all strategies of a hold.
    """
    spark = s.rows.sparkSession
    given = {"sessions": s.sessions, "mkr": G.market(s), "bench": s.benchmark()}
    place = {id: i for i, id in enumerate(ids)}
    ranks: dict[str, DataFrame] = {}
    for hold in sorted({FORMS[id][0] for id in ids if id in FORMS}):
        own = [id for id in ids if id in FORMS and FORMS[id][0] == hold]
        rows = cut(G.signals(s, hold, {f"{n}_{place[id]}": f for id in own for n, f in FORMS[id][1].items()}))
        for id in own:
            i = place[id]
            ranks[f"sx0_{i}"] = rows.selectExpr("symbol", "t_idx", "tradable", "ret", *[f"{n}_{i} as {n}" for n in FORMS[id][1]])
    if RELATIVE in place:
        i = place[RELATIVE]
        least = s.names().agg({"symbol": "min"}).first()[0]
        ranks[f"sg_{i}"] = ranks.pop(f"sx0_{i}").selectExpr("symbol", "t_idx", "tradable", "ret", "round(m, 9) as s", f"cast({'null' if least is None else least} as bigint) as base")
        # The base counts where it has a signal, tradable or not.
        base = G.signals(s, FORMS[RELATIVE][0], FORMS[RELATIVE][1], every=least).selectExpr("symbol", "t_idx", "false as tradable", "ret", "round(m, 9) as s", "symbol as base")
        ranks[f"sg_{i}"] = ranks[f"sg_{i}"].filter("symbol <> base").unionByName(cut(base))
    booked = [place[id] for id in ids if id in FORMS]
    if booked:

        def text(c: Chain) -> str:
            all_curves(c, ids)
            return c.select(" union all ".join(f"select {i} as i, t0, symbol, w from bk_{i}" for i in booked))

        books = cut(to_spark(text, **ranks)(spark, sf_dir))
        rets = cut(G.returns(s, books.select("symbol").distinct()))
        tidy(spark)
        for i in booked:
            given |= {f"bk_{i}": books.filter(f"i = {i}").drop("i"), f"sg_{i}": rets, f"cal_{i}": s.sessions.select("t_idx")}
    if any(id in place for id in TRENDS):
        ts = cut(G.above_mean(s, 100, COST_BPS["crypto"]))
        given |= {f"ts_{place[id]}": ts for id in TRENDS if id in place}
    return given


def from_slabs(text: Text, ids: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    """A text on the curves of ``ids`` from slabs: no dense panel is sorted, joined or written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark, "slabs") as at:
            given = {name: cut(df) if name in ("mkr", "bench") else df for name, df in relations(Slabs(spark, sf_dir, at), sf_dir, ids).items()}
            return to_spark(text, **given)(spark, sf_dir)

    return run


def _one(id: str) -> Text:
    def text(c: Chain) -> str:
        all_curves(c, (id,))
        return c.select(f"select t_idx, {rounded('ret', digits=8)} from sr_0")

    return text


QUERIES = {"strategy_stats_table": from_slabs(_table, SPECIFIED), "multiple_testing_summary": from_slabs(_tests, SPECIFIED)}
QUERIES |= {id: from_slabs(_one(id), (id,)) for id in REGISTRY}


# ---- trading ----------------------------------------------------------------


#: Share of the usual daily volume that one order may take; commission a share and at least.
MAX_ADV, PER_SHARE, LEAST_FEE = 0.1, 0.005, 1.0
CAPITAL = 100_000


def costs(c: Chain) -> None:
    P.panel(c)
    c.add("lv", f"select symbol, t_idx, close, lead(open) over (partition by symbol order by t_idx) as next_open, {c.d.percentile('dv', 0.5)} over {S.before(20)} as adv, stddev_samp(r1) over {S.before(20)} as vol from panel")
    c.add("fill", """select symbol, t_idx, close, next_open, adv, vol, 10000e0 as notional,
        least(greatest(0.5 * 0.01 / close * 1e4 + 60 / sqrt(adv / 1e6 + 1), 0.5), 250) as spread_bps,
        0.5 * vol * sqrt(10000 / adv) * 1e4 as impact_bps from lv where close is not null and adv > 0 and vol is not null""")


def _spread(c: Chain) -> str:
    costs(c)
    return c.select(f"select symbol, t_idx, {rounded('spread_bps', 'impact_bps', digits=4)} from fill")


def _fills(c: Chain) -> str:
    """Buys and sells of a fixed notional at the next open: capped at a tenth of the usual volume, at an adverse price, with the gap against the order and a commission."""
    costs(c)
    c.values("side_of", "side, sgn", (("buy", 1.0), ("sell", -1.0)))
    c.add("sides", "select * from fill cross join side_of where next_open is not null")
    c.add("sim", f"select *, least(notional, {MAX_ADV} * adv) as done, next_open * (1 + sgn * (spread_bps + impact_bps) / 1e4) as price, sgn * (next_open / close - 1) * 1e4 as gap_bps from sides")
    c.add("paid", f"select *, greatest(done / price * {PER_SHARE}, {LEAST_FEE}) as commission from sim")
    return c.select(f"select symbol, t_idx, side, {rounded('done', 'price', 'gap_bps', 'commission', digits=4)} from paid")


def _cost_summary(c: Chain) -> str:
    costs(c)
    c.add("o", "select symbol, count(*) as n, sum(notional * (spread_bps + impact_bps)) / sum(notional) as cost_bps from fill group by symbol")
    return c.select(f"select symbol, n, {rounded('cost_bps', digits=4)} from o")


def _orders(c: Chain) -> str:
    """Target against current book: small differences stand, exits are full, sells come first."""
    E.score_momentum(c)
    E.top_k(c, 20, 21)
    c.add("lb", "select max(blk) as b from w")
    c.add("tgt", "select symbol, w * 95000 as want from w, lb where blk = b")
    c.add("cur", "select symbol, w * 95000 * 1.07 as have from w, lb where blk = b - 1")
    c.add("df", "select coalesce(t.symbol, c.symbol) as symbol, coalesce(want, 0) as want, coalesce(have, 0) as have from tgt t full outer join cur c on t.symbol = c.symbol")
    c.add("od", "select symbol, case when want < have then 'sell' else 'buy' end as side, abs(want - have) as notional from df where want = 0 or (abs(want - have) >= 0.005 * 100000 and abs(want - have) >= 25)")
    return c.select("select symbol, side, round(notional, 4) as notional, row_number() over (order by side desc, notional desc, symbol) as seq from od")


def _risk(c: Chain) -> str:
    """Today's loss, the drawdown from the high-water mark, exposure and the largest position, each against its limit."""
    E.score_momentum(c)
    E.backtest(c)
    c.add("eq", "select t_idx, ret, exp(sum(ln(1 + ret)) over (order by t_idx rows between unbounded preceding and current row)) as eq from bt")
    c.add("dd", "select t_idx, ret, 1 - eq / greatest(max(eq) over (order by t_idx rows between unbounded preceding and current row), 1) as dd, max(t_idx) over () as t1 from eq")
    c.add("hd", "select sum(abs(w)) as gross, max(abs(w)) as top, count(*) as names from w where blk = (select max(blk) from w)")
    c.add("lt", "select greatest(-ret, 0) as loss, dd, gross, top, names from dd cross join hd where t_idx = t1")
    rows = (("daily_loss", "loss", 0.03), ("drawdown", "dd", 0.15), ("gross_exposure", "gross", 1.0), ("position", "top", 0.1), ("names", "cast(names as double)", 60))
    c.add("ck", " union all ".join(f"select '{n}' as name, {e} as value, {m}e0 as lim from lt" for n, e, m in rows))
    return c.select(f"select name, {rounded('value')}, lim, value <= lim + 1e-9 as ok from ck")


def _order_checks(c: Chain) -> str:
    """Orders in their sequence, the running total of what is pending, and which a limit on it lets through."""
    _orders(c)
    c.add("oq", c.final)
    c.add("pd", "select *, sum(case when side = 'buy' then notional else -notional end) over (order by seq rows between unbounded preceding and current row) as pending from oq")
    c.add("o", f"select seq, symbol, side, notional, pending, notional <= 0.2 * {CAPITAL} and pending <= 0.98 * {CAPITAL} as ok from pd")
    return c.select(f"select seq, symbol, side, notional, {rounded('pending', digits=3)}, ok from o")


def _book_value(c: Chain) -> str:
    """The last book at the last close of every name: value, profit and its share, weight, gross exposure, total return."""
    E.score_momentum(c)
    E.top_k(c, 20, 21)
    c.add("lb", "select max(blk) as b, max(blk) * 21 as t0 from w")
    last = c.d.argmax("p.close", "p.t_idx")
    c.add("lc", f"select p.symbol, {last} as last_close from panel p join w on w.symbol = p.symbol where w.blk = (select b from lb) and p.t_idx >= (select t0 from lb) and p.close is not null group by p.symbol")
    c.add("bv", f"select w.symbol, w.w * 0.95 * {CAPITAL} / p.close as qty, p.close as cost, q.last_close from w join panel p on p.symbol = w.symbol join lc q on q.symbol = w.symbol where w.blk = (select b from lb) and p.t_idx = (select t0 from lb) and p.close is not null")
    c.add("o", f"select symbol, qty * last_close as market_value, qty * (last_close - cost) as pnl, last_close / cost - 1 as pnl_pct, qty * last_close / sum(qty * last_close) over () as weight, sum(abs(qty * last_close)) over () / ({CAPITAL} + sum(qty * (last_close - cost)) over ()) as gross, sum(qty * (last_close - cost)) over () / {CAPITAL} as total_return from bv")
    return c.select(f"select symbol, {rounded('market_value', 'pnl', digits=4)}, {rounded('pnl_pct', 'weight', 'gross', 'total_return')} from o")


HALF_LIFE, STRETCH = 60, 1000


def posteriors(c: Chain) -> str:
    """Relation ``post``: each arm's normal-inverse-gamma posterior after its rewards, which halve in weight every HALF_LIFE rewards.

    Folding rewards one by one is the same as decayed sums. They are summed in
    stretches, inside which the weights stay far from overflow; of the stretches
    before one the last four are carried in (older ones weigh less than 1e-19).
    """
    e = c.d.table("events")

    def weight(k: str) -> str:
        return f"pow(0.5, ({k}) / {HALF_LIFE}e0)"

    kappa = f"({weight('{i}')} + (1 - {weight('{i}')}) / (1 - {weight('1')}))"
    c.add("rw", f"select event_type as arm, round(value / 100 - 0.5, 6) as x, row_number() over (partition by event_type order by ts, event_id) as i, count(*) over (partition by event_type) as n from {e}")
    c.add("rp", f"select *, cast(floor((i - 1) / {STRETCH}e0) as int) as part, (i - 1) % {STRETCH} as j from rw")
    c.add("rs", f"select arm, part, sum(x * {weight(f'{STRETCH - 1} - j')}) as s from rp group by arm, part")
    carried = " + ".join(f"coalesce(lag(s, {k}) over (partition by arm order by part), 0) * {weight(f'{STRETCH * (k - 1)}')}" for k in range(1, 5))
    c.add("rc", f"select arm, part, {carried} as carry from rs")
    c.add("ru", f"select p.*, c.carry, sum(p.x * {weight('-p.j')}) over (partition by p.arm, p.part order by p.j rows between unbounded preceding and current row) as u from rp p join rc c on c.arm = p.arm and c.part = p.part")
    c.add("rx", f"select arm, i, n, x, u * {weight('j')} + carry * {weight('j + 1')} as s, {kappa.format(i='i - 1')} as k0 from ru")
    c.add("ry", f"select *, {weight('1')} * k0 as kd, (s - x) / {weight('1')} / k0 as mu0 from rx")
    c.add("post", f"select arm, max(n) as n, max(case when i = n then s end) / max({kappa.format(i='n')}) as mu, max({kappa.format(i='n')}) as kappa, 2 + 0.5 * max((1 - {weight('n')}) / (1 - {weight('1')})) as alpha, max({weight('n')}) + sum({weight('n - i')} * 0.5 * kd / (kd + 1) * (x - mu0) * (x - mu0)) as beta, sum(x) as cumulative from ry group by arm")
    return "post"


def _posterior(c: Chain) -> str:
    posteriors(c)
    return c.select(f"select arm, n, {rounded('mu', 'kappa', 'alpha', 'beta', 'cumulative')} from post order by cumulative desc, arm")


TEXTS |= {
    "spread_impact_cost": _spread,
    "fill_simulation": _fills,
    "fill_cost_summary": _cost_summary,
    "full_outer_book_diff": _orders,
    "risk_checks": _risk,
    "order_checks": _order_checks,
    "book_valuation": _book_value,
    "arm_posteriors": _posterior,
}
