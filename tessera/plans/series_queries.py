"""Queries on one axis of the panel: sources and shape, time windows, cross-sections, features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import series as S
from tessera.operators.features import FAMILIES, PRICE_FEATURES, ema, family_of, price_features
from tessera.operators.rolling import roll_apply
from tessera.operators.slabs import kept_slabs
from tessera.sources import panel as P

from .sql import Chain, Text, rounded, rounded_each, to_spark

TEXTS: dict[str, Text] = {}


def query(name: str):
    def add(f: Text) -> Text:
        TEXTS[name] = f
        return f

    return add


def on_panel(name: str, **columns: str) -> None:
    """A query with one column per expression over the panel."""

    def text(c: Chain) -> str:
        P.panel(c)
        c.add("o", "select symbol, t_idx, " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + " from panel")
        return c.select(f"select symbol, t_idx, {rounded(*columns)} from o")

    TEXTS[name] = text


@query("bars_fixture")
def _bars(c: Chain) -> str:
    P.bars(c)
    return c.select("select * from bars")


@query("bars_long_nonnull")
def _long(c: Chain) -> str:
    P.panel(c)
    return c.select("select symbol, t_idx, close, volume from panel where close is not null")


@query("panel_dense")
def _dense(c: Chain) -> str:
    P.panel(c)
    return c.select("select symbol, t_idx, date, open, high, low, close, volume, member from panel")


@query("tradable_mask")
def _mask(c: Chain) -> str:
    P.panel(c)
    return c.select("select symbol, t_idx, member, tradable from panel")


@query("coverage_report")
def _coverage(c: Chain) -> str:
    P.panel(c)
    return c.select("""select count(distinct symbol) as ever, count(distinct case when close is not null then symbol end) as priced,
        round(avg(case when close is not null then 1e0 else 0e0 end), 6) as filled, count(*) as cells from panel""")


@query("market_registry")
def _registry(c: Chain) -> str:
    P.market(c)
    P.bars(c)
    return c.select("""select m.market, count(distinct b.symbol) as symbols, min(b.date) as first_date, max(b.date) as last_date, count(*) as n_rows
        from bars b join market m on b.symbol = m.symbol group by m.market""")


@query("unpivot_prices")
def _unpivot(c: Chain) -> str:
    P.bars(c)
    fields = ("open", "high", "low", "close")
    return c.select(f"select symbol, date, field, value from bars unpivot include nulls (value for field in ({', '.join(fields)}))")


@query("factor_wide_pivot")
def _pivot(c: Chain) -> str:
    P.returns(c)
    P.market(c)
    c.add("mr", "select t_idx, market, avg(ret) as r from rets r join market m on r.symbol = m.symbol group by t_idx, market")
    regions = {"africa": "AFRICA", "america": "AMERICA", "asia": "ASIA", "europe": "EUROPE", "mideast": "MIDDLE EAST"}
    cols = ", ".join(f"round(max(case when market = '{v}' then r end), 6) + 0.0 as {k}" for k, v in regions.items())
    return c.select(f"select t_idx, {cols} from mr group by t_idx")


@query("tail_merge_keep_last")
def _tail(c: Chain) -> str:
    P.bars(c)
    c.add("two", "select *, 0 as batch from bars union all select symbol, date, open, high, low, close + 1, volume, 1 from bars where date >= date '2001-01-01'")
    c.add("n", "select *, row_number() over (partition by symbol, date order by batch desc) as rn from two")
    return c.select("select symbol, date, close, batch from n where rn = 1")


@query("min_history_symbols")
def _history(c: Chain) -> str:
    P.bars(c)
    return c.select("select symbol, count(*) as n_bars from bars group by symbol having count(*) >= 250")


@query("sanitised_return")
def _sane(c: Chain) -> str:
    """Moves beyond 60 % count as bad data, except in a market where they happen."""
    P.returns(c)
    P.market(c)
    return c.select("select r.symbol, r.t_idx, round(case when abs(r.ret) > 0.6 and m.market <> 'ASIA' then 0.0 else r.ret end, 6) + 0.0 as ret from rets r join market m on m.symbol = r.symbol")


@query("curve_downsample")
def _curve(c: Chain) -> str:
    P.returns(c)
    c.add("mk", "select t_idx, avg(ret) as r, count(*) over () as n from rets group by t_idx")
    k = 260
    c.add("i", f"select i from (select count(*) as n from mk) q {c.d.explode(c.d.sequence('0', f'{k - 1}'), 'i')}")
    c.add("picks", f"select distinct cast(floor(i * ((select count(*) from mk) - 1) / {k - 1}e0) as int) as t_idx from i")
    return c.select("select m.t_idx, round(m.r, 6) + 0.0 as r from mk m join picks p on p.t_idx = m.t_idx")


on_panel("shift_k", lag_1=S.shift("close", 1), lag_5=S.shift("close", 5), lead_3=S.shift("close", -3))
on_panel("roll_mean", mean_5=S.roll_mean("close", 5), mean_21=S.roll_mean("close", 21), mean_63=S.roll_mean("close", 63))
on_panel("roll_std", std_10=S.roll_std("r1", 10), std_63=S.roll_std("r1", 63))
on_panel("roll_sum", sum_5=S.roll("sum", "volume", 5), sum_21=S.roll("sum", "volume", 21))
on_panel("roll_max_min", max_63=S.roll("max", "close", 63), min_63=S.roll("min", "close", 63))
on_panel("pct_change", p1=S.pct_change("close", 1), p21=S.pct_change("close", 21))
on_panel("strict_past_roll", past_mean_21=S.strict_past("avg", "close", 21), past_std_63=S.strict_past("stddev_pop", "r1", 63), past_max_52=S.strict_past("max", "close", 52))
on_panel("trailing_z", z_52=S.z_trailing("close", 52, 20))
on_panel("forward_returns", **{f"fwd_{h}": f"{S.shift('close', -(h + 1))} / nullif({S.shift('close', -1)}, 0) - 1" for h in (1, 5, 21)})
on_panel("yoy", yoy=S.pct_change("close", 52))
on_panel("momentum_skip", mom_52_4=f"{S.shift('close', 4)} / nullif({S.shift('close', 52)}, 0) - 1")
on_panel("cumsum_obv", obv="sum(coalesce(sign(r1), 0) * coalesce(volume, 0)) over (partition by symbol order by t_idx rows between unbounded preceding and current row)")
on_panel("cs_zscore", z=S.cs_zscore("case when tradable then close end"))
on_panel("cs_demean", d=S.cs_demean("case when tradable then close end"))
on_panel("cs_rank", r=S.cs_rank("case when tradable then r1 end"))
on_panel("cs_rank_avg_ties", r=S.cs_rank_avg("case when tradable then volume end"))


@query("ts_rank")
def _ts_rank(c: Chain) -> str:
    P.panel(c)
    f = S.trailing(21)
    c.add("o", f"select symbol, t_idx, {c.d.count_below('close', f)} as below, count(close) over {f} as n from panel")
    return c.select("select symbol, t_idx, round(case when n > 1 then below / (n - 1.0) end, 6) as ts_rank_21 from o")


@query("roll_moment_skew_kurt")
def _moments(c: Chain) -> str:
    price_features(c)
    return c.select(f"select symbol, t_idx, {rounded('skew_63', 'kurt_63', digits=5)} from feats")


@query("rsi")
def _rsi(c: Chain) -> str:
    price_features(c)
    return c.select(f"select symbol, t_idx, {rounded('rsi_14', digits=5)} from feats")


@query("cumprod_equity")
def _equity(c: Chain) -> str:
    P.returns(c)
    c.add("o", "select symbol, t_idx, exp(sum(ln(1 + ret)) over (partition by symbol order by t_idx rows between unbounded preceding and current row)) as equity from rets")
    return c.select(f"select symbol, t_idx, {rounded('equity')} from o")


@query("rolling_median")
def _median(c: Chain) -> str:
    P.panel(c)
    c.add("o", f"select symbol, t_idx, {c.d.percentile('dv', 0.5)} over {S.trailing(20)} as med from panel")
    return c.select(f"select symbol, t_idx, {rounded('med', digits=3)} from o")


@query("liquidity_rank")
def _liquidity(c: Chain) -> str:
    P.panel(c)
    med = f"{c.d.percentile('case when dv > 0 then dv end', 0.5)} over {S.before(60)}"
    c.add("o", f"select symbol, t_idx, case when t_idx >= 60 then {med} end as liq from panel")
    return c.select(f"select symbol, t_idx, {rounded('liq', digits=3)} from o")


@query("ffill")
def _ffill(c: Chain) -> str:
    P.panel(c)
    c.add("g", f"select *, {S.ffill_group('close')} as close_grp from panel")
    return c.select(f"select symbol, t_idx, {S.ffill('close')} as close from g")


@query("circular_shift")
def _circular(c: Chain) -> str:
    P.panel(c)
    c.add("n", "select cast(count(*) as int) as n from sessions")
    return c.select("select p.symbol, cast((p.t_idx + 52) % n.n as int) as t_idx, p.close from panel p, n")


@query("ema_macd")
def _macd(c: Chain) -> str:
    P.panel(c)
    ema("close", 12, c, "panel", "e1")
    ema("close", 26, c, "e1", "e2")
    c.add("m", "select *, close_ema12 - close_ema26 as macd from e2")
    ema("macd", 9, c, "m", "e3")
    c.add("o", f"select symbol, t_idx, (macd - macd_ema9) / ({S.at_least('close')}) as macd_hist from e3")
    return c.select(f"select symbol, t_idx, {rounded('macd_hist')} from o")


def _family(family: str) -> Text:
    names = [n for n in PRICE_FEATURES if family_of(n) == family]

    def text(c: Chain) -> str:
        price_features(c)
        return c.select(f"select symbol, t_idx, {rounded(*names, digits=5)} from feats")

    return text


def from_slabs(names: tuple[str, ...], digits: int):
    """The same columns unpacked from slabs; no dense panel is sorted, joined or written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kept_slabs(spark, sf_dir).columns(names).selectExpr("symbol", "t_idx", *rounded_each(*names, digits=digits))

    return run


QUERIES = {"ema_macd": from_slabs(("macd_hist",), 6)}
for _name in FAMILIES:
    if _names := tuple(n for n in PRICE_FEATURES if family_of(n) == _name):
        TEXTS[f"features_{_name}"] = _family(_name)
        QUERIES[f"features_{_name}"] = from_slabs(_names, 5)


@query("broadcast_macro")
def _broadcast(c: Chain) -> str:
    P.macro(c)
    return c.select(f"select p.symbol, p.t_idx, p.close, round(m.m_px + 1.73e-7, 5) as m_px from panel p join macro m on p.t_idx = m.t_idx")


@query("feature_families")
def _families(c: Chain) -> str:
    c.values("names", "name", ((n,) for n in PRICE_FEATURES))
    cases = " ".join(f"when {' or '.join(f'''substr(name, 1, {len(p)}) = '{p}' ''' for p in ps)} then '{f}'" for f, ps in FAMILIES.items())
    return c.select(f"select name, case {cases} else 'other' end as family from names")


#: Sessions of the rolling quantile range, and its quantiles.
RANGE_WINDOW, RANGE_LOW, RANGE_HIGH = 21, 0.1, 0.9


@query("roll_quantile_range")
def _quantile_range(c: Chain) -> str:
    """Spread between a high and a low quantile of the returns of the sessions before each one."""
    P.panel(c)
    f = S.before(RANGE_WINDOW)
    c.add("o", f"select symbol, t_idx, case when t_idx >= {RANGE_WINDOW} then {c.d.percentile('r1', RANGE_HIGH)} over {f} - {c.d.percentile('r1', RANGE_LOW)} over {f} end as spread from panel")
    return c.select(f"select symbol, t_idx, {rounded('spread')} from o")


def quantile_range(x: np.ndarray, axis: int) -> np.ndarray:
    """The spread of those that are there, all windows at once; a window of none has none."""
    s = np.sort(np.moveaxis(x, axis, -1), axis=-1)  # the missing come last
    n = (~np.isnan(s)).sum(axis=-1)

    def quantile(p: float) -> np.ndarray:
        at = p * np.maximum(n - 1, 0)
        i = np.floor(at).astype(np.int64)
        lo, hi = (np.take_along_axis(s, np.minimum(k, np.maximum(n - 1, 0))[..., None], -1)[..., 0] for k in (i, i + 1))
        return lo + (hi - lo) * (at - i)

    return np.where(n > 0, quantile(RANGE_HIGH) - quantile(RANGE_LOW), np.nan)


def roll_quantile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a function of numpy over the engine's frames."""

    def rows(c: Chain) -> str:
        P.panel(c)
        return c.select("select symbol, t_idx, r1 from panel")

    def text(c: Chain) -> str:
        return c.select(f"select symbol, t_idx, {rounded('spread')} from rolled")

    rolled = roll_apply(to_spark(rows)(spark, sf_dir), F.col("r1"), quantile_range, RANGE_WINDOW, "spread", past=True)
    return to_spark(text, rolled=rolled)(spark, sf_dir)


QUERIES["roll_quantile_range"] = roll_quantile_range
