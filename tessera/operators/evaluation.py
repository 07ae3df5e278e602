"""Portfolio simulation and statistics as relations.

The drifted book of a block depends on the block before it alone, so a
block-rebalanced backtest is joins and windows, not a loop.
"""

from __future__ import annotations

from tessera.functions import series as S
from tessera.plans.sql import Chain
from tessera.sources import panel as P

TRADING_DAYS = float(S.YEAR)
SLIPPAGE = 5e-4
#: Names that a session needs for a coefficient.
LEAST_NAMES = 20


def score_momentum(c: Chain) -> str:
    """Relation ``score``: cross-sectional rank of the 21-session momentum of tradable names."""
    P.returns(c)
    c.add("mom", f"select *, {S.pct_change('close', 21)} as mom_21 from rets")
    c.add("score", f"select symbol, t_idx, tradable, ret, {S.cs_rank('case when tradable then round(mom_21, 9) end')} as score from mom", keep=True)
    return "score"


def top_k(c: Chain, k: int, rb: int, by_score: bool = False) -> str:
    """Relation ``w``: weights (blk, symbol, w) of the best ``k`` at every rebalance row."""
    c.add("span_t", "select max(t_idx) + 1 as n_t from score")
    c.add("rk", f"""select s.symbol, s.t_idx, s.score, row_number() over (partition by s.t_idx order by s.score desc, s.symbol) as rn
        from score s, span_t where s.t_idx % {rb} = 0 and s.t_idx < n_t - 1 and s.tradable and s.score is not null""")
    c.add("pick", f"select cast(floor(t_idx / {rb}) as int) as blk, symbol, score, min(score) over (partition by t_idx) as lo, count(*) over (partition by t_idx) as n from rk where rn <= {k}")
    raw = "(score - lo + 1e-12)" if by_score else "1e0"
    c.add("w", f"select blk, symbol, {raw} / sum({raw}) over (partition by blk) as w from pick")
    return "w"


def benchmark(c: Chain) -> str:
    """Relation ``bench``: yesterday's tradable names, today's mean return."""
    P.returns(c)
    c.add("prevm", f"select t_idx, ret, case when {S.shift('tradable', 1)} then 1 else 0 end as m from rets")
    c.add("bench", "select t_idx, coalesce(sum(m * ret) / greatest(sum(m), 1), 0) as bench from prevm group by t_idx")
    return "bench"


def backtest(c: Chain, k: int = 25, rb: int = 5, cost: float = SLIPPAGE, by_score: bool = False) -> str:
    """Relation ``bt``: t_idx, ret, bench, turnover, from ``score``."""
    top_k(c, k, rb, by_score)
    benchmark(c)
    c.add("days", f"select distinct t_idx, cast(floor((t_idx - 1) / {rb}) as int) as blk from score where t_idx >= 1")
    c.add("hold", f"select d.blk, d.t_idx, w.symbol, w.w * {S.growth('s.ret', '(partition by w.symbol, d.blk order by d.t_idx rows between unbounded preceding and current row)')} as v from w join days d on d.blk = w.blk join score s on s.symbol = w.symbol and s.t_idx = d.t_idx")
    c.add("pv", "select blk, t_idx, sum(v) as pv from hold group by blk, t_idx")
    c.add("blk_ret", "select blk, t_idx, pv / coalesce(lag(pv) over (partition by blk order by t_idx), 1e0) - 1 as r from pv")
    c.add("ends", "select blk, max(t_idx) as t_end from days group by blk")
    c.add("drift", "select h.blk + 1 as blk, h.symbol, h.v / p.pv as w from hold h join ends e on h.blk = e.blk and h.t_idx = e.t_end join pv p on p.blk = h.blk and p.t_idx = h.t_idx")
    c.add("both_books", "select blk, symbol, w as w_new, 0e0 as w_old from w union all select blk, symbol, 0e0, w from drift")
    c.add("moves", "select blk, symbol, abs(sum(w_new) - sum(w_old)) as dw from both_books group by blk, symbol")
    c.add("turn", "select m.blk, sum(dw) as tno, count(case when dw > 1e-6 then 1 end) as trades from moves m join ends e on m.blk = e.blk group by m.blk")
    c.add("bt", f"""select b.t_idx, coalesce(r.r, 0) - coalesce(x.tno * {cost}, 0) as ret, b.bench, coalesce(y.tno, 0) as turnover
        from bench b left join blk_ret r on r.t_idx = b.t_idx
        left join turn x on b.t_idx = x.blk * {rb} + 1 left join turn y on b.t_idx = y.blk * {rb}""", keep=True)
    return "bt"


def newey_west(c: Chain, frm: str, x: str, name: str, lags: str = "greatest(1, floor(4 * pow(n / 100e0, 2e0 / 9)))", key: str = "1") -> str:
    """Relation ``name``: (g, n, mean, t) of ``x`` per key, robust to autocorrelation.

    Every row is dealt once for each of its key's lags and meets the one row so
    many before it, by equal keys. The variance is floored at 1e-12.
    """
    c.add(f"{name}_x", f"select {key} as g, t_idx, {x} as x, row_number() over (partition by {key} order by t_idx) as i from {frm} where {x} is not null")
    c.add(f"{name}_m", f"select g, count(*) as n, avg(x) as m from {name}_x group by g")
    c.add(f"{name}_e", f"select a.g, a.i, a.x - b.m as e, b.n, b.m, cast({lags.replace('n /', 'b.n /')} as int) as lags from {name}_x a join {name}_m b on a.g = b.g")
    c.add(f"{name}_l", f"select g, i, e, n, lags, d from (select * from {name}_e where lags >= 1) q {c.d.explode(c.d.sequence('1', 'lags'), 'd')}")
    c.add(f"{name}_c", f"select a.g, sum(2 * (1 - a.d / (a.lags + 1e0)) * a.e * b.e / a.n) as s from {name}_l a join {name}_e b on a.g = b.g and b.i = a.i - a.d group by a.g")
    c.add(f"{name}_v", f"select g, max(n) as n, max(m) as m, sum(e * e) / max(n) as v from {name}_e group by g")
    c.add(name, f"select v.g, v.n, v.m as mean, case when v.n < 20 then 0e0 else v.m / sqrt(greatest(v.v + coalesce(c.s, 0), 1e-12) / v.n) end as t from {name}_v v left join {name}_c c on v.g = c.g")
    return name


def stats(c: Chain, frm: str = "bt", key: str = "1", name: str = "st") -> str:
    """Relation ``name``: one row of statistics per key of ``frm`` (t_idx, ret, bench, turnover)."""
    up = f"(partition by {key} order by t_idx rows between unbounded preceding and current row)"
    c.add(f"{name}_q", f"select {key} as g, t_idx, ret, bench, turnover, {S.growth('ret', up)} as eq, {S.growth('bench', up)} as beq from {frm}")
    top = "(partition by g order by t_idx rows between unbounded preceding and current row)"
    c.add(f"{name}_d", f"select *, eq / nullif(max(eq) over {top}, 0) - 1 as dd, beq / nullif(max(beq) over {top}, 0) - 1 as bdd from {name}_q", keep=True)
    y = f"(count(*) / {TRADING_DAYS}e0)"
    c.add(f"{name}_a", f"""select g, count(*) as n_days, pow({S.growth('ret')}, 1 / {y}) - 1 as cagr, pow({S.growth('bench')}, 1 / {y}) - 1 as bench_cagr,
        avg(ret) / ({S.at_least('stddev_samp(ret)')}) * sqrt({TRADING_DAYS}e0) as sharpe, stddev_samp(ret) * sqrt({TRADING_DAYS}e0) as vol_ann,
        min(dd) as max_dd, min(bdd) as bench_max_dd, covar_samp(ret, bench) / nullif(var_samp(bench), 0) as beta, {S.corr('ret', 'bench')} as corr_bench,
        avg(ret - bench) / ({S.at_least('stddev_samp(ret - bench)')}) * sqrt({TRADING_DAYS}e0) as ir, avg(case when ret > bench then 1e0 else 0e0 end) as hit_rate,
        sum(turnover) / {y} as ann_turnover from {name}_d group by g""")
    c.add(f"{name}_r", f"select d.g, d.t_idx, d.ret - a.beta * d.bench as resid from {name}_d d join {name}_a a on a.g = d.g")
    newey_west(c, f"{name}_r", "resid", f"{name}_nw", key="g")
    c.add(name, f"select a.*, w.mean * {TRADING_DAYS}e0 as alpha_ann, w.t as alpha_tstat from {name}_a a left join {name}_nw w on a.g = w.g")
    return name


STATS = ("cagr", "bench_cagr", "sharpe", "vol_ann", "max_dd", "bench_max_dd", "beta", "corr_bench", "ir", "hit_rate", "ann_turnover", "alpha_ann", "alpha_tstat")


def ic_series(c: Chain, frm: str, x: str, name: str, h: int = 5, least: int = LEAST_NAMES, key: str = "1") -> str:
    """Relation ``name``: (g, t_idx, ic, n), the rank correlation of ``x`` with the forward return per session."""
    P.panel(c)
    c.add("fwd_h", f"select symbol, t_idx, round({S.shift('close', -(h + 1))} / nullif({S.shift('close', -1)}, 0) - 1, 9) as fwd, tradable from panel")
    c.add(f"{name}_p", f"select {key} as g, a.t_idx, a.symbol, a.{x} as x, f.fwd from {frm} a join fwd_h f on f.symbol = a.symbol and f.t_idx = a.t_idx where f.tradable and f.fwd is not null and a.{x} is not null")
    c.add(f"{name}_r", f"select g, t_idx, {S.cs_rank_avg('x', 'g, t_idx')} as rx, {S.cs_rank_avg('fwd', 'g, t_idx')} as ry from {name}_p")
    c.add(name, f"select g, t_idx, {S.corr('rx', 'ry')} as ic, count(*) as n from {name}_r group by g, t_idx having count(*) >= {least} and stddev_pop(rx) > 1e-9 and stddev_pop(ry) > 1e-9", keep=True)
    return name
