"""A population backtested over folds in one plan, and its fitness.

Every strategy is a key beside the fold. A strategy names a window of sessions, which is cut into
folds that start flat; a fold's rebalance rows follow from its first session and the strategy's own
interval. Scores are read at those rows alone, ranked within (strategy, session), held by joins
of equal (symbol, session), and drifted by windows within a block, as in the single backtest. The
number of joins and exchanges does not depend on the number of strategies.
"""

from __future__ import annotations

from collections.abc import Iterable

from tessera.functions import series as S
from tessera.plans.sql import Chain
from tessera.sources import panel as P

from . import evaluation as E
from . import expression as X
from .genome import Genome

#: Days between the first sessions of two folds in the order of a strategy's stitched series: more than any fold has.
STEP = 1_000_000
#: Folds, sessions left out at inner edges, and sessions that a fold needs.
FOLDS, EMBARGO, LEAST = 7, 2, 20
# Fixed: fitness modes, parsimony modes, and the limits beyond which fitness is docked.
MODES = ("ir", "consistency", "median_alpha", "novelty")
PARSIMONY = ("linear", "bic")
PER_NODE, MOST_TURNOVER, LEAST_TRADES, HUG = 0.01, 30.0, 100, 0.90
# Fixed: edges of the archive's cells, scales of the behaviour's axes, neighbours and elites that novelty looks at.
TURNOVER_EDGES = (0.5, 1.5, 3.0, 6.0, 12.0, 25.0)
CORR_EDGES = (0.70, 0.85, 0.92, 0.96, 0.99)
SIZE_EDGES = (5, 10, 20, 40)
SCALES = (10.0, 0.25, 15.0)
NEIGHBOURS, ELITES = 8, 200


def genes(c: Chain, rows: Iterable[tuple[str, str, Genome]]) -> str:
    """Relation ``gene``: strategy, win (the window it trades in), k, rb, by_score, size."""
    c.values("gene", "strategy, win, k, rb, by_score, size", ((s, w, g.positions, g.interval, int(g.weighting == "score"), g.tree.size()) for s, w, g in rows))
    return "gene"


def long_scores(c: Chain, frm: str, names: Iterable[str]) -> str:
    """Relation ``lng``: (strategy, symbol, t_src, score), the present scores of the wide relation ``frm``."""
    names = tuple(names)
    if c.d.name == "spark":
        pairs = ", ".join(f"'{n}', round({n}, 8)" for n in names)
        c.add("lng_all", f"select symbol, t_idx as t_src, strategy, score from {frm} lateral view stack({len(names)}, {pairs}) __s as strategy, score")
    else:
        c.add("lng_all", " union all ".join(f"select symbol, t_idx as t_src, '{n}' as strategy, round({n}, 8) as score from {frm}" for n in names))
    c.add("lng", "select * from lng_all where score is not null")
    return "lng"


def whole(c: Chain, win: str = "all") -> str:
    """Relation ``span_w``: one window of all sessions."""
    P.sessions(c)
    c.add("span_w", f"select '{win}' as win, 0 as a, max(t_idx) + 1 as b from sessions")
    return "span_w"


def pieces(c: Chain, folds: int = FOLDS, embargo: int = EMBARGO, least: int = LEAST) -> str:
    """Relation ``piece``: (win, f, lo, hi), each window of ``span_w`` (win, a, b) in equal folds less the embargo at inner edges."""
    c.values("fold_no", "f", ((f,) for f in range(folds)))
    lo = f"a + floor(f * (b - a) / {folds}e0) + case when f > 0 then {embargo} else 0 end"
    hi = f"a + floor((f + 1) * (b - a) / {folds}e0) - case when f < {folds - 1} then {embargo} else 0 end"
    c.add("piece", f"select win, f, cast(lo as int) as lo, cast(hi as int) as hi from (select win, f, {lo} as lo, {hi} as hi from span_w cross join fold_no) q where hi - lo >= {least}")
    return "piece"


def candidates(c: Chain, shift: str = "0") -> str:
    """Relation ``cand``: scores of ``lng`` at every rebalance row, for names that can be traded there.

    ``shift`` (an expression over ``gene``) is how many sessions earlier, round the calendar, the score is from.
    """
    P.returns(c)
    c.add("gp", "select g.*, p.f, p.lo, p.hi from gene g join piece p on p.win = g.win")
    c.add("gp_e", f"select gp.*, j from gp {c.d.explode(c.d.sequence('0', 'cast(floor((hi - 2 - lo) / cast(rb as double)) as int)'), 'j')}")
    c.add("cal_n", "select max(t_idx) + 1 as n_t from sessions")
    t = "lo + j * rb"
    c.add("reb", f"select strategy, k, rb, by_score, f, lo, hi, cast(j as int) as blk, {t} as t_idx, cast((({t} - ({shift})) % n_t + n_t) % n_t as int) as t_src from gp_e cross join cal_n")
    at = "select r.strategy, r.k, r.rb, r.by_score, r.f, r.lo, r.hi, r.blk, r.t_idx, l.symbol, l.score from lng l join reb r on r.strategy = l.strategy and r.t_src = l.t_src"
    c.add("cand", f"select a.* from ({at}) a join rets x on x.symbol = a.symbol and x.t_idx = a.t_idx where x.tradable")
    return "cand"


def books(c: Chain, most: int) -> str:
    """Relation ``pick``: (strategy, f, blk, lo, hi, rb, symbol, w) of every strategy's best names; ``most`` is the largest book."""
    # A literal limit lets tasks drop what cannot be picked before they exchange it.
    c.add("cand_r", "select *, row_number() over (partition by strategy, f, t_idx order by score desc, symbol) as rn from cand")
    c.add("cand_k", f"select * from cand_r where rn <= {most} and rn <= k")
    c.add("pick_lo", "select *, min(score) over (partition by strategy, f, t_idx) as least_score from cand_k")
    c.add("pick_w", "select *, case when by_score = 1 then score - least_score + 1e-12 else 1e0 end as raw from pick_lo")
    c.add("pick", "select strategy, f, blk, lo, hi, rb, symbol, raw / sum(raw) over (partition by strategy, f, t_idx) as w from pick_w", keep=True)
    return "pick"


def trade(c: Chain, cost: float = E.SLIPPAGE) -> str:
    """Relation ``day``: (strategy, f, t_idx, nth, ret, bench, turnover, trades) of every strategy and fold; ``nth`` orders a strategy's stitched series."""
    E.benchmark(c)
    P.expand(c, "pick", "lo + blk * rb + 1", "least(lo + blk * rb + rb, hi - 1)", "held")
    path = "(partition by h.strategy, h.f, h.blk, h.symbol order by h.t_idx rows between unbounded preceding and current row)"
    c.add("val", f"select h.strategy, h.f, h.blk, h.rb, h.lo, h.hi, h.symbol, h.t_idx, h.w * {S.growth('x.ret', path)} as v from held h join rets x on x.symbol = h.symbol and x.t_idx = h.t_idx", keep=True)
    c.add("val_t", "select strategy, f, blk, t_idx, sum(v) as pv from val group by strategy, f, blk, t_idx")
    c.add("ret_t", "select strategy, f, t_idx, pv / nullif(coalesce(lag(pv) over (partition by strategy, f, blk order by t_idx), 1e0), 0) - 1 as r from val_t")
    c.add("val_e", "select v.*, blk + 1 as nxt, sum(v) over (partition by strategy, f, blk) as pv from val v where t_idx = least(lo + blk * rb + rb, hi - 1)")
    c.add("sides", "select strategy, f, blk, symbol, w as w_new, 0e0 as w_old from pick union all select strategy, f, nxt, symbol, 0e0, v / nullif(pv, 0) from val_e")
    c.add("moved", "select strategy, f, blk, symbol, abs(sum(w_new) - sum(w_old)) as dw from sides group by strategy, f, blk, symbol")
    c.add("rebs", "select distinct strategy, f, blk, lo, rb from reb")
    c.add("trn", "select r.strategy, r.f, r.lo + r.blk * r.rb as t_idx, sum(dw) as tno, count(case when dw > 1e-6 then 1 end) as trades from moved m join rebs r on r.strategy = m.strategy and r.f = m.f and r.blk = m.blk group by r.strategy, r.f, r.blk, r.lo, r.rb")
    P.expand(c, "gp", "lo", "hi - 1", "gp_t")
    c.add("day", f"""select d.strategy, d.f, d.t_idx, cast(d.f as bigint) * {STEP} + d.t_idx as nth, coalesce(r.r, 0) - coalesce(p.tno * {cost}, 0) as ret, b.bench, coalesce(y.tno, 0) as turnover, coalesce(y.trades, 0) as trades
        from gp_t d join bench b on b.t_idx = d.t_idx
        left join ret_t r on r.strategy = d.strategy and r.f = d.f and r.t_idx = d.t_idx
        left join trn p on p.strategy = d.strategy and p.f = d.f and p.t_idx = d.t_idx - 1
        left join trn y on y.strategy = d.strategy and y.f = d.f and y.t_idx = d.t_idx""", keep=True)
    return "day"


def summary(c: Chain, frm: str = "day", name: str = "cvs") -> str:
    """Relation ``name``: per strategy of ``frm`` the figures over its folds; folds that were never traded in are left out."""
    y = S.YEAR
    c.add("fold_s", f"""select strategy, f, avg(ret - coalesce(beta, 0) * bench) * {y}e0 as alpha, avg(ret - bench) / ({S.at_least('stddev_samp(ret - bench)')}) * sqrt({y}e0) as ir,
        sum(turnover) / (count(*) / {y}e0) as ann_turnover, sum(trades) as trades
        from (select d.*, covar_samp(ret, bench) over (partition by strategy, f) / nullif(var_samp(bench) over (partition by strategy, f), 0) as beta from {frm} d) q group by strategy, f having sum(trades) > 0""")
    c.add("day_b", f"select d.*, covar_samp(d.ret, d.bench) over (partition by d.strategy) / nullif(var_samp(d.bench) over (partition by d.strategy), 0) as beta from {frm} d join fold_s s on s.strategy = d.strategy and s.f = d.f")
    c.add("corr_s", f"select strategy, {S.corr('ret', 'bench')} as corr_bench, count(*) as n_obs from day_b group by strategy")
    c.add("resid", "select strategy, nth as t_idx, ret - coalesce(beta, 0) * bench as x from day_b")
    E.newey_west(c, "resid", "x", "resid_t", key="strategy")
    c.add("fold_a", f"select strategy, count(*) as folds, avg(case when alpha > 0 then 1e0 else 0e0 end) as frac_positive, avg(alpha) as mean_alpha, {c.d.percentile('alpha', 0.5)} as median_alpha, min(alpha) as worst_alpha, avg(ir) as mean_ir, avg(ann_turnover) as ann_turnover, cast(sum(trades) as bigint) as n_trades from fold_s group by strategy")
    c.add(name, "select a.*, t.t as alpha_t, coalesce(r.corr_bench, 0e0) as corr_bench, r.n_obs, w.b - w.a as n_sessions, g.size, g.k, g.rb, g.by_score, g.win from fold_a a join gene g on g.strategy = a.strategy join span_w w on w.win = g.win join corr_s r on r.strategy = a.strategy join resid_t t on t.g = a.strategy", keep=True)
    return name


def _bin(x: str, edges: Iterable[float]) -> str:
    """How many edges lie below ``x``."""
    return "(" + " + ".join(f"case when {x} > {e} then 1 else 0 end" for e in edges) + ")"


def novelty(c: Chain, frm: str = "cvs", name: str = "nov") -> str:
    """Relation ``name``: (strategy, novelty), the mean distance of its behaviour to the nearest elites of other cells' and its own.

    Elites are the best of each cell by information ratio, at most ``ELITES`` of
    them; a strategy does not meet itself. With fewer than two elites all is novel.
    """
    c.add("beh", f"select strategy, win, mean_ir, ann_turnover as b1, abs(corr_bench) as b2, cast(size as double) as b3, {_bin('round(ann_turnover, 9)', TURNOVER_EDGES)} * 100 + {_bin('round(abs(corr_bench), 9)', CORR_EDGES)} * 10 + {_bin('size', SIZE_EDGES)} as cell from {frm}")
    c.add("elite_c", "select *, row_number() over (partition by win, cell order by round(mean_ir, 9) desc, strategy) as rn from beh")
    c.add("elite", "select *, row_number() over (partition by win order by round(mean_ir, 9) desc, strategy) as place, count(*) over (partition by win) as n from elite_c where rn = 1")
    s = SCALES
    gap = " + ".join(f"(p.b{i} - q.b{i}) * (p.b{i} - q.b{i}) / {s[i - 1] ** 2}e0" for i in (1, 2, 3))
    c.add("gap", f"select p.strategy, q.strategy as other, sqrt({gap}) as d from beh p join elite q on p.win = q.win and p.strategy <> q.strategy where q.place <= {ELITES} and q.n >= 2")
    c.add("gap_r", "select *, row_number() over (partition by strategy order by d, other) as rn from gap")
    c.add("gap_m", f"select strategy, avg(d) as novelty from gap_r where rn <= {NEIGHBOURS} group by strategy")
    c.add(name, "select b.strategy, coalesce(m.novelty, 1e0) as novelty from beh b left join gap_m m on m.strategy = b.strategy")
    return name


def fitness(c: Chain, sessions: str = "n_sessions", name: str = "fit") -> str:
    """Relation ``name``: ``cvs`` with a column ``mode_parsimony`` for every way to be fit.

    Docked alike in all: hugging the index beyond a correlation of 0.9, turnover
    beyond what is payable, too few trades; and size, by a constant for each node
    or by ln(n) / 2n of ``sessions``.
    """
    novelty(c)
    base = {"ir": "mean_ir * (0.5 + 0.5 * frac_positive)", "consistency": "mean_ir * frac_positive * frac_positive", "median_alpha": "median_alpha * (0.5 + 0.5 * frac_positive)", "novelty": "v.novelty + 0.05 * mean_ir"}
    dock = f"case when abs(corr_bench) > {HUG} then 2 * pow((abs(corr_bench) - {HUG}) / 0.1, 2) else 0 end + case when ann_turnover > {MOST_TURNOVER} then 0.5 * (ann_turnover / {MOST_TURNOVER} - 1) else 0 end + case when n_trades < {LEAST_TRADES} then 1 else 0 end"
    size = {"linear": f"{PER_NODE} * size", "bic": f"size * ln(greatest({sessions}, 2)) / (2 * greatest({sessions}, 2)) * 100"}
    cols = ", ".join(f"({base[m]}) - ({dock}) - ({size[p]}) as {m}_{p}" for m in MODES for p in PARSIMONY)
    c.add(name, f"select s.*, v.novelty, {cols} from cvs s join nov v on v.strategy = s.strategy", keep=True)
    return name


FITNESS = tuple(f"{m}_{p}" for m in MODES for p in PARSIMONY)
FIGURES = ("frac_positive", "mean_alpha", "median_alpha", "worst_alpha", "mean_ir", "ann_turnover", "alpha_t", "corr_bench")


def evaluate(c: Chain, frm: str, genomes: list[Genome], folds: int = FOLDS, embargo: int = EMBARGO, least: int = LEAST, cost: float = E.SLIPPAGE) -> str:
    """Relation ``cvs`` of genomes over all sessions; ``frm`` has the features that their trees read."""
    scores = X.compile_population(c, frm, {g.id: g.tree for g in genomes})
    c.kept.add(scores)
    long_scores(c, scores, [g.id for g in genomes])
    genes(c, [(g.id, "all", g) for g in genomes])
    whole(c)
    pieces(c, folds, embargo, least)
    candidates(c)
    books(c, max(g.positions for g in genomes))
    trade(c, cost)
    return summary(c)
