"""Queries that evaluate scores: backtests, information coefficients, multiple testing."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import series as S
from tessera.operators import evaluation as E
from tessera.operators import expression as X
from tessera.operators.features import PRICE_FEATURES, family_of, price_features
from tessera.operators.slabs import Slabs
from tessera.session import scratch
from tessera.sources import panel as P

from .sql import Chain, Text, rounded, to_spark

TEXTS: dict[str, Text] = {}
#: Sessions with a coefficient that a feature needs to be scored.
LEAST_IC_DAYS = 60
#: Sessions ahead that the features' coefficients look, and names that one needs.
IC_HORIZON, LEAST_IC_NAMES = 5, E.LEAST_NAMES
#: Features whose spreads stand in for published factors: none of them is a momentum.
SPREADS = ("vol_63", "amihud_21", "clv", "vol_surge", "beta_126", "dollar_vol_21")


def query(name: str):
    def add(f: Text) -> Text:
        TEXTS[name] = f
        return f

    return add


def daily(c: Chain, **how) -> str:
    E.score_momentum(c)
    return E.backtest(c, **how)


@query("benchmark_equal_weight")
def _bench(c: Chain) -> str:
    E.benchmark(c)
    return c.select(f"select t_idx, {rounded('bench', digits=8)} from bench")


@query("topk_equal")
def _topk(c: Chain) -> str:
    E.score_momentum(c)
    E.top_k(c, 25, 5)
    return c.select(f"select blk, symbol, {rounded('w')} from w")


@query("topk_score_weight")
def _topk_score(c: Chain) -> str:
    E.score_momentum(c)
    E.top_k(c, 25, 21, by_score=True)
    return c.select(f"select blk, symbol, {rounded('w')} from w")


@query("latest_picks")
def _picks(c: Chain) -> str:
    E.score_momentum(c)
    return c.select("select symbol, round(score, 6) as score from (select s.*, max(t_idx) over () as last_t from score s where tradable and score is not null) q where t_idx = last_t order by score desc, symbol limit 10")


@query("backtest_daily")
def _daily(c: Chain) -> str:
    daily(c)
    return c.select(f"select t_idx, {rounded('ret', 'bench', 'turnover', digits=8)} from bt")


@query("backtest_stats")
def _stats(c: Chain) -> str:
    daily(c)
    E.stats(c)
    return c.select(f"select n_days, {rounded(*E.STATS)} from st")


@query("newey_west_t")
def _nw(c: Chain) -> str:
    daily(c)
    E.newey_west(c, "bt", "ret", "nw")
    return c.select(f"select n, {rounded('mean', 't', digits=7)} from nw")


#: Sessions between the calendars of two folds: more than any has, and a multiple of every rebalance interval used.
FOLD_STEP = 1_000_000


def fold_edges(n: str, f: str, n_splits: int, embargo: int) -> tuple[str, str]:
    """First and end session of fold ``f``: equal blocks of the whole calendar less the embargo at inner edges."""
    lo = f"floor({f} * {n} / {n_splits}e0) + case when {f} > 0 then {embargo} else 0 end"
    return lo, f"floor(({f} + 1) * {n} / {n_splits}e0) - case when {f} < {n_splits - 1} then {embargo} else 0 end"


def block_folds(c: Chain, n_splits: int = 7, embargo: int = 2, least: int = 20) -> str:
    """Relation ``score`` cut into folds that start flat: each on a calendar of its own, ``t_src`` is the session meant.

    A fold's rows are numbered from its own start, so its first rebalance is its
    first session and no book crosses an edge. Folds below ``least`` sessions are left out.
    """
    E.score_momentum(c)
    c.rename("score", "score_all")
    c.add("fold_n", "select max(t_idx) + 1 as n from score_all")
    lo, hi = fold_edges("n", "f", n_splits, embargo)
    c.add("fold_of", f"select t_idx, n, cast(floor(((t_idx + 1) * {n_splits} - 1) / cast(n as double)) as int) as f from (select distinct t_idx from score_all) q cross join fold_n")
    c.add("fold_t", f"select t_idx, f, {lo} as lo, {hi} as hi from fold_of")
    c.add("fold_ok", f"select t_idx, f, cast(f * {FOLD_STEP} + t_idx - lo as int) as t_new, t_idx = hi - 1 as is_last from fold_t where t_idx >= lo and t_idx < hi and hi - lo >= {least}")
    # Nothing is bought on a fold's last session.
    c.add("score", "select s.symbol, k.t_new as t_idx, s.tradable and not k.is_last as tradable, s.ret, s.score, k.t_idx as t_src from score_all s join fold_ok k on k.t_idx = s.t_idx")
    E.benchmark(c)
    c.rename("bench", "bench_all")
    c.add("bench", "select k.t_new as t_idx, b.bench from fold_ok k join bench_all b on b.t_idx = k.t_idx")
    E.backtest(c)
    c.add("fold", f"select b.*, cast(floor(b.t_idx / {FOLD_STEP}e0) as int) as f from bt b", keep=True)
    return "fold"


@query("cv_folds_stats")
def _cv(c: Chain) -> str:
    """Every fold backtested alone from a flat book; then their spread, and the alpha of the folds in one series."""
    block_folds(c)
    E.stats(c, "fold", "f", "fs")
    c.add("all_beta", "select covar_samp(ret, bench) / nullif(var_samp(bench), 0) as beta, corr(ret, bench) as corr_bench from fold")
    c.add("stitched", "select t_idx, ret - beta * bench as resid from fold cross join all_beta")
    E.newey_west(c, "stitched", "resid", "snw")
    c.add("tr_n", "select sum(trades) as trades from turn")
    c.add("o", f"select count(*) as folds, avg(case when alpha_ann > 0 then 1e0 else 0e0 end) as frac_positive, avg(alpha_ann) as mean_alpha, {c.d.percentile('alpha_ann', 0.5)} as median_alpha, min(alpha_ann) as worst_alpha, avg(ir) as mean_ir, avg(ann_turnover) as ann_turnover from fs")
    names = ("frac_positive", "mean_alpha", "median_alpha", "worst_alpha", "mean_ir", "ann_turnover", "alpha_tstat", "corr_bench")
    c.add("p", "select o.*, w.t as alpha_tstat, b.corr_bench, cast(n.trades as bigint) as n_trades from o cross join snw w cross join all_beta b cross join tr_n n")
    return c.select(f"select folds, n_trades, {rounded(*names)} from p")


@query("cost_stress")
def _stress(c: Chain) -> str:
    daily(c, cost=0.0)
    c.values("mult", "mult", ((m,) for m in (1, 2, 3)))
    c.add("net", f"select m.mult, b.t_idx, b.ret - coalesce(lag(b.turnover) over (partition by m.mult order by b.t_idx), 0) * {E.SLIPPAGE} * m.mult as ret, b.bench, b.turnover from bt b cross join mult m", keep=True)
    E.stats(c, "net", "mult", "cs")
    return c.select(f"select g as mult, {rounded('cagr', 'sharpe', 'alpha_tstat')} from cs")


@query("tracking_error_mde")
def _mde(c: Chain) -> str:
    daily(c)
    c.add("o", f"select stddev_samp(ret - bench) * sqrt({S.YEAR}e0) as te, count(*) / {S.YEAR}e0 as yrs from bt")
    return c.select("select round(te, 6) as te, round(2 * te / sqrt(yrs), 6) as mde from o")


@query("ic_series")
def _ic(c: Chain) -> str:
    E.score_momentum(c)
    E.ic_series(c, "score", "score", "ic")
    return c.select(f"select t_idx, n, {rounded('ic')} from ic")


@query("ic_summary")
def _ic_summary(c: Chain) -> str:
    E.score_momentum(c)
    E.ic_series(c, "score", "score", "ic")
    E.newey_west(c, "ic", "ic", "icn", lags="5")
    c.add("o", f"select count(*) as n, avg(ic) as mean, avg(ic) / nullif(stddev_samp(ic), 0) as ir, avg(case when ic > 1e-9 then 1e0 else 0e0 end) as hit, max(w.t) as t, count(*) >= {LEAST_IC_DAYS} as ok from ic cross join icn w")
    return c.select(f"select n, ok, {rounded('mean', 'ir', 'hit', 't')} from o")


def long_features(c: Chain, frm: str, names: tuple[str, ...], keep: str, key: str, name: str) -> str:
    """Relation ``name``: one row for every feature of a row of ``frm``, from one pass over it."""
    if c.d.name == "spark":
        pairs = ", ".join(f"'{n}', round({n}, 8)" for n in names)
        c.add(name, f"select {keep}, {key}, x from {frm} lateral view stack({len(names)}, {pairs}) __s as {key}, x")
    else:
        c.add(name, " union all ".join(f"select {keep}, '{n}' as {key}, round({n}, 8) as x from {frm}" for n in names))
    return name


def feature_ic(c: Chain, horizon: int = IC_HORIZON) -> str:
    """Relation ``ficm``: every price feature's information coefficient, or why it has none."""
    price_features(c)
    long_features(c, "feats", PRICE_FEATURES, "symbol, t_idx", "feature", "fl")
    E.ic_series(c, "fl", "x", "fic", h=horizon, least=LEAST_IC_NAMES, key="feature")
    c.add("fvar", "select feature, count(x) as seen, max(x) > min(x) as varies from fl group by feature")
    c.add("fic_m", f"select g as feature, avg(ic) as mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*) / {horizon}e0) as t_stat, count(*) as n from fic group by g")
    c.add("ficm", f"select v.feature, coalesce(m.n, 0) as n, case when m.n >= {LEAST_IC_DAYS} then m.mean_ic end as mean_ic, case when m.n >= {LEAST_IC_DAYS} then m.t_stat end as t_stat, case when v.seen > 0 and not v.varies then 'constant' when coalesce(m.n, 0) < {LEAST_IC_DAYS} then 'too few sessions' else 'ok' end as reason from fvar v left join fic_m m on m.feature = v.feature")
    return "ficm"


@query("feature_ic_table")
def _feature_ic(c: Chain) -> str:
    feature_ic(c)
    return c.select(f"select feature, n, reason, {rounded('mean_ic', 't_stat')} from ficm")


@query("family_ic_rollup")
def _rollup(c: Chain) -> str:
    feature_ic(c)
    cases = " ".join(f"when '{n}' then '{family_of(n)}'" for n in PRICE_FEATURES)
    c.add("o", f"select case feature {cases} end as family, avg(abs(mean_ic)) as avg_ic, max(abs(mean_ic)) as max_ic, count(*) as n, count(mean_ic) as scored from ficm group by 1")
    return c.select(f"select family, n, scored, {rounded('avg_ic', 'max_ic')} from o")


def from_slabs(text: Text) -> Callable[[SparkSession, str], DataFrame]:
    """A text on ``feature_ic`` whose coefficients and ranges come from slabs; only those, a row per feature and session, are written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark, "slabs") as at:
            got = Slabs(spark, sf_dir, at).coefficients(IC_HORIZON, LEAST_IC_NAMES)
        fic = got.filter("t_idx >= 0").selectExpr("feature as g", "t_idx", "ic", "n")
        fvar = got.filter("t_idx < 0").selectExpr("feature", "n as seen", "hi > lo as varies")
        return to_spark(text, fic=fic, fvar=fvar)(spark, sf_dir)

    return run


QUERIES = {name: from_slabs(TEXTS[name]) for name in ("feature_ic_table", "family_ic_rollup")}


def variants(c: Chain) -> str:
    """Long relation ``var``: (strategy, t_idx, x), the mean next return of the upper half by several features."""
    price_features(c)
    names = PRICE_FEATURES
    c.add("rl", f"select symbol, t_idx, {S.shift('coalesce(r1, 0)', -1)} as nxt, {', '.join(names)} from feats where tradable", keep=True)
    long_features(c, "rl", names, "symbol, t_idx, nxt", "strategy", "vl")
    c.add("vr", f"select *, {S.cs_rank_avg('x', 'strategy, t_idx')} as rk from vl")
    c.add("var", "select strategy, t_idx, avg(case when rk > 0.5 then nxt end) - avg(nxt) as x from vr where rk is not null and nxt is not null group by strategy, t_idx", keep=True)
    return "var"


@query("rank_ensemble")
def _ensemble(c: Chain) -> str:
    price_features(c)
    ranks = [S.cs_rank_avg(f"case when tradable then round({n}, 8) end") for n in ("mom_21", "vol_63", "clv")]
    c.add("o", f"select symbol, t_idx, ({' + '.join(ranks)}) / 3 as score from feats")
    return c.select(f"select symbol, t_idx, {rounded('score')} from o where score is not null")


@query("effective_trials")
def _trials(c: Chain) -> str:
    """Participation ratio of the correlation matrix: m squared over the sum of squared correlations."""
    variants(c)
    c.add("cc", f"select a.strategy as s1, b.strategy as s2, {S.corr('a.x', 'b.x')} as rho from var a join var b on a.t_idx = b.t_idx group by a.strategy, b.strategy")
    c.add("o", "select sqrt(count(*)) as m, count(*) / sum(rho * rho) as n_eff from cc")
    return c.select(f"select {rounded('m', 'n_eff')} from o")


@query("correlation_pairs")
def _pairs(c: Chain) -> str:
    variants(c)
    c.add("o", f"select a.strategy as s1, b.strategy as s2, {S.corr('a.x', 'b.x')} as rho from var a join var b on a.t_idx = b.t_idx and a.strategy < b.strategy group by a.strategy, b.strategy")
    return c.select(f"select s1, s2, {rounded('rho')} from o")


@query("pbo_cscv")
def _pbo(c: Chain) -> str:
    """Over all half-splits of eight blocks: how the in-sample winner ranks out of sample."""
    variants(c)
    c.add("nb", "select min(t_idx) as t0, max(t_idx) - min(t_idx) + 1 as n from var")
    c.add("bl", "select strategy, cast(floor((t_idx - t0) * 8 / n) as int) as b, count(x) as k, sum(x) as s, sum(x * x) as q from var, nb group by 1, 2")
    combos = [x for x in combinations(range(8), 4)]
    c.values("co", "combo, b", ((i, b) for i, x in enumerate(combos) for b in x))
    c.add("ids", "select distinct combo from co")
    c.add("hv", "select i.combo, l.strategy, case when co.b is null then 0 else 1 end as ins, sum(k) as k, sum(s) as s, sum(q) as q from ids i cross join bl l left join co on co.combo = i.combo and co.b = l.b group by 1, 2, 3")
    c.add("sh", "select combo, strategy, ins, round(s / k / sqrt(greatest((q - s * s / k) / (k - 1), 1e-12)), 9) as sr from hv")
    c.add("win", f"select combo, {c.d.argmax('strategy', 'sr')} as strategy from sh where ins = 1 group by combo")
    c.add("oos", "select w.combo, avg(case when s.sr <= v.sr then 1e0 else 0e0 end) as share, count(*) as m from win w join sh v on v.combo = w.combo and v.strategy = w.strategy and v.ins = 0 join sh s on s.combo = w.combo and s.ins = 0 group by w.combo")
    c.add("lg", "select combo, least(greatest(share, 1e0 / (m + 1)), 1 - 1e0 / (m + 1)) as w from oos")
    return c.select("select count(*) as combos, round(avg(case when ln(w / (1 - w)) <= 0 then 1e0 else 0e0 end), 6) as pbo from lg")


@query("archive_elites")
def _elites(c: Chain) -> str:
    """The best strategy of each cell of binned descriptors."""
    variants(c)
    c.add("ds", "select strategy, avg(x) * 1e4 as fit, stddev_samp(x) * 1e3 as vol from var group by strategy")
    bins = " + ".join(f"case when vol > {e} then 1 else 0 end" for e in (1, 2, 3, 4, 6))
    c.add("cell", f"select strategy, fit, {bins} as cell from ds")
    return c.select(f"select cell, {c.d.argmax('strategy', 'fit')} as elite, round(max(fit), 6) as fit from cell group by cell")


@query("novelty_knn")
def _novelty(c: Chain) -> str:
    """Mean distance of each strategy to its eight nearest in descriptor space."""
    variants(c)
    c.add("ds", "select strategy, avg(x) * 1e4 as a, stddev_samp(x) * 1e3 as b from var group by strategy")
    c.add("pr", "select p.strategy, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) as d, q.strategy as other from ds p join ds q on p.strategy <> q.strategy")
    c.add("rn", "select *, row_number() over (partition by strategy order by d, other) as k from pr")
    c.add("o", "select strategy, avg(d) as novelty from rn where k <= 8 group by strategy")
    return c.select(f"select strategy, {rounded('novelty')} from o")


@query("null_percentiles")
def _null(c: Chain) -> str:
    variants(c)
    c.add("p", "select strategy, avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*)) as t from var group by strategy")
    c.add("o", f"select {c.d.percentile('t', 0.95)} as p95, {c.d.percentile('t', 0.99)} as p99, avg(case when t < 1 then 1e0 else 0e0 end) as below from p")
    return c.select(f"select {rounded('p95', 'p99', 'below')} from o")


@query("shuffle_test")
def _shuffle(c: Chain) -> str:
    """The score moved round the calendar by 24 shifts, and its mean next return each time."""
    E.score_momentum(c)
    c.add("n", "select max(t_idx) + 1 as n from score")
    c.values("sft", "s", ((s,) for s in (0, *(60 + 10 * k for k in range(24)))))
    c.add("mv", "select s.s, symbol, (t_idx + s.s) % n.n as t_idx, score from score, n, sft s where score is not null")
    c.add("nx", f"select symbol, t_idx, {S.shift('ret', -1)} as nxt from score")
    c.add("o", "select m.s, avg(case when score >= 0.8 then nxt end) - avg(nxt) as edge from mv m join nx on nx.symbol = m.symbol and nx.t_idx = m.t_idx group by m.s")
    return c.select(f"select s, {rounded('edge', digits=8)} from o")


@query("experiment_bar")
def _bar(c: Chain) -> str:
    variants(c)
    c.add("t", "select strategy, avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*)) as t from var group by strategy")
    c.add("b", "select greatest(2e0, sqrt(2 * ln(count(*)))) as bar from t")
    return c.select(f"select strategy, {rounded('t')}, t > bar as clears from t, b")


# ---- expressions --------------------------------------------------------------


def expressions(name: str, **trees) -> None:
    """A query with one column per tree over a few price features."""

    def text(c: Chain) -> str:
        price_features(c)
        X.compile_population(c, "feats", trees)
        return c.select(f"select symbol, t_idx, {rounded(*trees, digits=5)} from scored where tradable")

    TEXTS[name] = text


_a, _b, _v = X.feat("mom_5"), X.feat("clv"), X.feat("vol_10")
expressions("expr_unary_pointwise", **{op: X.un(op, _a) for op in X.UNARY}, deep=X.un("sigmoid", X.un("square", _b)))
expressions("expr_unary_cross", **{f"{op}_": X.un(op, _a) for op in X.CROSS})
expressions("expr_unary_time", **{f"{op}_10": X.un(op, _b, 10) for op in X.TIMED})
expressions("expr_binary", **{f"{op}_": X.bi(op, _a, X.feat("intraday_range")) for op in X.BINARY})
expressions("expr_ite", pick=X.ite(_a, _b, X.un("neg", _v)), nested=X.ite(X.bi("sub", _a, _b), X.const(1), X.const(-1)))
expressions("expr_nested_rank_mean", deep=X.un("rank", X.un("tsmean", X.un("rank", _a), 5)), other=X.bi("mul", X.un("zscore", _v), X.un("tsmean", X.un("rank", _a), 5)))
expressions("expr_simplified_equivalence", long_form=X.un("neg", X.un("neg", X.un("rank", X.un("rank", _a)))), short_form=X.un("rank", _a))


# ---- composite studies ----------------------------------------------------------


@query("walk_forward")
def _walk(c: Chain) -> str:
    """In every segment, the variant that was best before it (with an embargo), and what it made in it."""
    variants(c)
    c.add("seg", "select distinct cast(floor(t_idx / 60) as int) as s from var where t_idx >= 60")
    c.add("tr", "select g.s, v.strategy, round(avg(v.x) / nullif(stddev_samp(v.x), 0), 9) as q from seg g join var v on v.t_idx < g.s * 60 - 5 group by g.s, v.strategy having count(*) >= 20")
    c.add("won", "select s, strategy, row_number() over (partition by s order by q desc, strategy) as rn from tr")
    c.add("o", "select w.s, w.strategy, avg(v.x) as oos, count(*) as n from won w join var v on v.strategy = w.strategy and cast(floor(v.t_idx / 60) as int) = w.s where w.rn = 1 group by w.s, w.strategy")
    return c.select(f"select s, strategy, n, {rounded('oos', digits=8)} from o")


@query("ensemble_select_test")
def _select_test(c: Chain) -> str:
    """The three best variants of the first three quarters, averaged, in both parts."""
    variants(c)
    c.add("cutoff", "select max(t_idx) * 0.75 as t from var")
    c.add("q", "select strategy, round(avg(x) / nullif(stddev_samp(x), 0), 9) as q from var, cutoff where t_idx < t group by strategy")
    c.add("best", "select strategy from (select strategy, row_number() over (order by q desc, strategy) as rn from q) z where rn <= 3")
    c.add("e", "select v.t_idx, case when v.t_idx < k.t then 'select' else 'test' end as part, avg(v.x) as x from var v join best b on v.strategy = b.strategy cross join cutoff k group by v.t_idx, k.t")
    c.add("o", "select part, count(*) as n, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) as t from e group by part")
    return c.select(f"select part, n, {rounded('t')} from o")


def on_spreads(text: Text) -> Callable[[SparkSession, str], DataFrame]:
    """A text on ``variants`` whose relation ``var`` comes from slabs: no dense panel is written, a row per feature and session is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark, "slabs") as at:
            return to_spark(text, var=Slabs(spark, sf_dir, at).all_spreads(PRICE_FEATURES))(spark, sf_dir)

    return run


ON_SPREADS = ("effective_trials", "correlation_pairs", "pbo_cscv", "archive_elites", "novelty_knn", "null_percentiles", "experiment_bar", "walk_forward", "ensemble_select_test", "behaviour_duplicates")

#: Constructions of the power study: names on the long and on the short side, sessions held.
DESIGNS = (("top_25_long", 25, 0, 5), ("top_50_long", 50, 0, 5), ("top_100_long", 100, 0, 21), ("decile_long_short", 10, 10, 5), ("quarter_long_short", 25, 25, 21))


@query("power_designs")
def _power(c: Chain) -> str:
    """Tracking error and least detectable excess of several books: the best by score, or both ends, held for a block."""
    E.score_momentum(c)
    c.values("ds", "design, n_long, n_short, hold", DESIGNS)
    c.add("db", "select d.*, s.symbol, s.t_idx as t0, row_number() over (partition by d.design, s.t_idx order by s.score desc, s.symbol) as up, row_number() over (partition by d.design, s.t_idx order by s.score, s.symbol desc) as dn from score s cross join ds d where s.t_idx % d.hold = 0 and s.tradable and s.score is not null")
    c.add("dp", "select design, hold, symbol, t0, case when up <= n_long then 1 else 0 end as l, case when dn <= n_short then 1 else 0 end as s from db where up <= n_long or dn <= n_short")
    P.expand(c, "dp", "t0 + 1", "t0 + hold", "dx")
    E.benchmark(c)
    c.add("dr", "select x.design, x.t_idx, sum(l * r.ret) / nullif(sum(l), 0) - case when max(x.s) = 1 then sum(x.s * r.ret) / nullif(sum(x.s), 0) else max(b.bench) end as x from dx x join score r on r.symbol = x.symbol and r.t_idx = x.t_idx join bench b on b.t_idx = x.t_idx group by x.design, x.t_idx")
    c.add("o", f"select design, count(*) as n, stddev_samp(x) * sqrt({S.YEAR}e0) as te, count(*) / {S.YEAR}e0 as yrs from dr group by design")
    c.add("p", "select design, n, te, 2 * te / sqrt(yrs) as mde from o")
    return c.select(f"select design, n, {rounded('te', 'mde')} from p")


@query("disclosure_book")
def _disclosure_book(c: Chain) -> str:
    """Net disclosed buying for 13 sessions as three books: both sides, buys alone, and a tilt of equal weights; costs, from the next session on."""
    P.disclosures(c)
    P.returns(c)
    P.at_session(c, "disclosures", "filing_date", "da", keep="")
    c.add("dn", "select symbol, side, amount_mid, t0, t0 + 12 as t1 from da")
    P.expand(c, "dn", "t0", "t1", "dx")
    c.add("dw", "select symbol, t_idx, sum((case when side = 'buy' then 1 else -1 end) * ln(1 + amount_mid / 1e4)) as raw from dx group by symbol, t_idx")
    c.add("dj", "select r.symbol, r.t_idx, r.ret, case when r.tradable then 1e0 else 0e0 end as ok, coalesce(d.raw, 0) as raw from rets r left join dw d on d.symbol = r.symbol and d.t_idx = r.t_idx")
    gross = "nullif(sum(abs({})) over (partition by t_idx), 0)"
    long_only = "greatest(raw, 0)"
    tilt = "ok * (1 + 0.5 * case when raw > 0 then 1 when raw < 0 then -1 else 0 end)"
    weights = {"long_short": f"raw / {gross.format('raw')}", "long_only": f"{long_only} / {gross.format(long_only)}", "tilt": f"{tilt} / {gross.format(tilt)}"}
    c.add("dg", " union all ".join(f"select '{n}' as design, symbol, t_idx, ret, coalesce({w}, 0) as w from dj" for n, w in weights.items()))
    c.add("dl", "select design, t_idx, ret, w, coalesce(lag(w) over (partition by design, symbol order by t_idx), 0) as w0 from dg")
    c.add("o", "select design, t_idx, sum(w0 * ret) - sum(abs(w - w0)) * 5e-4 as ret, sum(abs(w - w0)) as turnover from dl group by design, t_idx")
    return c.select(f"select design, t_idx, {rounded('ret', 'turnover', digits=8)} from o")


@query("behaviour_duplicates")
def _duplicates(c: Chain) -> str:
    """Strategies that move as one (correlation 0.999 or more) with another that is simpler by name length, then by name: those to drop."""
    variants(c)
    c.add("cc", f"select a.strategy as s1, b.strategy as s2, {S.corr('a.x', 'b.x')} as rho, count(*) as n from var a join var b on a.t_idx = b.t_idx and a.strategy <> b.strategy group by a.strategy, b.strategy")
    c.add("dup", "select s1, min(s2) as twin, max(abs(rho)) as rho from cc where abs(rho) >= 0.999 and n >= 60 and (length(s2) < length(s1) or (length(s2) = length(s1) and s2 < s1)) group by s1")
    return c.select(f"select s1 as strategy, twin, {rounded('rho')} from dup")


@query("holdout_split")
def _holdout(c: Chain) -> str:
    """The flagship before and in the held-back last fifth, with an embargo between; the tail needs 60 sessions to count."""
    daily(c)
    c.add("hn", "select floor((max(t_idx) + 1) * 0.8) as cut_t from bt")
    c.add("hs", "select b.*, case when b.t_idx >= h.cut_t then 1 else 0 end as part from bt b cross join hn h where b.t_idx < h.cut_t - 10 or b.t_idx >= h.cut_t")
    E.stats(c, "hs", "part", "hv")
    return c.select(f"select case when g = 1 then 'held' else 'train' end as part, n_days, n_days >= 60 as ok, {rounded('alpha_ann', 'alpha_tstat', 'sharpe', 'ir')} from hv")


#: What a candidate must show, each against its limit: name, column, at least or at most, limit.
GATES = (("cv_folds_positive", "frac_positive", ">=", 0.6), ("alpha_tstat", "alpha_tstat", ">=", 2.0), ("n_trades", "cast(n_trades as double)", ">=", 100), ("ann_turnover", "ann_turnover", "<=", 60.0), ("corr_bench", "abs(corr_bench)", "<=", 0.6), ("worst_fold", "worst_alpha", ">=", -0.5))


@query("gate_checks")
def _gates(c: Chain) -> str:
    """The cheap checks of the flagship, one row each: value, limit, passed; and whether the dear ones are due."""
    text = TEXTS["cv_folds_stats"]
    text(c)
    c.add("cvo", c.final)
    rows = (f"select {i} as k, '{n}' as gate, {e} as value, '{op}' as op, {lim}e0 as threshold, coalesce({e} {op} {lim}, false) as passed from cvo" for i, (n, e, op, lim) in enumerate(GATES))
    c.add("gt", " union all ".join(rows))
    return c.select("select gate, round(value, 6) as value, op, threshold, passed, min(case when passed then 1 else 0 end) over () = 1 as dear_checks_due from gt")


@query("book_overlap_by_design")
def _overlap(c: Chain) -> str:
    """How much of each block's book was in the book before it."""
    E.score_momentum(c)
    E.top_k(c, 25, 21)
    return c.select("select a.blk, count(*) as n, count(b.symbol) as kept from w a left join w b on b.symbol = a.symbol and b.blk = a.blk - 1 group by a.blk")


QUERIES |= {name: on_spreads(TEXTS[name]) for name in ON_SPREADS}
