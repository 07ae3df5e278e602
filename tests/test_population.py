"""Populations, null model, shifted scores and the walk-forward against loops in numpy; genomes and bandits by hand."""

import math
import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tessera.operators import evaluation as E
from tessera.operators import expression as X
from tessera.operators import population as N
from tessera.operators.features import PRICE_FEATURES, family_of, price_features
from tessera.operators.genome import INTERVALS, POSITIONS, Breeder, Genome, sample, to_table
from tessera.operators.search import FamilyBandit
from tessera.plans import population_queries as Q
from tessera.plans.sql import to_spark
from tessera.sources import panel as P

BIG = "/root/testdata/sf0.01"
GENOMES = [
    Genome(X.un("rank", X.feat("mom_21")), 10, 5, "equal"),
    Genome(X.bi("sub", X.feat("clv"), X.feat("vol_10")), 25, 2, "score"),
    Genome(X.un("tsmean", X.un("rank", X.feat("rev_5")), 10), 15, 21, "score"),
    Genome(X.un("neg", X.feat("mom_5")), 40, 1, "equal"),
]


def table(spark, build, select, at=BIG, **given):
    def text(c):
        build(c)
        return c.select(select)

    return to_spark(text, **given)(spark, at).toPandas()


def wide(df, col):
    return df.pivot(index="t_idx", columns="symbol", values=col).sort_index().sort_index(axis=1)


@pytest.fixture(scope="module")
def market(spark):
    def build(c):
        price_features(c)
        P.returns(c)
        X.compile_population(c, "feats", {g.id: g.tree for g in GENOMES})

    cols = ", ".join(f"round(s.{g.id}, 8) as {g.id}" for g in GENOMES)
    df = table(spark, build, f"select r.symbol, r.t_idx, r.ret, r.tradable, {cols} from rets r join scored s on s.symbol = r.symbol and s.t_idx = r.t_idx")
    m = {c: wide(df, c).to_numpy(float) for c in ("ret", *(g.id for g in GENOMES))}
    m["ok"] = wide(df, "tradable").to_numpy(bool)
    before = np.vstack([np.zeros(m["ok"].shape[1], bool), m["ok"][:-1]])
    m["bench"] = (before * m["ret"]).sum(1) / np.maximum(before.sum(1), 1)
    return m


def run(m, score, g, lo, hi, cost=E.SLIPPAGE):
    """(ret, turnover, trades) of one fold, session by session, from a flat book."""
    n = m["ret"].shape[1]
    shares, out, turn, trades = np.zeros(n), [], [], 0
    owed = 0.0
    for t in range(lo, hi):
        value = shares.sum()
        shares = shares * (1 + m["ret"][t])
        r = shares.sum() / value - 1 if value > 0 else 0.0
        out.append(r - owed)
        owed, moved = 0.0, 0.0
        if (t - lo) % g.interval == 0 and t < hi - 1:
            s = np.where(m["ok"][t], score[t], np.nan)
            best = sorted(np.flatnonzero(~np.isnan(s)), key=lambda i: (-s[i], i))[: g.positions]
            w = np.zeros(n)
            if best:
                raw = s[best] - s[best].min() + 1e-12 if g.weighting == "score" else np.ones(len(best))
                w[best] = raw / raw.sum()
            now = shares / shares.sum() if shares.sum() > 0 else shares
            moved, owed = np.abs(w - now).sum(), np.abs(w - now).sum() * cost
            trades += int((np.abs(w - now) > 1e-6).sum())
            shares = w
        turn.append(moved)
    return np.array(out), np.array(turn), trades


def hac_t(x):
    n, e = len(x), x - x.mean()
    lags = max(1, int(4 * (n / 100) ** (2 / 9)))
    v = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return x.mean() / math.sqrt(max(v, 1e-12) / n)


def figures(m, score, g, windows):
    rows, rs, bs = [], [], []
    for lo, hi in windows:
        r, turn, trades = run(m, score, g, lo, hi)
        b = m["bench"][lo:hi]
        if not trades:
            continue
        beta = np.cov(r, b)[0, 1] / b.var(ddof=1)
        rows.append((252 * (r - beta * b).mean(), (r - b).mean() / (r - b).std(ddof=1) * math.sqrt(252), turn.sum() / (len(r) / 252), trades))
        rs.append(r)
        bs.append(b)
    a, r, b = np.array(rows), np.concatenate(rs), np.concatenate(bs)
    beta = np.cov(r, b)[0, 1] / b.var(ddof=1)
    return {"folds": len(a), "n_trades": a[:, 3].sum(), "frac_positive": (a[:, 0] > 0).mean(), "mean_alpha": a[:, 0].mean(), "median_alpha": np.median(a[:, 0]), "worst_alpha": a[:, 0].min(), "mean_ir": a[:, 1].mean(), "ann_turnover": a[:, 2].mean(), "alpha_t": hac_t(r - beta * b), "corr_bench": np.corrcoef(r, b)[0, 1]}


def folds(n, k=N.FOLDS, embargo=N.EMBARGO):
    return [(n * f // k + (embargo if f else 0), n * (f + 1) // k - (embargo if f < k - 1 else 0)) for f in range(k)]


def test_population_is_the_loop_over_folds(spark, market):
    def build(c):
        price_features(c)
        N.evaluate(c, "feats", GENOMES)
        N.fitness(c)

    got = table(spark, build, "select * from fit").set_index("strategy")
    expect = {g.id: figures(market, market[g.id], g, folds(len(market["ret"]))) for g in GENOMES}
    behaviour = {}
    for g in GENOMES:
        e, row = expect[g.id], got.loc[g.id]
        for k, v in e.items():
            assert row[k] == pytest.approx(v, abs=1e-7), (g, k)
        behaviour[g.id] = np.array([e["ann_turnover"] / 10, abs(e["corr_bench"]) / 0.25, g.tree.size() / 15])
    cells: dict = {}
    for g in GENOMES:
        e = expect[g.id]
        cell = tuple(int(np.searchsorted(edges, v)) for edges, v in ((N.TURNOVER_EDGES, e["ann_turnover"]), (N.CORR_EDGES, abs(e["corr_bench"])), (N.SIZE_EDGES, g.tree.size())))
        if cell not in cells or e["mean_ir"] > expect[cells[cell]]["mean_ir"]:
            cells[cell] = g.id
    for g in GENOMES:
        e, row, size = expect[g.id], got.loc[g.id], g.tree.size()
        near = sorted(np.linalg.norm(behaviour[g.id] - behaviour[o]) for o in cells.values() if o != g.id)[:8]
        novel = np.mean(near) if len(cells) >= 2 and near else 1.0
        base = {"ir": e["mean_ir"] * (0.5 + 0.5 * e["frac_positive"]), "consistency": e["mean_ir"] * e["frac_positive"] ** 2, "median_alpha": e["median_alpha"] * (0.5 + 0.5 * e["frac_positive"]), "novelty": novel + 0.05 * e["mean_ir"]}
        dock = 2 * ((abs(e["corr_bench"]) - 0.9) / 0.1) ** 2 * (abs(e["corr_bench"]) > 0.9) + 0.5 * max(e["ann_turnover"] / 30 - 1, 0) + (e["n_trades"] < 100)
        n = len(market["ret"])
        sized = {"linear": 0.01 * size, "bic": size * math.log(n) / (2 * n) * 100}
        for mode in N.MODES:
            for p in N.PARSIMONY:
                assert row[f"{mode}_{p}"] == pytest.approx(base[mode] - dock - sized[p], abs=1e-6), (g, mode, p)


def scored_by_hand(spark, rows):
    """Fitness of made-up figures."""

    def build(c):
        c.add("cvs", "select * from made")
        N.fitness(c)

    cols = "strategy string, win string, mean_ir double, frac_positive double, median_alpha double, ann_turnover double, corr_bench double, n_trades long, size int, n_sessions int"
    return table(spark, build, "select * from fit", made=spark.createDataFrame(rows, cols)).set_index("strategy")


def test_modes_and_parsimony_rank_differently(spark):
    got = scored_by_hand(spark, [("steady", "all", 1.0, 0.9, 0.1, 3.0, 0.5, 9999, 1, 400), ("spiky", "all", 1.6, 0.4, 0.1, 3.0, 0.5, 9999, 1, 400), ("hugger", "all", 1.6, 0.9, 0.1, 3.0, 0.99, 9999, 1, 400)])
    assert got["ir_linear"]["spiky"] > got["ir_linear"]["steady"] and got["consistency_linear"]["steady"] > got["consistency_linear"]["spiky"]
    assert got["ir_linear"]["hugger"] < got["ir_linear"]["steady"] + 0.5
    few, many = (scored_by_hand(spark, [("plain", "all", 1.0, 0.8, 0.1, 3.0, 0.5, 9999, 1, n), ("large", "all", 1.0, 0.8, 0.1, 3.0, 0.5, 9999, 6, n)]) for n in (400, 1400))
    assert few["ir_bic"]["plain"] - few["ir_bic"]["large"] > many["ir_bic"]["plain"] - many["ir_bic"]["large"] > 0
    assert few["ir_linear"]["plain"] - few["ir_linear"]["large"] == pytest.approx(0.05)


def test_joins_and_exchanges_do_not_grow_with_the_population(spark):
    def exchanges(n):
        genomes = [Genome(X.bi("add", X.feat("mom_21"), X.const(i)), 10 + i, 5) for i in range(n)]
        cells = [(s, t) for s in range(6) for t in range(200)]
        scored = spark.createDataFrame([(s, t, *(float((s * 7 + t + i) % 11) for i in range(n))) for s, t in cells], f"symbol long, t_idx int, {', '.join(f'{g.id} double' for g in genomes)}")
        rets = spark.createDataFrame([(s, t, 0.001 * ((s + t) % 5), True) for s, t in cells], "symbol long, t_idx int, ret double, tradable boolean")
        bench = rets.groupBy("t_idx").agg({"ret": "avg"}).toDF("t_idx", "bench")

        def text(c):
            N.long_scores(c, "scored", [g.id for g in genomes])
            N.genes(c, [(g.id, "all", g) for g in genomes])
            N.whole(c)
            N.pieces(c)
            N.candidates(c)
            N.books(c, 40)
            c.kept.clear()
            return c.select("select * from pick")

        df = to_spark(text, scored=scored, rets=rets, bench=bench, sessions=rets.select("t_idx").distinct())(spark, BIG)
        assert df.count() > 0
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [len(re.findall(w, plan)) for w in (r"\bJoin\b", r"\bWindow\b", r"\bAggregate\b")]

    assert exchanges(3) == exchanges(24)


def test_null_share_counts_the_nulls_below(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=30)
    rows = [(f"n{i}", True, float(v)) for i, v in enumerate(x)] + [("a", False, 0.3), ("b", False, float(x[4]))]

    def ask(rows):
        def text(c):
            c.add("marked", "select * from made")
            return c.select(Q.null_share(c, {"f": "x"}))

        return to_spark(text, made=spark.createDataFrame(rows, "strategy string, is_null boolean, x double"))(spark, BIG).toPandas().set_index("strategy")

    got = ask(rows)
    for s, v in (("a", 0.3), ("b", x[4])):
        assert got["f_share"][s] == pytest.approx((x < v).mean(), abs=1e-5)
    assert got["f_p95"]["a"] == pytest.approx(np.percentile(x, 95), abs=1e-5) and got["f_p99"]["b"] == pytest.approx(np.percentile(x, 99), abs=1e-5)
    assert ask(rows[12:])[["f_share", "f_p95"]].isna().all().all() and got["nulls"]["a"] == 30


def test_shifted_scores_go_round_the_calendar(spark, market):
    got = to_spark(Q.TEXTS["shuffle_folds"])(spark, BIG).first()
    n = len(market["ret"])
    df = table(spark, E.score_momentum, "select symbol, t_idx, round(score, 9) as score from score")
    score, g = wide(df, "score").to_numpy(float), Genome(X.feat("mom_21"), 25, 5)
    lo = n // Q.KEEP_OFF
    shifts = [0, *(lo + (r * (n - 2 * lo)) // Q.SHIFTS for r in range(Q.SHIFTS))]
    irs = [figures(market, np.roll(score, s, axis=0), g, folds(n))["mean_ir"] for s in shifts]
    assert got["replicas"] == Q.SHIFTS and got["ok"]
    assert got["real_ir"] == pytest.approx(irs[0], abs=2e-6) and got["null_ir"] == pytest.approx(np.mean(irs[1:]), abs=2e-6)
    assert got["share_beaten"] == pytest.approx(np.mean(np.array(irs[1:]) < irs[0]), abs=2e-6) and got["null_p95"] == pytest.approx(np.percentile(irs[1:], 95), abs=2e-6)


def test_the_searcher_cannot_see_its_test_segment(spark):
    """Prices from the fourth segment on are other ones: earlier picks stay, and what they made before it."""
    bars = table(spark, P.bars, "select * from bars")
    dates = np.sort(bars["date"].unique())
    edge = dates[len(dates) * 4 // Q.SEGMENTS]
    rng = np.random.default_rng(1)
    other = bars.copy()
    late = other["date"] >= edge
    for col in ("open", "high", "low", "close"):
        other.loc[late, col] = np.round(other.loc[late, col] * np.exp(rng.normal(0, 0.2, late.sum())), 6)
    runs = [to_spark(Q.TEXTS["honest_walk_forward"], bars=spark.createDataFrame(b))(spark, BIG).toPandas().set_index("win") for b in (bars, other)]
    for w in ("w1", "w2", "w3"):
        assert list(runs[0].drop(columns="t").loc[w]) == list(runs[1].drop(columns="t").loc[w])
    # The search of the fourth segment ends where it begins.
    assert runs[0]["pick"]["w4"] == runs[1]["pick"]["w4"] and runs[0]["ret_ann"]["w4"] != runs[1]["ret_ann"]["w4"]
    assert len(runs[0]) == Q.SEGMENTS and runs[0]["n"]["chained"] == runs[0]["n"].drop("chained").sum()


def test_genomes_survive_a_table_and_edits_keep_their_lineage(spark):
    b, rng = Breeder(X.Grammar(PRICE_FEATURES, max_depth=4)), np.random.default_rng(8)
    genomes = sample(b, 20, 3)
    back = [Genome.from_row(r) for r in to_table(spark, genomes).collect()]
    assert back == genomes and len({g.id for g in genomes}) == 20
    for g in genomes:
        p = b.child(g, rng, how="params")
        assert p.tree == g.tree and p.parents == (g.id,) and p.made_by == "params" and p.id != g.id
        assert sum(getattr(p, k) != getattr(g, k) for k in ("positions", "interval", "weighting")) == 1
        assert p.positions in POSITIONS and p.interval in INTERVALS
        x = b.child(g, rng, mate=genomes[0], how="crossover", born=4)
        assert x is g or (x.parents == (g.id, genomes[0].id) and x.born == 4)
        for _ in range(5):
            y = b.child(g, rng)
            assert y.tree.features() and y.tree.depth() <= 5
    assert replace(genomes[0], born=9, parents=("x",)).id == genomes[0].id
    with pytest.raises(ValueError, match="not a genome"):
        Genome.from_row({"tree": genomes[0].tree.to_json(), "positions": 0, "interval": 1, "weighting": "equal", "born": 0, "parents": [], "made_by": "x"})


def test_a_family_that_survives_is_drawn_more_often():
    rng = np.random.default_rng(6)
    families = tuple(sorted({family_of(f) for f in PRICE_FEATURES}))
    bandit, grammar = FamilyBandit(families), X.Grammar(PRICE_FEATURES)

    def share(family):
        hits = 0
        for _ in range(60):
            grammar.weigh(bandit.weights(rng), family_of)
            hits += sum(n.op == "feat" and family_of(n.name) == family for n in (grammar.terminal(rng) for _ in range(40)))
        return hits / 2400

    start = share("volume")
    for _ in range(60):
        bandit.learn({"volume", "macro"}, True)
        for f in families:
            if f != "volume":
                bandit.learn({f}, False)
    assert share("volume") > 2 * start and share("momentum") > 0
    assert bandit.belief("volume") == pytest.approx(61 / 62) and bandit.belief("macro") == 0.5
    bandit.fade()
    assert bandit.belief("volume") < 61 / 62


def test_survivors_are_counted_by_family(spark, market):
    def build(c):
        price_features(c)
        N.evaluate(c, "feats", GENOMES)

    got = to_spark(Q.TEXTS["family_survival"])(spark, BIG).toPandas().set_index("family")
    genomes = Q.population()
    assert got["seen"].max() <= len(genomes) and (got["survived"] <= got["seen"]).all()
    assert np.allclose(got["belief"], (1 + got["survived"]) / (2 + got["seen"]), atol=1e-6)
    n = len(market["ret"])
    lo = int(n * 0.8)

    def tail(c):
        price_features(c)
        c.kept.add(X.compile_population(c, "feats", {g.id: g.tree for g in GENOMES}))
        N.long_scores(c, "scored", [g.id for g in GENOMES])
        N.genes(c, [(g.id, "all", g) for g in GENOMES])
        P.sessions(c)
        c.add("span_w", f"select 'all' as win, 0 as a, {lo} as b")
        c.add("piece", f"select 'all' as win, 99 as f, {lo} as lo, {n} as hi")
        N.candidates(c)
        N.books(c, 40)
        N.trade(c)
        N.summary(c)

    alpha = table(spark, tail, "select strategy, mean_alpha from cvs").set_index("strategy")["mean_alpha"]
    for g in GENOMES:
        assert alpha[g.id] == pytest.approx(figures(market, market[g.id], g, [(lo, n)])["mean_alpha"], abs=1e-7)


# ---- statistics beneath --------------------------------------------------------


def test_newey_west_uses_every_lag(spark):
    """25,000 rows have a bandwidth of 13; a caller may ask for more."""
    rng = np.random.default_rng(0)
    x = np.convolve(rng.normal(0.01, 1, 25_020), np.ones(20) / 20, "valid")[:25_000]
    df = spark.createDataFrame(pd.DataFrame({"t_idx": range(25_000), "x": x}))

    def ask(**how):
        def text(c):
            E.newey_west(c, "made", "x", "nw", **how)
            return c.select("select * from nw")

        return to_spark(text, made=df)(spark, BIG).first()

    assert int(4 * 250 ** (2 / 9)) == 13
    assert ask()["t"] == pytest.approx(hac_t(x), rel=1e-9)
    e = x - x.mean()
    v = e @ e / 25_000 + sum(2 * (1 - k / 41) * (e[k:] @ e[:-k]) / 25_000 for k in range(1, 41))
    assert ask(lags="40")["t"] == pytest.approx(x.mean() / math.sqrt(v / 25_000), rel=1e-9)
    assert ask(lags="0")["t"] == pytest.approx(x.mean() / math.sqrt(e @ e / 25_000 / 25_000), rel=1e-9)


@pytest.mark.parametrize("lost", [-1.0, -1.5])
def test_a_total_loss_is_minus_one_and_a_single_row_has_no_ratio(spark, lost):
    def ask(rows):
        def text(c):
            E.stats(c, "made")
            return c.select("select * from st")

        return to_spark(text, made=spark.createDataFrame(rows, "t_idx int, ret double, bench double, turnover double"))(spark, BIG).toPandas().iloc[0]

    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, 40)
    r[17] = lost
    got = ask([(i, float(x), 0.001 * (i % 3), 0.0) for i, x in enumerate(r)])
    assert got["cagr"] == -1 and got["max_dd"] == -1 and np.isfinite(got["bench_cagr"])
    one = ask([(0, 0.01, 0.0, 0.0), (1, 0.01, 0.002, 0.0)])
    assert one["sharpe"] > 1e6
    alone = ask([(0, 0.01, 0.0, 0.0)])
    assert pd.isna(alone["sharpe"]) and pd.isna(alone["ir"])
