"""The panel engine: every query against its SQL, and the semantics that matter."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.functions import metrics
from tessera.operators import expression as X
from tessera.operators import search, trading
from tessera.plans import catalog, driver_queries, evaluation_queries, strategy_queries
from tessera.plans.sql import Chain, Dialect
from tessera.sources import readers
from tessera.streaming import operators as streaming

TEXTS = catalog.texts()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (float, np.floating)):
            return f"{v + 0.0:.6f}"
        s = str(v)
        return s[:-9] if s.endswith(" 00:00:00") else s

    df = df[sorted(df.columns)]
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query_matches_its_sql(spark, small, con, name):
    ours = catalog.queries()[name](spark, small)
    theirs = con.execute(catalog.oracles()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = ours.toPandas(), theirs
    assert len(a) == len(b)
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("name", sorted(driver_queries.QUERIES))
def test_driver_query_runs(spark, small, name):
    assert driver_queries.QUERIES[name](spark, small).count() > 0


def test_features_do_not_read_the_future(spark, small):
    """Cutting the sessions after a day leaves every feature before it as it was."""
    from tessera.operators.features import PRICE_FEATURES, price_features

    def run(limit):
        c = Chain(Dialect(small))
        price_features(c)
        if limit:
            c.parts["panel"] += f" where t_idx < {limit}"
        cols = ", ".join(f"round({f}, 8) as {f}" for f in PRICE_FEATURES)
        return spark.sql(c.select(f"select symbol, t_idx, {cols} from feats where t_idx < 150")).toPandas().sort_values(["symbol", "t_idx"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(run(None), run(150), check_exact=False, rtol=1e-7, atol=1e-9)


def interpret(n, env, tradable):
    """A tree over dense (session, symbol) arrays, straight from the definitions."""
    a = [interpret(x, env, tradable) for x in n.args]
    x = a[0] if a else None
    with np.errstate(all="ignore"):
        match n.op:
            case "feat":
                return env[n.name]
            case "const":
                return np.full_like(tradable, n.value, dtype=float)
            case "neg":
                return -x
            case "abs":
                return np.abs(x)
            case "sign":
                return np.sign(x)
            case "log1p":
                return np.sign(x) * np.log1p(np.abs(x))
            case "sigmoid":
                return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            case "square":
                return np.clip(x * x, -1e12, 1e12)
            case "sqrt_abs":
                return np.sign(x) * np.sqrt(np.abs(x))
            case "add":
                return x + a[1]
            case "sub":
                return x - a[1]
            case "mul":
                return np.clip(x * a[1], -1e12, 1e12)
            case "div":
                return np.where(np.abs(a[1]) >= 1e-12, x / a[1], np.nan)
            case "min":
                return np.fmin(x, a[1])
            case "max":
                return np.fmax(x, a[1])
            case "ite":
                return np.where(x > 0, a[1], a[2])
    m = pd.DataFrame(np.where(tradable, x, np.nan) if n.op in X.CROSS else x)
    if n.op == "demean":
        return m.sub(m.mean(axis=1), axis=0).values
    if n.op == "zscore":
        return m.sub(m.mean(axis=1), axis=0).div(np.maximum(m.std(axis=1, ddof=0), 1e-12), axis=0).values
    if n.op == "rank":
        n_ok = m.notna().sum(axis=1)
        return (m.round(9).rank(axis=1, method="first") - 1).div(np.maximum(n_ok - 1, 1), axis=0).values
    if n.op == "delta":
        return (m - m.shift(n.window)).values
    if n.op == "tsmean":
        return m.rolling(n.window, min_periods=1).mean().values
    if n.op == "tsstd":
        return m.rolling(n.window, min_periods=1).std(ddof=0).values
    raise ValueError(n.op)


def test_random_trees_match_an_interpreter_and_survive_simplifying(spark, small):
    rng = np.random.default_rng(4)
    g = X.Grammar(("clv", "intraday_range", "close_strength"), max_depth=4)
    trees = {}
    while len(trees) < 12:
        t = g.tree(rng)
        if "tsrank" not in t.canonical() and t.features():
            trees[f"s{len(trees)}"] = t
    c = Chain(Dialect(small))
    from tessera.operators.features import price_features

    price_features(c)
    base = spark.sql(c.select("select symbol, t_idx, tradable, clv, intraday_range, close_strength from feats")).toPandas()
    X.compile_population(c, "feats", trees)
    got = spark.sql(c.select("select * from scored")).toPandas()
    grid = lambda df, col: df.pivot(index="t_idx", columns="symbol", values=col)
    tradable = grid(base, "tradable").values.astype(bool)
    env = {f: grid(base, f).values.astype(float) for f in ("clv", "intraday_range", "close_strength")}
    for k, t in trees.items():
        want = np.where(tradable, interpret(t, env, tradable), np.nan)
        want[~np.isfinite(want)] = np.nan
        have = grid(got, k).values.astype(float)
        assert (np.isnan(want) == np.isnan(have)).mean() > 0.99, t.canonical()
        ok = ~np.isnan(want) & ~np.isnan(have)
        assert np.mean(np.isclose(want[ok], have[ok], rtol=1e-5, atol=1e-7)) > 0.98, t.canonical()
        assert X.from_dict(t.to_dict()) == t and X.simplify(X.simplify(t)) == X.simplify(t)


def test_edits_keep_trees_valid():
    rng, g = np.random.default_rng(0), X.Grammar(("a", "b"), 5)
    n = g.tree(rng)
    for _ in range(300):
        _, n = g.edit(n, rng, g.tree(rng))
        assert n.depth() <= 5
        X.from_dict(n.to_dict())


def test_multiple_testing_statistics():
    assert metrics.expected_max_sharpe(1000, 1.0) > metrics.expected_max_sharpe(10, 1.0) > 0
    assert metrics.deflated_sharpe(0.1, 500, 10, 0.001) > metrics.deflated_sharpe(0.1, 500, 1000, 0.001)
    assert metrics.deflated_sharpe(1.0, 10, 2, 1.0) == 0.0
    assert metrics.min_track_record(0.0, 0.1) == float("inf")
    assert metrics.verdict(3, 3) == "survives factors" and metrics.verdict(0.1, 0.2) == "no signal either way"


def test_factor_regression(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(0, 0.01, (600, 3))
    y = 0.001 + f @ [1.0, 0.5, -0.3] + rng.normal(0, 0.002, 600)
    df = spark.createDataFrame(pd.DataFrame({"t_idx": range(600), "y": y, "a": f[:, 0], "b": f[:, 1], "c": f[:, 2]}))
    r = metrics.hac_ols(df, "y", ["a", "b", "c"])
    x = np.column_stack([np.ones(600), f])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = (y - x @ b)[:, None] * x
    s = e.T @ e
    for k in range(1, r["lags"] + 1):
        w = 1 - k / (r["lags"] + 1)
        s += w * (e[k:].T @ e[:-k] + e[:-k].T @ e[k:])
    inv = np.linalg.pinv(x.T @ x)
    t = b / np.sqrt(np.diag(inv @ s @ inv))
    assert np.allclose(list(r["beta"].values()), b, rtol=1e-6) and np.allclose(list(r["t"].values()), t, rtol=1e-5)
    assert metrics.hac_ols(df, "y", ["a"]) is None


def test_trading_rules():
    w = trading.cap_weights({"a": 10, "b": 1, "c": 1}, total=0.9, cap=0.4)
    assert max(w.values()) <= 0.4 and abs(sum(w.values()) - 0.9) < 1e-9
    o = trading.orders({"a": 0.5, "b": 0.2001}, {"b": 2000.0, "c": 10.0}, 10_000)
    assert [(x.symbol, x.side) for x in o] == [("c", "sell"), ("a", "buy")]
    risk = trading.RiskManager()
    assert all(ok for *_, ok in risk.check(100, 100, 1))
    risk.check(90, 100, 1)
    assert risk.halted == "daily_loss" and not risk.allow(o[0], 100, 0, 0)[0]
    risk.clear()
    assert risk.allow(o[0], 100, 0, 0)[0]
    broker = trading.PaperBroker(cash=1000)
    broker.submit(trading.Order("a", "buy", 5000), bar=3)
    assert broker.settle(3, {"a": 10.0}) == [] and len(broker.pending) == 1
    fill = broker.settle(4, {"a": 10.0})[0]
    assert abs(fill["qty"] * fill["price"] - 1000) < 1e-6 and abs(broker.cash) < 1e-9
    arms = {"good": (1.0, 50.0, 30.0, 10.0), "bad": (-1.0, 50.0, 30.0, 10.0)}
    assert trading.thompson_weights(arms, np.random.default_rng(0), cap=1.0)["good"] == 1.0


def test_search_finds_a_planted_signal():
    want = X.un("rank", X.feat("a"))
    ev = search.Evolver(X.Grammar(("a", "b"), 3), lambda trees: {k: float("a" in t.features()) for k, t in trees.items()}, seed=1)
    for _ in range(4):
        ev.step()
    assert max(f for f, _ in ev.archive.values()) > 0.9 and want.size() == 2
    again = search.Evolver(X.Grammar(("a", "b"), 3), ev.evaluate, seed=1)
    for _ in range(4):
        again.step()
    assert again.history == ev.history


def test_population_is_scored_in_one_plan(spark):
    got = search.score_population(spark, "/root/testdata/sf0.01", {"s_a": X.feat("mom_5"), "s_b": X.un("neg", X.feat("mom_5"))})
    assert got["s_a"] == pytest.approx(-got["s_b"], abs=1e-9)


def test_replay_and_thesis():
    r = search.replay({"m": [0.1, 0.5], "n": [0.0, 0.2]}, "round_robin", 4, np.random.default_rng(0))
    assert r["best"] == 0.5 and r["regret"] == 0.0
    assert search.thesis_verdict(10, 1, 1) == ("too early", True)


def test_registry_has_every_strategy_with_a_caveat():
    assert len(strategy_queries.SPECIFIED) == 29
    assert all(s.caveat for s in strategy_queries.REGISTRY.values())


def test_readers(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text('date,tickers\n2020-01-01,"A, B"\n2020-02-01,"A"\n2020-03-01,"A,B"\n')
    got = {(r["symbol"], str(r["valid_from"]), str(r["valid_to"])) for r in readers.membership_log(spark, str(p)).collect()}
    assert got == {("A", "2020-01-01", "None"), ("B", "2020-01-01", "2020-02-01"), ("B", "2020-03-01", "None")}
    p = tmp_path / "f.txt"
    p.write_text("prose\n\n,Mkt,RF\n20200102, 1.00, 0.10\n20200103, -99.99, 0.10\n\nAnnual\n20210101, 9, 9\n")
    rows = readers.factor_text(spark, str(p), ["mkt", "rf"]).orderBy("date").collect()
    assert [(r["mkt"], r["rf"]) for r in rows] == [(0.01, 0.001), (None, 0.001)]
    p = tmp_path / "fx.csv"
    p.write_text("Date,USD,JPY\n2020-01-01,1.1,121\n2020-01-02,N/A,120\n")
    assert [r["close"] for r in readers.wide_rates(spark, str(p)).collect()] == pytest.approx([1.1 / 121])
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {(r["k"], r["v"]) for r in readers.keep_last(a, b, ["k"]).collect()} == {(1, "old"), (2, "new"), (3, "new")}
    m = spark.createDataFrame([("x", 1), ("y", 2)], "market string, v int")
    for _ in range(2):
        readers.replace_market(spark, m, str(tmp_path / "wh"))
    readers.replace_market(spark, m.filter("market = 'x'").withColumn("v", m["v"] + 9), str(tmp_path / "wh"))
    assert {(r["market"], r["v"]) for r in spark.read.parquet(str(tmp_path / "wh")).collect()} == {("x", 10), ("y", 2)}


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", -1.0, 1)], "arm string, x double, s int").selectExpr("arm", "x", "timestamp_seconds(s) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("arm string, x double, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming.posteriors(stream).writeStream.outputMode("update").format("memory").queryName("post").start()
    q.processAllAvailable()
    q.stop()
    rows = {r["arm"]: r for r in spark.table("post").collect()}
    want = streaming.decayed_posterior((0.0, 1.0, 2.0, 1.0, 0), [1.0, 3.0])
    assert rows["a"]["n"] == 2 and rows["a"]["mu"] == pytest.approx(want[0]) and rows["b"]["mu"] < 0
    beats = spark.readStream.schema("arm string, x double, ts timestamp").parquet(str(tmp_path / "in")).withColumnRenamed("arm", "worker")
    q = streaming.latest_heartbeat(beats).writeStream.outputMode("complete").format("memory").queryName("beats").start()
    q.processAllAvailable()
    q.stop()
    from pyspark.sql import functions as F

    got = streaming.liveness(spark.table("beats"), F.timestamp_seconds(F.lit(200))).collect()
    assert {r["worker"]: r["state"] for r in got} == {"a": "stale", "b": "stale"}


def test_asof_joins_return_every_session(spark, tmp_path):
    """Three queries on a small fixture against brute force over every session, not only every tenth or twentieth."""
    import datetime as dt

    first = dt.datetime(2000, 1, 3)
    last = {1: 44, 2: 30}  # weeks of each supplier's bars
    lines = [(w, s, first + dt.timedelta(weeks=w)) for s, n in last.items() for w in range(n + 1)]
    li = [(k, s, 0.05, 0.04, 1.0, d) for k, (_, s, d) in enumerate(lines)]
    ship = {k: d.date() for k, (_, _, d) in enumerate(lines)}
    od = [(k, 7, 100.0 + k, dt.datetime(2000, 1, 3)) for k in (3, 11)] + [(27, 8, 50.0, dt.datetime(2000, 4, 3))]
    spark.createDataFrame(li, "l_orderkey long, l_suppkey long, l_discount double, l_tax double, l_quantity double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(od, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    days = sorted({d.date() for _, _, d in lines})

    def got(name, *cols):
        return sorted(tuple(r[x] for x in cols) for r in catalog.queries()[name](spark, str(tmp_path)).collect())

    assert got("membership_asof", "symbol", "t_idx", "member") == sorted((s, t, t <= n) for s, n in last.items() for t in range(len(days)))
    q1, q2 = max(dt.date(2000, 1, 1) + dt.timedelta(91), ship[3], ship[11]), max(dt.date(2000, 4, 1) + dt.timedelta(91), ship[27])
    versions = [(7, q1, 214.0), (7, q1 + dt.timedelta(60), 235.4), (8, q2, 50.0)]
    backward, age = [], []
    for t, day in enumerate(days):
        for s in (7, 8):
            seen = [v for v in versions if v[0] == s and v[1] <= day]
            if seen:
                backward.append((s, t, seen[-1][2], seen[-1][1]))
                age.append((s, t, min((day - seen[-1][1]).days, 50)))
    assert got("asof_backward", "symbol", "t_idx", "val", "filed") == sorted(backward)
    assert got("days_since_filing", "symbol", "t_idx", "days") == sorted(age)
    assert {t for _, t, *_ in age} == set(range(min(t for _, t, _ in age), len(days)))


def test_replay_policies_know_every_event(spark, tmp_path):
    """A hot type fills the first 400 events; the best value and two more types come after them."""
    import datetime as dt

    t0 = dt.datetime(2020, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), "hot" if i < 450 else ("late", "rare")[i % 2], float(i % 37)) for i in range(520)]
    rows.append((520, t0 + dt.timedelta(days=9), "hot", 99.0))
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    world = {}
    for *_, kind, value in rows:
        world.setdefault(kind, []).append(value / 100 - 0.5)
    got = {(r["policy"], r["seed"]): (r["best"], r["value"], r["regret"]) for r in driver_queries.policies(spark, str(tmp_path)).collect()}
    assert len(got) == 25
    for (p, s), have in got.items():
        want = search.replay(world, p, 20, np.random.default_rng(s))
        assert have == pytest.approx((want["best"], want["value"], want["regret"]))


@pytest.mark.parametrize("n", [100, 357, 520])
def test_folds_cover_the_whole_calendar(n):
    edges = [i * n // 7 for i in range(8)]
    for t in range(n):
        f = ((t + 1) * 7 - 1) // n
        assert edges[f] <= t < edges[f + 1]
    con = duckdb.connect()
    for f in range(7):
        lo, hi = evaluation_queries.fold_edges(str(n), str(f), 7, 2)
        assert con.execute(f"select {lo}, {hi}").fetchone() == (edges[f] + 2 * (f > 0), edges[f + 1] - 2 * (f < 6))


def test_books_settle_every_block_and_every_exit():
    """A name that leaves is sold, later if it has no open that day, and counts in equity until then."""
    books = {0: {"a": 1.0}, 1: {"b": 1.0}, 2: {"b": 1.0}}
    full = {t: {"a": 10.0, "b": 20.0} for t in range(1, 10)}
    for gone, sold_in in (((), 1), ((4,), 1), ((4, 5, 6), 2)):
        opens = {t: {s: p for s, p in x.items() if s != "a" or t not in gone} for t, x in full.items()}
        if gone == (4,):
            opens[5]["a"] = 12.0  # sold later and higher, and still in full
        got = driver_queries.settle_books(books, opens, 3)
        sides = {(blk, s, side): qty for blk, s, side, qty, _ in got}
        assert sides[0, "a", "buy"] == sides[sold_in, "a", "sell"] == pytest.approx(95_000 / 10.005, abs=1e-5)
        assert sum(s == "a" for _, s, *_ in got) == 2
        equity = 100_000 - 95_000 / 10.005 * 0.005
        if not gone:
            assert sides[1, "b", "buy"] * 20 * 1.0005 == pytest.approx(equity * 0.95, abs=1)
    assert driver_queries.settle_books({}, {}, 3) == []


def test_paper_settle_sells_what_left_the_book(spark, small):
    def text(c):
        from tessera.operators import evaluation as E

        E.score_momentum(c)
        E.top_k(c, 5, 21)
        return c.select("select blk, symbol from w")

    from tessera.plans.sql import to_spark

    books = {}
    for r in to_spark(text)(spark, small).collect():
        books.setdefault(r["blk"], set()).add(str(r["symbol"]))
    fills = driver_queries.settlement(spark, small).toPandas()
    assert max(books) > 9 and set(fills["blk"]) == set(books)
    shares, exits = {}, 0
    for blk, got in fills.groupby("blk", sort=True):
        before = set(shares)
        for r in got.itertuples():
            shares[r.symbol] = shares.get(r.symbol, 0.0) + (r.qty if r.side == "buy" else -r.qty)
            assert shares[r.symbol] > -1e-4
            if shares[r.symbol] < 1e-4:
                del shares[r.symbol]
        left = before - books[blk]
        exits += len(left)
        assert left.isdisjoint(shares)
    assert exits > 5


def test_multiple_testing_counts_the_whole_registry(spark, small):
    """Every registered strategy is measured, against the bar of that many trials and by size of t."""
    t = catalog.queries()["strategy_stats_table"](spark, small).toPandas().set_index("id")["t_stat"]
    assert set(t.index) == set(strategy_queries.SPECIFIED)
    r = catalog.queries()["multiple_testing_summary"](spark, small).first()
    bar = max(2.0, np.sqrt(2 * np.log(29)))
    assert (r["n"], r["bar"], r["clears"]) == (29, pytest.approx(bar, abs=1e-6), int((t.abs() >= bar).sum()))
    own = catalog.queries()["cry_trend"](spark, small).toPandas()["ret"]
    assert t["cry_trend"] == pytest.approx(own.mean() / own.std() * len(own) ** 0.5, abs=1e-3)


def test_every_price_feature_is_scored(spark):
    big = "/root/testdata/sf0.01"
    from tessera.operators.features import PRICE_FEATURES, family_of

    ic = catalog.queries()["feature_ic_table"](spark, big).toPandas().set_index("feature")["mean_ic"].abs()
    assert len(PRICE_FEATURES) == 40 and set(ic.index) == set(PRICE_FEATURES)
    got = {r["family"]: (r["n"], r["avg_ic"], r["max_ic"]) for r in catalog.queries()["family_ic_rollup"](spark, big).collect()}
    want = {f: (len(x), pytest.approx(x.mean(), abs=3e-6), pytest.approx(x.max(), abs=3e-6)) for f, x in ic.groupby(family_of)}
    assert got == want and {"oscillator", "market_relative"} <= set(got)
    assert catalog.queries()["effective_trials"](spark, big).first()["m"] == pytest.approx(40, abs=1e-4)
