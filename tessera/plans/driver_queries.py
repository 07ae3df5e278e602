"""Queries whose last step is a small computation on the driver; they have no SQL form."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import metrics
from tessera.operators import evaluation as E
from tessera.operators import desk, governance, search, trading
from tessera.operators import expression as X
from tessera.operators.features import PRICE_FEATURES
from tessera.operators.slabs import Slabs
from tessera.session import cut, scratch
from tessera.sources import panel, stores, warehouse

from . import evaluation_queries, sql, strategy_queries

FEATURES = ("mom_5", "mom_21", "vol_21", "clv", "ma_ratio_10")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(c: sql.Chain) -> str:
        E.score_momentum(c)
        E.backtest(c)
        return c.select("select * from bt")

    return sql.to_spark(text)(spark, sf_dir)


def deflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated Sharpe ratio and what it takes, of the flagship's daily returns."""
    m = metrics.moments(_daily(spark, sf_dir), "ret")
    rows = []
    for trials in (1, 10, 100, 1000):
        dsr = metrics.deflated_sharpe(m["sharpe"], m["n"], trials, 1 / m["n"], m["skew"], m["kurt"])
        rows.append((trials, round(dsr, 6), round(metrics.sharpe_haircut(m["sharpe"] * 252**0.5, m["n"], trials), 6)))
    return spark.createDataFrame(rows, "trials int, dsr double, haircut_sharpe double")


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's returns against the spreads of features that it does not rank by; book and spreads come from slabs."""
    spreads = evaluation_queries.SPREADS

    def backtest(c: sql.Chain) -> str:
        E.backtest(c, k=25, rb=5)
        return c.select("select * from bt")

    def text(c: sql.Chain) -> str:
        cols = ", ".join(f"max(case when strategy = '{s}' then x end) as f_{s}" for s in spreads)
        return c.select(f"select t_idx, {cols} from var group by t_idx")

    with scratch(spark, "slabs") as at:
        slabs = Slabs(spark, sf_dir, at)
        daily = sql.to_spark(backtest, **slabs.momentum_book(25, 5))(spark, sf_dir)
        factors = sql.to_spark(text, var=cut(slabs.spreads(spreads)))(spark, sf_dir)
    names = [f"f_{s}" for s in spreads]
    r = metrics.hac_ols(cut(daily.join(factors, "t_idx")), "ret", names)
    rows = [(n, round(r["beta"][n], 6), round(r["t"][n], 4)) for n in r["beta"]] if r else []
    return spark.createDataFrame(rows, "factor string, beta double, t double")


def population_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded population of expressions, scored in one plan."""
    rng, g = np.random.default_rng(7), X.Grammar(FEATURES, 4)
    trees = {}
    while len(trees) < 8:
        t = X.simplify(g.tree(rng))
        if t.features() and "tsrank" not in t.canonical():
            trees[f"s_{t.fingerprint()}"] = t
    got = search.score_population(spark, sf_dir, trees)
    return spark.createDataFrame([(k, trees[k].canonical(), round(v, 6)) for k, v in sorted(got.items())], "id string, expression string, ic double")


def evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seeded generations of search and the archive they leave; both score their trees over the same slabs."""
    with scratch(spark, "slabs") as at:
        slabs = Slabs(spark, sf_dir, at)
        ev = search.Evolver(X.Grammar(FEATURES, 3), lambda trees: search.score_population(spark, sf_dir, trees, slabs=slabs), seed=3)
        for _ in range(2):
            ev.step(4)
    rows = [(a, b, n.canonical(), round(f, 6)) for (a, b), (f, n) in sorted(ev.archive.items())]
    return spark.createDataFrame(rows, "size_bin int, n_features int, expression string, fitness double")


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest picks' scores as capped target weights."""
    picks = sql.to_spark(evaluation_queries.TEXTS["latest_picks"])(spark, sf_dir).collect()
    w = trading.cap_weights({str(r["symbol"]): r["score"] + 0.01 for r in picks}, cap=0.12)
    return spark.createDataFrame(sorted((k, round(v, 6)) for k, v in w.items()), "symbol string, weight double")


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thompson weights of the event types from their decayed posteriors; five rows reach the driver."""

    def text(c: sql.Chain) -> str:
        strategy_queries.posteriors(c)
        return c.select("select arm, mu, kappa, alpha, beta from post")

    arms = {r["arm"]: (r["mu"], r["kappa"], r["alpha"], r["beta"]) for r in sql.to_spark(text)(spark, sf_dir).collect()}
    w = trading.thompson_weights(arms, np.random.default_rng(11))
    return spark.createDataFrame(sorted((k, round(v, 6)) for k, v in w.items()), "arm string, weight double")


def settle_books(books: dict[int, dict[str, float]], opens: dict[int, dict[str, float]], rb: int) -> list[tuple]:
    """(blk, symbol, side, qty, price) of every fill of the books (blk -> symbol -> weight) at the opens (t_idx -> symbol -> price).

    A book is ordered at the session after its rebalance row, held names at their last known
    open. What has no open there rests until it has one, or until the next book's orders replace it;
    an exit that rests stays a full one.
    """
    broker, out = trading.PaperBroker(), []
    last: dict[str, float] = {}
    blk = None
    for t in range(max(opens, default=-1) + 1):
        last |= opens.get(t, {})
        if t % rb == 1 and (t // rb in books or blk is not None):
            blk = t // rb
            held = {s: q * last[s] for s, q in broker.shares.items()}
            broker.pending = []
            for o in trading.orders({s: w * 0.95 for s, w in books.get(blk, {}).items()}, held, broker.cash + sum(held.values())):
                broker.submit(o, t - 1)
        gone = {o.symbol for o in broker.pending} - books.get(blk, {}).keys()
        broker.pending = [replace(o, notional=broker.shares[o.symbol] * last[o.symbol]) if o.symbol in gone else o for o in broker.pending]
        out += [(blk, f["symbol"], f["side"], round(f["qty"], 6), round(f["price"], 6)) for f in broker.settle(t, opens.get(t, {}))]
    return out


def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's books sent through the paper broker, in order."""
    rb = 21

    def text(c: sql.Chain) -> str:
        E.score_momentum(c)
        E.top_k(c, 5, rb)
        c.add("ever", "select symbol, min(blk) as b0 from w group by symbol")
        c.add("lines", f"""select 'book' as kind, blk as at, symbol, w as x from w union all select 'open', p.t_idx, p.symbol, p.open
            from panel p join ever e on e.symbol = p.symbol and p.t_idx > e.b0 * {rb} where p.open is not null""")
        return c.select("select * from lines")

    books: dict[int, dict[str, float]] = {}
    opens: dict[int, dict[str, float]] = {}
    for r in sql.to_spark(text)(spark, sf_dir).collect():
        (books if r["kind"] == "book" else opens).setdefault(r["at"], {})[str(r["symbol"])] = r["x"]
    return spark.createDataFrame(settle_books(books, opens, rb), "blk int, symbol string, side string, qty double, price double")


def recorded(spark: SparkSession, sf_dir: str, budget: int) -> tuple[dict[str, list[float]], float]:
    """The first ``budget`` outcomes of every method, all that a policy can reach, and the best of all outcomes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    best = e.agg(F.max("value")).first()[0]
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    rows = e.withColumn("k", k).filter(F.col("k") <= budget).select("event_type", "k", "value").collect()
    world: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r["event_type"], r["k"])):
        world.setdefault(r["event_type"], []).append(r["value"] / 100 - 0.5)
    return world, 0.0 if best is None else best / 100 - 0.5


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice policies replayed over the recorded outcomes of every method, by policy and seed in parallel."""
    budget = 20
    world, top = recorded(spark, sf_dir, budget)
    runs = [(p, s) for p in governance.POLICIES for s in range(5)]

    def play(pdf):
        import pandas as pd

        p, s = pdf["policy"].iloc[0], int(pdf["seed"].iloc[0])
        return pd.DataFrame([{"seed": s, **search.replay(world, p, budget, np.random.default_rng(s), top=top)}])

    return spark.createDataFrame(runs, "policy string, seed int").groupBy("policy", "seed").applyInPandas(play, "seed int, policy string, best double, value double, regret double")


def decorrelated_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies with the best t statistic that are not too much like a better one: curves from slabs, pairs in Spark, the pick on the driver."""
    with scratch(spark, "slabs") as at:
        curves = Slabs(spark, sf_dir, at).all_spreads(PRICE_FEATURES)
    t = {r["strategy"]: r["t"] or 0.0 for r in curves.groupBy("strategy").agg((F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0)) * F.sqrt(F.count("x"))).alias("t")).collect()}
    rho = {(r["a"], r["b"]): r["rho"] for r in governance.pair_correlations(curves).collect()}
    alive = governance.distinct_behaviour({s: len(s) for s in t}, rho)
    picked = governance.decorrelated(sorted(alive, key=lambda s: (-round(t[s], 9), s)), rho)
    return spark.createDataFrame([(i, s, round(t[s], 6)) for i, s in enumerate(picked, 1)], "place int, strategy string, t double")


def warehouse_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warehouse built from the test tables, one market a region, and what each market then covers."""
    with scratch(spark, "warehouse") as at:
        w = warehouse.Warehouse(spark, at, f"wh_{uuid.uuid4().hex[:12]}")
        try:

            def text(c: sql.Chain) -> str:
                panel.bars(c)
                panel.market(c)
                return c.select("select b.*, m.market from bars b join market m on m.symbol = b.symbol")

            rows = cut(sql.to_spark(text)(spark, sf_dir))
            for r in rows.select("market").distinct().orderBy("market").collect():
                w.load_market(r["market"], rows.filter(F.col("market") == r["market"]).drop("market"), "lineitem", "weekly test bars")
            return cut(w.query("select p.market, count(distinct p.symbol) as n_symbols, count(*) as n_rows, min(p.date) as starts, max(p.date) as ends, round(avg(p.close) + 1.73e-8, 6) + 0e0 as avg_close from prices p join markets m using (market) where m.sessions >= :least group by p.market", least=1))
        finally:
            w.drop()


def _warehouse_sql() -> str:
    c = sql.Chain(sql.Duck())
    panel.bars(c)
    panel.market(c)
    return c.select("select market, count(distinct b.symbol) as n_symbols, count(*) as n_rows, min(date) as starts, max(date) as ends, round(avg(close) + 1.73e-8, 6) + 0e0 as avg_close from bars b join market m on m.symbol = b.symbol where close is not null group by market")


_WAREHOUSE_SQL = _warehouse_sql()


def wide_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The liquid names of all that is listed: directory, bars, usable ones, ranks at every refresh, and their churn."""
    return desk.wide_universe(spark, sf_dir)


def trade_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session of the desk on the last two books: targets, risk, orders, fills."""
    return desk.trade_session(spark, sf_dir)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published document, one row for each of its sections as JSON."""
    doc = desk.snapshot(spark, sf_dir)
    return spark.createDataFrame([(k, json.dumps(stores.clean(v), sort_keys=True, default=str)) for k, v in sorted(doc.items())], "section string, body string")


#: Their SQL, where they have one.
ORACLES = {"warehouse_build": _WAREHOUSE_SQL}
QUERIES = {
    "dsr": deflated,
    "factor_attribution": attribution,
    "population_ic": population_ic,
    "evolution_run": evolution,
    "waterfill_caps": caps,
    "thompson_weights": allocation,
    "paper_settle": settlement,
    "replay_policies": policies,
    "decorrelated_pick": decorrelated_pick,
    "warehouse_build": warehouse_build,
    "wide_universe": wide_universe,
    "trade_session": trade_session,
    "snapshot": snapshot,
}
