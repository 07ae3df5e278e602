"""The desk: the universe of listed names, a trading session, and the documents that are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import trading
from tessera.plans.sql import Chain, to_spark
from tessera.session import cut
from tessera.sources import panel as P

SERIES_ROWS = 260


def wide_universe(spark: SparkSession, sf_dir: str, size: int = 50, every: int = 21, lookback: int = 60, least_bars: int = 100) -> DataFrame:
    """One row a refresh: how many names are listed, usable and members, and how many are new to the one before."""

    def text(c: Chain) -> str:
        P.panel(c)
        s = c.d.table("supplier")
        c.add("listed", f"select s_suppkey as symbol from {s} where s_name is not null")
        c.add("usable", f"select p.symbol from spans p join listed l on l.symbol = p.symbol where p.n_bars >= {least_bars}")
        c.add("ranked", f"select p.symbol, p.t_idx, p.close, {c.d.percentile('case when p.dv > 0 then p.dv end', 0.5)} over (partition by p.symbol order by p.t_idx rows between {lookback} preceding and 1 preceding) as liq from panel p join usable u on u.symbol = p.symbol")
        c.add("placed", f"select symbol, t_idx, row_number() over (partition by t_idx order by round(liq, 4) desc, symbol) as k from ranked where t_idx % {every} = 0 and t_idx >= {lookback} and liq is not null and close >= {P.MIN_PRICE}")
        c.add("members", f"select symbol, t_idx from placed where k <= {size}")
        c.add("fresh", f"select m.t_idx, m.symbol, case when o.symbol is null and m.t_idx >= {lookback + every} then 1 else 0 end as is_new from members m left join members o on o.symbol = m.symbol and o.t_idx = m.t_idx - {every}")
        return c.select("select t_idx, (select count(*) from listed) as n_listed, (select count(*) from usable) as n_usable, count(*) as n_members, cast(sum(is_new) as bigint) as n_new from fresh group by t_idx")

    return to_spark(text)(spark, sf_dir)


def books(spark: SparkSession, sf_dir: str, k: int = 20, rb: int = 21) -> DataFrame:
    """(blk, symbol, w, close, next_open) of the last two books: 2 k rows."""

    def text(c: Chain) -> str:
        E.score_momentum(c)
        E.top_k(c, k, rb)
        c.add("nb", "select max(blk) as b from w")
        c.add("px_", "select symbol, t_idx, close, lead(open) over (partition by symbol order by t_idx) as next_open from panel")
        return c.select(f"select w.blk, w.symbol, w.w, p.close, p.next_open from w join px_ p on p.symbol = w.symbol and p.t_idx = w.blk * {rb} where w.blk >= (select b - 1 from nb)")

    return to_spark(text)(spark, sf_dir)


def trade_session(spark: SparkSession, sf_dir: str, equity: float = 100_000.0) -> DataFrame:
    """From the book before to the last one: capped targets, the risk check, orders that it lets through, their fills."""
    rows = books(spark, sf_dir).collect()
    last = max((r["blk"] for r in rows), default=0)
    px = {str(r["symbol"]): r["close"] for r in rows if r["close"]}
    broker = trading.PaperBroker(cash=equity)
    risk = trading.RiskManager()
    out: list[tuple] = []
    for bar, blk in enumerate((last - 1, last)):
        now = [r for r in rows if r["blk"] == blk]
        total = broker.equity(px)
        checks = risk.check(total, equity, 0)
        out += [("risk", blk, n, "", round(v, 6), bool(ok)) for n, v, _, ok in checks]
        target = trading.cap_weights({str(r["symbol"]): r["w"] for r in now}, cap=0.06)
        held = {s: q * px.get(s, 0.0) for s, q in broker.shares.items()}
        pending = sum(held.values())
        for o in trading.orders(target, held, total):
            ok, why = risk.allow(o, total, held.get(o.symbol, 0.0), pending)
            out.append(("order", blk, o.symbol, o.side, round(o.notional, 4), ok))
            if ok:
                pending += o.notional if o.side == "buy" else -o.notional
                broker.submit(o, 2 * bar)
        opens = px | {str(r["symbol"]): r["next_open"] for r in now if r["next_open"]}
        out += [("fill", blk, f["symbol"], f["side"], round(f["qty"] * f["price"], 4), True) for f in broker.settle(2 * bar + 1, opens)]
    return spark.createDataFrame(out, "kind string, blk int, name string, side string, value double, ok boolean")


def snapshot(spark: SparkSession, sf_dir: str) -> dict:
    """Everything the published page shows, from a few small aggregates."""

    def text(c: Chain) -> str:
        E.score_momentum(c)
        E.backtest(c)
        return c.select("select t_idx, ret, bench, turnover from bt")

    daily = cut(to_spark(text)(spark, sf_dir))
    last = daily.orderBy(F.col("t_idx").desc()).limit(SERIES_ROWS).orderBy("t_idx").collect()
    stats = daily.agg(
        F.count("*").alias("sessions"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.corr("ret", "bench").alias("corr_bench"), F.avg("turnover").alias("turnover")
    ).first()
    rows = books(spark, sf_dir).collect()
    top = max((r["blk"] for r in rows), default=0)
    positions = [{"symbol": r["symbol"], "weight": round(r["w"], 6), "close": r["close"]} for r in sorted(rows, key=lambda r: r["symbol"]) if r["blk"] == top]
    return {"statistics": {k: (round(v, 8) if isinstance(v, float) else v) for k, v in stats.asDict().items()}, "positions": positions, "series": [[r["t_idx"], round(r["ret"], 8), round(r["bench"], 8)] for r in last], "caveats": ["weekly test bars", "paper fills only"]}
