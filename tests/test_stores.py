"""Providers, warehouse, stores, governance and the stateful streams, on small tables."""

import datetime as dt
import json
import math
import zipfile

import numpy as np

import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics
from tessera.operators import expression as X
from tessera.operators import governance as G
from tessera.operators import search, trading
from tessera.operators.peers import top_peers
from tessera.sources import providers, stores, warehouse
from tessera.streaming import operators as streaming


def bars_csv(folder, symbol, days, first=100.0):
    folder.mkdir(exist_ok=True)
    rows = [f"{d},{first + i},{first + i + 1},{first + i - 1},{first + i + 0.5},10" for i, d in enumerate(days)]
    (folder / f"{symbol}.csv").write_text("Date,Open,High,Low,Close,Volume\n" + "\n".join(rows) + "\n")


def test_bars_source_reads_in_batches(spark, tmp_path):
    days = [f"2020-01-{d:02d}" for d in range(1, 8)]
    for s in ("AA", "BB", "C-C"):
        bars_csv(tmp_path / "p", s, days)
    got = providers.bars(spark, "files", ["AA", "BB", "C.C", "NONE"], "2020-01-02", "2020-01-05", folder=str(tmp_path / "p"), batch="2")
    assert sorted((r["symbol"], str(r["date"])) for r in got.collect()) == [(s, f"2020-01-{d:02d}") for s in ("AA", "BB", "C.C") for d in (2, 3, 4)]
    with pytest.raises(ValueError):
        providers.get_provider("nothing")


def test_fetching_is_tried_again():
    class Shaky(providers.Provider):
        calls = 0

        def fetch(self, ticker, start, end):
            self.calls += 1
            if self.calls < 3:
                raise OSError("busy")
            return None

    p = Shaky()
    assert providers.patiently(p, "A", "", "", pause=0) is None and p.calls == 3
    p = Shaky()
    with pytest.raises(OSError):
        providers.patiently(p, "A", "", "", tries=2, pause=0)


def test_cache_appends_the_tail_and_remembers_what_is_missing(spark, tmp_path):
    folder, cache = tmp_path / "p", str(tmp_path / "cache")
    bars_csv(folder, "AA", ["2020-01-01", "2020-01-02"])
    wanted = spark.createDataFrame([("AA",), ("ZZ",)], "symbol string")
    day = dt.date(2020, 2, 1)
    first = providers.refresh(spark, cache, wanted, "files", "2020-01-01", "2020-02-01", today=day, folder=str(folder))
    assert first.count() == 2
    assert [r["symbol"] for r in spark.read.parquet(f"{cache}/missing").collect()] == ["ZZ"]
    bars_csv(folder, "AA", ["2020-01-02", "2020-01-03"], first=500)
    bars_csv(folder, "ZZ", ["2020-01-01"])
    again = providers.refresh(spark, cache, wanted, "files", "2020-01-01", "2020-02-01", today=day, folder=str(folder))
    # The last bar was read anew and its newer value stays; ZZ is left alone for a week.
    assert sorted((r["symbol"], str(r["date"]), r["open"]) for r in again.collect()) == [("AA", "2020-01-01", 100.0), ("AA", "2020-01-02", 500.0), ("AA", "2020-01-03", 501.0)]
    later = providers.refresh(spark, cache, wanted, "files", "2020-01-01", "2020-02-01", today=day + dt.timedelta(days=8), folder=str(folder))
    assert {r["symbol"] for r in later.collect()} == {"AA", "ZZ"}


def test_warehouse_loads_repeat_and_leave_a_trail(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "wh"), "wh_test")
    try:
        bars = spark.createDataFrame([("A", dt.date(2020, 1, d), 1.0, 2.0, 0.5, 1.5 + d, 10.0) for d in (1, 2)] + [("B", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, None, 1.0)], "symbol string, date date, open double, high double, low double, close double, volume double")
        for _ in range(2):
            assert w.load_market("stocks", bars, "test", "none") == 2
        w.load_market("forex", bars.withColumn("close", F.lit(7.0)))
        (tmp_path / "s.json").write_text(json.dumps({"strategies": [{"id": "x", "title": "X", "market": "stocks", "sharpe": 1.5, "curve": [["2020-01-01", "1.0"], ["2020-01-02", "1.1"]]}]}))
        assert w.load_strategies(str(tmp_path / "s.json")) == 1
        factors = spark.createDataFrame([("2020-01-01", 0.1, 0.2), (None, 0.3, 0.4)], "Date string, `Mkt-RF` double, SMB double")
        assert w.load_factors(factors) == 1
        w.load_transactions(spark.createDataFrame([("m", "A", "buy", 8000.0)], "member string, ticker string, side string, amount_mid double"))
        got = {r["name"]: r["n"] for r in w.counts((*warehouse.TABLES, "no_such_table")).collect()}
        assert got == {"markets": 2, "prices": 5, "strategies": 1, "curves": 2, "transactions": 1, "factors": 1, "runs": 6, "no_such_table": 0}
        row = w.query("select mkt_rf, hml from factors").first()
        assert row["mkt_rf"] == 0.1 and row["hml"] is None
        top = w.query("select market, symbol, max(close) as m from prices group by all order by m desc limit :n", n=1).first()
        assert (top["market"], top["m"]) == ("forex", 7.0)
        for bad in ("drop table prices", "select 1; select 2"):
            with pytest.raises(ValueError):
                w.query(bad)
    finally:
        w.drop()


def test_formats(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "fx.zip", "w") as z:
        z.writestr("rates.csv", "Date,USD,JPY,XXX,\n2020-01-01,1.1,121,N/A,\n2020-01-02,N/A,120,1,\n")
    got = stores.rebase(stores.zipped_rates(spark, str(tmp_path / "fx.zip"))).collect()
    assert [(r["symbol"], r["close"]) for r in got] == [("JPY", pytest.approx(1.1 / 121))]
    (tmp_path / "v.csv").write_text('notice\n"Date","VIX Open","VIX Close"\n1/2/2020,1,2.5\n1/3/2020,1,bad\n')
    assert [(str(r["date"]), r["close"]) for r in stores.sniffed_series(spark, str(tmp_path / "v.csv"), "VIX").collect()] == [("2020-01-02", 2.5)]
    (tmp_path / "c.json").write_text(json.dumps({"0": {"cik_str": 320, "ticker": "aapl", "title": "A"}, "1": {"cik_str": 7, "ticker": "AAPL", "title": "B"}, "2": {"cik_str": 9, "ticker": "X", "title": "C"}}))
    assert sorted((r["ticker"], r["cik"]) for r in stores.company_index(spark, str(tmp_path / "c.json")).collect()) == [("AAPL", "0000000320"), ("X", "0000000009")]
    a = spark.createDataFrame([("2020-01-01", 1.0)], "date string, smb double")
    b = spark.createDataFrame([("2020-01-02", 2.0, 3.0)], "date string, smb double, mom double")
    assert sorted(map(tuple, stores.join_factors(a, b).collect()), key=str) == [("2020-01-01", 1.0, None), ("2020-01-02", None, 3.0)]
    rows = stores.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    for m, v in (("x", 1), ("y", 2), ("x", 5)):
        stores.save_market(spark.createDataFrame([(v,)], "v int"), str(tmp_path / "m"), m, {"v": v, "bad": math.nan})
    df, about = stores.load_market(spark, str(tmp_path / "m"), "x")
    assert [r["v"] for r in df.collect()] == [5] and about == {"v": 5, "bad": None}
    stores.save_transactions(a, str(tmp_path / "t"))
    assert stores.load_transactions(spark, str(tmp_path / "t")).count() == 1
    stores.save_transactions(spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, val int"), str(tmp_path / "f"))
    assert [r["val"] for r in stores.cached_facts(spark, str(tmp_path / "f"), spark.createDataFrame([("B",), ("B",)], "symbol string")).collect()] == [2]


def test_landed_files_serve_on_when_stale(tmp_path):
    at = str(tmp_path / "x" / "f")

    def fail():
        raise OSError

    with pytest.raises(OSError):
        stores.landed(at, fail)
    assert open(stores.landed(at, lambda: b"one")).read() == "one"
    assert open(stores.landed(at, lambda: b"two")).read() == "one"
    import time

    assert open(stores.landed(at, fail, ttl_s=10, now=time.time() + 100)).read() == "one"
    assert open(stores.landed(at, lambda: b"two", ttl_s=10, now=time.time() + 100)).read() == "two"


def test_documents(tmp_path):
    at = str(tmp_path / "d" / "s.json")
    stores.write_json(at, {"a": [math.inf, 1.5], "b": {"c": math.nan}})
    assert stores.read_json(at) == {"a": [None, 1.5], "b": {"c": None}}
    (tmp_path / "broken").write_text("{")
    assert stores.read_json(str(tmp_path / "broken"), 7) == 7 and stores.read_json("nowhere") is None
    assert stores.outermost_object('so: {"a": {"b": 1}} ok', ("a",)) == {"a": {"b": 1}}
    assert stores.outermost_object('{"a": 1}', ("b",)) is None and stores.outermost_object("none") is None and stores.outermost_object("{x}") is None
    base = {"a": {"b": 1}, "c": 2}
    assert stores.override(base, {"a.b": 5}) == {"a": {"b": 5}, "c": 2} and base["a"]["b"] == 1
    with pytest.raises(KeyError):
        stores.override(base, {"a.x": 1})
    assert [stores.number(x, k) for x, k in ((1234.5, "plain"), (0.123, "percent"), (-2.0, "signed"), (-3.5, "money"), (math.nan, "plain"), (None, "plain"))] == ["1,234.50", "12.30%", "-2.00", "-$3.50", "-", "-"]
    page = stores.report("<t>", {"x": [{"a": 1.0, "b": "<i>"}], "y": []})
    assert "&lt;t&gt;" in page and "<td>1.00</td><td>&lt;i&gt;</td>" in page and "nothing" in page


def test_state_round_trips(tmp_path):
    b = trading.PaperBroker(cash=5.0, shares={"A": 2.0}, pending=[trading.Order("A", "buy", 3.0, 4)], blotter=[{"n": i} for i in range(2100)])
    stores.save_broker(str(tmp_path / "b"), b)
    c = stores.load_broker(str(tmp_path / "b"))
    assert (c.cash, c.shares, c.pending, len(c.blotter)) == (5.0, {"A": 2.0}, b.pending, 2000)
    assert stores.load_broker(str(tmp_path / "none")).cash == 100_000.0
    tree = X.un("rank", X.feat("mom_5"))
    stores.save_search(str(tmp_path / "s"), {(1, 2): (0.5, tree)}, {"f": 0.5}, [{"best": 0.5}], {"edits": ({"a": 1.0}, {"a": 2.0})})
    assert stores.load_search(str(tmp_path / "s")) == ({(1, 2): (0.5, tree)}, {"f": 0.5}, [{"best": 0.5}], {"edits": ({"a": 1.0}, {"a": 2.0})})
    state = {"archive": [{"tree": {"op": "bad"}, "fitness": 9}, {"tree": tree.to_dict(), "fitness": 1}, {"fitness": 2}, {"tree": X.feat("gap").to_dict(), "fitness": 3}]}
    assert [n.canonical() for _, n in stores.definitions(state)] == ["gap", "rank(mom_5)"]
    assert [n for n, _ in stores.definitions(state | {"promoted": [{"name": "p", "tree": tree.to_dict()}]})] == ["p"]


def test_gates_stop_before_the_dear_ones():
    assert not G.gate_record("x", math.nan, ">=", 0)["pass"]
    asked = []

    def dear(name, v):
        return lambda: asked.append(name) or v

    limits = [("a", ">=", 1.0), ("b", "<=", 2.0)]
    checks = G.gate({"a": 1.0, "b": 3.0}, limits, [("c", dear("c", 1), ">=", 0)])
    assert not G.passed(checks) and not asked
    checks = G.gate({"a": 1.0, "b": 2.0}, limits, [("c", dear("c", -1), ">=", 0), ("d", dear("d", 1), ">=", 0)])
    assert [c["gate"] for c in checks] == ["a", "b", "c"] and asked == ["c"]
    assert G.passed(G.gate({"a": 1.0, "b": 2.0}, limits))
    assert G.null_bar(1) == 2.0 and G.null_bar(10_000) > 4
    kept, gone = G.revalidate({"x": {"a": 5}, "y": {"a": 5}}, lambda n: {"a": 1.0 if n == "x" else 0.0, "b": 0.0}, limits)
    assert list(kept) == ["x"] and [c["gate"] for c in gone["y"]] == ["a"]
    assert G.holdout_verdict(3.0, 0.2, 500, 5)["stands"] and not G.holdout_verdict(1.0, 0.01, 100, 5)["stands"]


def test_likeness(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=100)
    curves = {"a": x, "bb": x * 2 + 1e-9, "c": rng.normal(size=100), "d": 0.9 * x + 0.3 * rng.normal(size=100)}
    df = spark.createDataFrame([(s, t, float(v)) for s, c in curves.items() for t, v in enumerate(c)], "strategy string, t_idx int, x double")
    rho = {(r["a"], r["b"]): r["rho"] for r in G.pair_correlations(df).collect()}
    assert len(rho) == 6 and all(r == pytest.approx(np.corrcoef(curves[a], curves[b])[0, 1]) for (a, b), r in rho.items())
    assert G.distinct_behaviour({"a": 3, "bb": 2, "c": 1, "d": 1}, rho) == ["c", "d", "bb"]
    assert G.decorrelated(["a", "bb", "d", "c"], rho) == ["a", "c"]


def test_holdout_life(spark, tmp_path):
    dates = [str(dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(400)]
    with pytest.raises(G.Refused, match="5 usable sessions, 60 are needed"):
        G.Reserve.past("2020-01-01", "2020-01-05", dates, "d")
    h = G.Reserve.past("2020-06-01", "2020-12-31", dates, "d")
    days = spark.createDataFrame([(d,) for d in dates], "date string")
    assert h.training(days).agg(F.max("date")).first()[0] == "2020-05-31"
    h.name(["x"])
    assert len(h.objections("y", dates[:200], "other")) == 3
    for bad in (("y", "d"), ("x", "other")):
        with pytest.raises(G.Refused):
            h.use(bad[0], dates, bad[1])
    assert h.left() == 1 and len(h.use("x", dates, "d")) == 214 and h.left() == 0
    for again in (lambda: h.use("x", dates, "d"), lambda: h.name(["z"])):
        with pytest.raises(G.Refused):
            again()
    f = G.Reserve.future("2020-03-01", need=30)
    assert f.objections("x", dates[:70]) == ["9 usable sessions, 30 are needed"]
    assert f.use("x", dates)[0] == "2020-03-02"
    f.leak("a script", "all prices")
    f.outcome("x", {"t": 1.5})
    f.save(str(tmp_path / "f"))
    again = G.Reserve.load(str(tmp_path / "f"))
    assert again.events == f.events and again.now().leaks == ("a script",) and [e["kind"] for e in again.events] == ["kept", "used", "leaked", "outcome"]
    assert again.unbroken() and G.Reserve.load(str(tmp_path / "none")) is None
    again.events[0]["what"]["tries"] = 5
    assert not again.unbroken() and again.objections("x", dates) == ["its history was changed"]
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "k int, v double")
    b = a.orderBy(F.col("v").desc())
    assert G.digest(a, "k", ["v"]) == G.digest(b, "k", ["v"]) != G.digest(a.filter("k = 1"), "k", ["v"])


def test_policies_and_methods():
    rng = np.random.default_rng(0)
    given = {"a": [0.1], "b": [0.5], "c": [-1.0]}
    assert [G.POLICIES["round_robin"].choose(k, given, rng) for k in range(4)] == ["a", "b", "c", "a"]
    assert G.POLICIES["greedy"].choose(0, given, rng) == "b" and G.POLICIES["greedy"].choose(0, given | {"d": []}, rng) == "d"
    assert G.POLICIES["greedy"].choose(0, {"a": [0.9, -5.0], "b": [0.5, 0.5]}, rng) == "a"
    luck = {"a": [0.001] * 40, "b": [9.0] + [-0.001] * 39}
    assert sum(G.POLICIES["thompson"].choose(0, luck, rng) == "a" for _ in range(50)) == 50
    assert {G.POLICIES["random"].choose(0, given, rng) for _ in range(60)} == {"a", "b", "c"}
    base = {"search": {"population": 1, "generations": 1, "max_depth": 4}, "backtest": {"rebalance": 5, "names": 25}}
    assert G.configured(base, "wide")["search"] == {"population": 96, "generations": 2, "max_depth": 4} and base["search"]["population"] == 1
    with pytest.raises(ValueError):
        G.register_method("wide")
    for p in G.POLICIES:
        assert search.replay({"m": [0.1, 0.5], "n": [0.0, 0.2]}, p, 4, np.random.default_rng(0))["best"] == 0.5
    out = G.review([{"id": "t", "tickers": ["A"], "since": "2020-01-01"}], lambda t, s: (30, 0.3, 0.05), dt.date(2020, 3, 1))
    assert out == [{"id": "t", "age_days": 60, "sessions": 30, "trailing": 0.3, "forward": 0.05, "verdict": "holding", "already_moved": True}]


def test_verdicts_follow_their_rules():
    v = metrics.verdict
    assert [v(3, 3), v(3, 0), v(0, 3), v(0.1, 0.1), v(1, 1), v(-3, 0)] == ["survives factors", "factor-hedged gain", "explained by factors", "no signal either way", "inconclusive", "inconclusive"]
    assert v(3, -3) == "factor-hedged gain" and v(-3, 3) == "inconclusive"
    assert v(3, 3, ok=False) == v(math.nan, 3) == "unknown"
    assert metrics.explain(None).startswith("not enough")
    assert metrics.sharpe_haircut(1.0, 250, 1) <= 1.0 and metrics.sharpe_haircut(0.1, 250, 10_000) == 0.0


def test_peers_of_a_planted_group(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 80))
    r = np.array([base[s % 3] + 0.2 * rng.normal(size=80) for s in range(30)])
    df = spark.createDataFrame([(0, s, t, None if s == 29 and t > 10 else float(r[s, t])) for s in range(30) for t in range(80)], "blk int, symbol long, t_idx int, r1 double")
    want = {}
    x = r.copy()
    x[29, 11:] = 0
    rho = np.round(np.corrcoef(x), 9)
    rho[29] = rho[:, 29] = 0
    for s in range(30):
        want[s] = sorted((o for o in range(30) if o != s), key=lambda o: (-rho[s, o], o))[:6]
    for tile in (512, 7):
        got = {}
        for row in top_peers(df, 6, 20, tile).collect():
            got.setdefault(row["symbol"], set()).add(row["peer"])
        assert got == {s: set(p) for s, p in want.items()}


def run_stream(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_stream_merge_and_series(spark, tmp_path):
    merge = streaming.merge_tail(str(tmp_path / "t"), ["symbol", "day"], "symbol")
    cols = "symbol string, day int, v double"
    merge(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0)], cols), 0)
    for _ in range(2):
        merge(spark.createDataFrame([("a", 2, 5.0), ("a", 3, 3.0)], cols), 1)
    assert sorted((r["symbol"], r["day"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 3.0), ("b", 1, 1.0)]
    sink = streaming.equity_sink(spark, str(tmp_path / "e"), cap=3)
    for i, rows in enumerate(([(1, 1.0), (2, 1.0), (3, 2.0)], [(4, 2.0), (5, 3.0), (6, 4.0)])):
        sink(spark.createDataFrame(rows, "ts int, value double"), i)
    assert [(r["ts"], r["value"]) for r in spark.read.parquet(str(tmp_path / "e")).orderBy("ts").collect()] == [(3, 2.0), (5, 3.0), (6, 4.0)]


def test_stream_freshness_and_debounce(spark, tmp_path):
    seen = spark.createDataFrame([("quotes", 100), ("bars", 100), ("other", 0)], "source string, s int").select("source", F.timestamp_seconds("s").alias("seen"))
    got = {r["source"]: r["fresh"] for r in streaming.freshness(seen, F.timestamp_seconds(F.lit(200)), {"quotes": 60, "bars": 500}).collect()}
    assert got == {"quotes": False, "bars": True, "other": True}
    rows = [("s", 0, "v1"), ("s", 30, "v1"), ("s", 40, "v2"), ("s", 45, "v3"), ("s", 50, "v2"), ("s", 69, "v2"), ("s", 75, "v2"), ("s", 80, "v2")]
    spark.createDataFrame(rows, "source string, t int, value string").select("source", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("source string, ts timestamp, value string").parquet(str(tmp_path / "d")).withWatermark("ts", "1 second")
    run_stream(streaming.debounced(stream), "debounce")
    assert [(r["value"], r["since"].timestamp()) for r in spark.table("debounce").collect()] == [("v1", 1000.0), ("v2", 1050.0)]


def test_stream_resting_orders(spark, tmp_path):
    rows = [("A", 1, "order", "buy", 100.0), ("A", 1, "open", "", 9.0), ("A", 3, "open", "", 10.0), ("B", 2, "order", "sell", 50.0), ("B", 2, "open", "", 5.0)]
    spark.createDataFrame(rows, "symbol string, bar long, kind string, side string, amount double").coalesce(1).write.parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema("symbol string, bar long, kind string, side string, amount double").parquet(str(tmp_path / "o"))
    run_stream(streaming.resting_orders(stream), "fills")
    got = [(r["symbol"], r["bar"], r["side"], round(r["qty"] * r["price"], 6), r["price"]) for r in spark.table("fills").collect()]
    assert got == [("A", 3, "buy", 100.0, pytest.approx(10.005))]


def test_checkpoint_folder_must_be_shared(spark):
    from types import SimpleNamespace

    from tessera.session import checkpoint_dir

    far = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        checkpoint_dir(far)


def test_frames_have_the_columns_asked_for(spark):
    df = warehouse.fit_columns(spark.createDataFrame([(1, "x")], "A int, b string"), "a long, c double, b string", {"A": "a"})
    assert df.dtypes == [("a", "bigint"), ("c", "double"), ("b", "string")] and tuple(df.first()) == (1, None, "x")
