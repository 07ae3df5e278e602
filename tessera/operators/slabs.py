"""Price features and their cross-sections from slabs: compressed rows that hold the whole histories of some names.

The dense panel with its features is many times its input. Here it never reaches a disk: a
slab of bars is unpacked in memory, its features are formed there by the definitions of
``features``, and only rounded values of usable rows travel to their session, as compressed
integers. Missing is NaN inside a slab. Arrays are sessions x names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.sql import Chain, Dialect
from tessera.session import cut, scratch, tidy
from tessera.sources import panel as P

from .features import PRICE_FEATURES

#: Names of a slab at least (where a partition has them), features that travel together, features of a pass.
NAMES, BLOCK, PASS = 96, 8, 16
YEAR = np.sqrt(252.0)
EPS = 1e-12


# ---- doubles as bytes -----------------------------------------------------------


def coded(x: np.ndarray, scale: float = 1.0) -> tuple[int, np.ndarray]:
    """Doubles as unsigned integers: small ones for whole multiples of 1 / ``scale`` (kind 0), else their bits (kind 1)."""
    y = np.rint(x * scale)
    gone = np.isnan(x)
    if not (gone | ((np.abs(y) < 2**53) & (y / scale == x))).all():
        return 1, np.ascontiguousarray(x, dtype=np.float64).view(np.uint64)
    k = np.where(gone, 0, y).astype(np.int64)
    return 0, np.where(gone, 0, ((k << 1) ^ (k >> 63)) + 1).astype(np.uint64)


def squeezed(kind: int, u: np.ndarray) -> bytes:
    """The bytes of ``u`` in planes, low ones first and no more than its largest value has, compressed."""
    flat = np.ascontiguousarray(u).ravel()
    planes = max(1, (int(flat.max(initial=0)).bit_length() + 7) // 8)
    raw = flat.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes((kind, planes)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueezed(b: bytes, n: int) -> np.ndarray:
    """The ``n`` unsigned integers that ``squeezed`` has packed."""
    planes = b[1]
    raw = pa.Codec("zstd").decompress(b[2:], decompressed_size=planes * n, asbytes=True)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return wide.view("<u8").ravel()


def spread(b: bytes, shape: tuple[int, ...], scale: float = 1.0) -> np.ndarray:
    """The doubles that ``coded`` and ``squeezed`` have packed."""
    kind, u = b[0], unsqueezed(b, int(np.prod(shape)))
    if kind:
        return u.view(np.float64).reshape(shape)
    z = (u - np.uint64(1)).astype(np.int64)
    return np.where(u == 0, np.nan, ((z >> 1) ^ -(z & 1)) / scale).reshape(shape)


def key(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded to ``digits`` places, halves away from zero, in units of the last place."""
    y = x * 10.0**digits
    return np.copysign(np.floor(np.abs(y) + 0.5), y)


# ---- windows --------------------------------------------------------------------


def lag(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    if k >= 0:
        out[k:] = x[: max(len(x) - k, 0)]
    else:
        out[:k] = x[-k:]
    return out


def at_least(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, EPS)


def change(x: np.ndarray, k: int) -> np.ndarray:
    before = lag(x, k)
    return (x - before) / at_least(np.abs(before))


def count(x: np.ndarray, w: int) -> np.ndarray:
    c = np.cumsum(~np.isnan(x), axis=0)
    n = c.copy()
    n[w:] -= c[:-w]
    return n


def total(x: np.ndarray, w: int) -> np.ndarray:
    """Sum of the present values of the trailing ``w``, oldest first; missing without any."""
    there, out = np.where(np.isnan(x), 0.0, x), np.zeros_like(x)
    for k in range(min(w, len(x)) - 1, -1, -1):
        out[k:] += there[: len(x) - k]
    return np.where(count(x, w) > 0, out, np.nan)


def mean(x: np.ndarray, w: int) -> np.ndarray:
    return total(x, w) / count(x, w)


def deviation(x: np.ndarray, w: int) -> np.ndarray:
    """Population deviation of the present values."""
    there, has, m, out = np.where(np.isnan(x), 0.0, x), (~np.isnan(x)).astype(float), mean(x, w), np.zeros_like(x)
    for k in range(min(w, len(x)) - 1, -1, -1):
        d = (there[: len(x) - k] - m[k:]) * has[: len(x) - k]
        d *= d
        out[k:] += d
    return np.sqrt(out / count(x, w))


def highest(x: np.ndarray, w: int) -> np.ndarray:
    """Largest present value of the trailing ``w``, from spans that double."""
    y, span = np.where(np.isnan(x), -np.inf, x), 1

    def joined(y: np.ndarray, k: int) -> np.ndarray:
        out = y.copy()
        if 0 < k < len(y):
            np.maximum(y[k:], y[:-k], out=out[k:])
        return out

    while 2 * span <= w:
        y, span = joined(y, span), 2 * span
    y = joined(y, w - span)
    return np.where(np.isneginf(y), np.nan, y)


def lowest(x: np.ndarray, w: int) -> np.ndarray:
    return -highest(-x, w)


def below(x: np.ndarray, w: int) -> np.ndarray:
    """Share of the trailing window's other present values that lie strictly below the current one."""
    out, n = np.zeros_like(x), count(x, w)
    for k in range(1, min(w, len(x))):
        out[k:] += x[: len(x) - k] < x[k:]
    return np.where(n > 1, out / np.maximum(n - 1, 1), np.nan)


def median_at_least(x: np.ndarray, w: int, least: float) -> np.ndarray:
    """Whether the median of the present values of the trailing ``w`` reaches ``least``."""
    n = count(x, w)
    if not (x < least).any():
        return n > 0
    padded = np.concatenate([np.full((w - 1, x.shape[1]), np.nan), x])
    s = np.sort(np.lib.stride_tricks.sliding_window_view(padded, w, axis=0), axis=-1)
    lo, hi = (np.take_along_axis(s, np.maximum(i, 0)[..., None], -1)[..., 0] for i in ((n - 1) // 2, np.minimum(n // 2, w - 1)))
    return (n > 0) & ((lo + hi) / 2 >= least)


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean along time, seeded with the first value and held over gaps."""
    a, out, now = 2.0 / (span + 1.0), np.empty_like(x), np.full(x.shape[1], np.nan)
    for t, row in enumerate(x):
        now = np.where(np.isnan(row), now, np.where(np.isnan(now), row, a * row + (1 - a) * now))
        out[t] = now
    return out


# ---- the features of a slab -----------------------------------------------------


def _range(p: Slab) -> np.ndarray:
    before = p["prev"]
    span = np.fmax(p["high"] - p["low"], np.fmax(np.abs(p["high"] - before), np.abs(p["low"] - before)))
    return np.where(np.isnan(before), np.nan, span)


#: Name -> its form over a slab; the SQL of the same name in ``features`` and ``panel`` defines it.
FORMS: dict[str, Callable[[Slab], np.ndarray]] = {
    "prev": lambda p: lag(p["close"], 1),
    "r1": lambda p: change(p["close"], 1),
    "dv": lambda p: p["close"] * p["volume"],
    "ret": lambda p: np.nan_to_num((p["close"] - p["prev"]) / np.where(p["prev"] == 0, np.nan, p["prev"]), nan=0.0),
    "tradable": lambda p: (p["close"] > 0) & (p["close"] >= P.MIN_PRICE) & median_at_least(p["dv"], 20, P.MIN_DOLLAR_VOLUME),
    **{f"mom_{w}": lambda p, w=w: change(p["close"], w) for w in (1, 5, 10, 21, 63, 126, 252)},
    "mom_12_1": lambda p: lag(p["close"], 21) / at_least(lag(p["close"], 252)) - 1,
    **{f"ma_ratio_{w}": lambda p, w=w: p["close"] / at_least(mean(p["close"], w)) - 1 for w in (10, 21, 50, 200)},
    "high_252": lambda p: highest(p["close"], 252),
    "low_252": lambda p: lowest(p["close"], 252),
    "pct_52w_high": lambda p: p["close"] / at_least(p["high_252"]),
    "pct_52w_range": lambda p: (p["close"] - p["low_252"]) / at_least(p["high_252"] - p["low_252"]),
    **{f"vol_{w}": lambda p, w=w: deviation(p["r1"], w) * YEAR for w in (10, 21, 126)},
    "vol_63": lambda p: p["std_63"] * YEAR,
    "downside_vol_63": lambda p: deviation(np.where(p["r1"] < 0, p["r1"], np.nan), 63) * YEAR,
    "dev_63": lambda p: p["r1"] - mean(p["r1"], 63),
    "std_63": lambda p: deviation(p["r1"], 63),
    "tr": _range,
    "drawdown_63": lambda p: p["close"] / at_least(highest(p["close"], 63)) - 1,
    "dollar_vol_21": lambda p: np.log(1 + mean(p["dv"], 21)),
    "vol_surge": lambda p: mean(p["volume"], 5) / at_least(mean(p["volume"], 63)),
    "amihud_21": lambda p: mean(np.abs(p["r1"]) / at_least(p["dv"]) * 1e9, 21),
    "obv": lambda p: np.cumsum(np.nan_to_num(np.sign(p["r1"])) * np.nan_to_num(p["volume"]), axis=0),
    "up_14": lambda p: mean(np.where(p["r1"] > 0, p["r1"], 0.0), 14),
    "dn_14": lambda p: mean(np.where(p["r1"] < 0, -p["r1"], 0.0), 14),
    "bollinger_z": lambda p: (p["close"] - mean(p["close"], 20)) / at_least(deviation(p["close"], 20)),
    "clv": lambda p: (2 * p["close"] - p["high"] - p["low"]) / at_least(p["high"] - p["low"]),
    "gap": lambda p: (p["open"] - p["prev"]) / at_least(p["prev"]),
    "intraday_range": lambda p: (p["high"] - p["low"]) / at_least(p["close"]),
    "close_strength": lambda p: (p["close"] - p["open"]) / at_least(p["open"]),
    "beta_126": lambda p: mean(p["r1"] * p["mkt"], 126) / at_least(mean(p["mkt"] * p["mkt"], 126)),
    "rev_5": lambda p: -p["mom_5"],
    "rev_21": lambda p: -p["mom_21"],
    "vol_ratio": lambda p: p["vol_21"] / at_least(p["vol_126"]),
    "skew_63": lambda p: mean(p["dev_63"] * p["dev_63"] * p["dev_63"], 63) / at_least(p["std_63"] * p["std_63"] * p["std_63"]),
    "kurt_63": lambda p: mean(p["dev_63"] * p["dev_63"] * p["dev_63"] * p["dev_63"], 63) / at_least(p["std_63"] * p["std_63"] * p["std_63"] * p["std_63"]),
    "atr_14": lambda p: mean(p["tr"], 14) / at_least(p["close"]),
    "obv_slope_21": lambda p: change(p["obv"], 21),
    "rsi_14": lambda p: 100 - 100 / (1 + p["up_14"] / at_least(p["dn_14"])),
    "idio_vol_126": lambda p: deviation(p["r1"] - p["beta_126"] * p["mkt"], 126) * YEAR,
    "rel_strength_63": lambda p: p["mom_63"] - total(p["mkt"], 63),
    "ts_rank_63": lambda p: below(p["close"], 63),
    "macd": lambda p: ema(p["close"], 12) - ema(p["close"], 26),
    "macd_hist": lambda p: (p["macd"] - ema(p["macd"], 9)) / at_least(p["close"]),
}
BARS = ("open", "high", "low", "close", "volume")


class Slab:
    """The bars of some names and all that follows from them, each formed once when it is asked for."""

    def __init__(self, symbols: np.ndarray, bars: np.ndarray, mkt: np.ndarray | None = None, names: tuple[str, ...] = BARS) -> None:
        self.symbols = symbols
        self.made: dict[str, np.ndarray] = dict(zip(names, bars, strict=True))
        if mkt is not None:
            self.made["mkt"] = mkt[:, None]

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            with np.errstate(all="ignore"):
                self.made[name] = FORMS[name](self)
        return self.made[name]


def _pack(n_t: int):
    """Rows of bars, each name's together, to slabs."""

    def slab(symbol: np.ndarray, t: np.ndarray, bars: list[np.ndarray]) -> dict:
        names, col = np.unique(symbol, return_inverse=True)
        x = np.full((len(BARS), n_t, len(names)), np.nan)
        x[:, t, col] = bars
        return {"sid": int(names[0]), "n": len(names), "symbols": names.astype("<i8").tobytes(), **{b: squeezed(*coded(v, 1e6)) for b, v in zip(BARS, x, strict=True)}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
            first = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1  # the last name may go on in the next batch
            if len(first) >= NAMES:
                yield pa.RecordBatch.from_pylist([slab(*(p[: first[-1]] for p in held[:2]), [p[: first[-1]] for p in held[2:]])], schema=_SLAB)
                held = [p[first[-1] :] for p in held]
        if held is not None:
            yield pa.RecordBatch.from_pylist([slab(*held[:2], held[2:])], schema=_SLAB)

    return run


#: A slab is known by its first symbol.
_KINDS = {"sid": "long", "n": "int"}
_SLAB = pa.schema([("sid", pa.int64()), ("n", pa.int32()), ("symbols", pa.binary()), *((b, pa.binary()) for b in BARS)])


def _unpack(batches: Iterator[pa.RecordBatch], n_t: int, mkt: np.ndarray | None = None, names: tuple[str, ...] = BARS) -> Iterator[Slab]:
    for b in batches:
        for r in b.to_pylist():
            yield Slab(np.frombuffer(r["symbols"], "<i8"), np.stack([spread(r[x], (n_t, r["n"]), 1e6) for x in names]), mkt, names)


class Slabs:
    """All bars of the test tables as slabs under ``at``, with what every pass needs: sessions, market return, benchmark.

    Lines go to their name's partition once, as they are; bars follow there by the SQL of ``panel``.
    """

    #: Whether lines without a name are there: the dense panel has one row a session for them, without prices.
    nameless = False

    def __init__(self, spark: SparkSession, sf_dir: str, at: str) -> None:
        c = Chain(Dialect(sf_dir))
        t = c.d.table("lineitem")
        week = "cast(date_trunc('week', l_shipdate) as date)"
        c.add("bars", f"select distinct {week} as date from {t}")
        P.sessions(c)
        self.sessions = sessions = cut(spark.sql(c.select("select date, t_idx from sessions")))
        self.n_t = sessions.count()
        c = Chain(Dialect(sf_dir))
        P.bars(c)
        c.parts["wk"] = c.parts["wk"].replace(f"from {t}", f"from (select l_suppkey, l_shipdate, l_discount, l_tax, l_quantity from {t} distribute by l_suppkey) l")
        bars = spark.sql(c.select("select * from bars")).join(F.broadcast(sessions), "date").filter("symbol is not null")
        rows = bars.select(F.col("symbol").cast("long"), "t_idx", *[F.col(b).cast("double") for b in BARS]).sortWithinPartitions("symbol")
        rows.mapInArrow(_pack(self.n_t), ", ".join(f"{f.name} {_KINDS.get(f.name, 'binary')}" for f in _SLAB)).write.parquet(at)
        del bars, rows
        tidy(spark)
        self.rows = spark.read.parquet(at)
        self.sums = cut(self.rows.mapInArrow(_session_sums(self.n_t), "t_idx int, r double, rn long, b double, bn long, k double, kn long").groupBy("t_idx").agg(*[F.sum(x).alias(x) for x in ("r", "rn", "b", "bn", "k", "kn")]))
        self.mkt = np.full(self.n_t, np.nan)
        for r in self.sums.filter("rn > 0").collect():
            self.mkt[r["t_idx"]] = r["r"] / r["rn"]

    def names(self) -> DataFrame:
        """(symbol) of every name."""
        return self.rows.select("sid", "symbols").mapInArrow(_named, "sid long, symbol long").select("symbol")

    def mean_closes(self, n: int) -> DataFrame:
        """(k, t_idx, v), every session's mean close of the names whose symbol leaves ``k`` of ``n``."""
        part = self.rows.mapInArrow(_closes(self.n_t, n), "k long, t_idx int, s double, c long")
        return part.groupBy("k", "t_idx").agg((F.sum("s") / F.sum("c")).alias("v"))

    def benchmark(self) -> DataFrame:
        """(t_idx, bench) as ``evaluation.benchmark`` has it."""
        return self.sums.selectExpr("t_idx", "coalesce(b / greatest(bn, 1), 0) as bench")

    def momentum_book(self, k: int, rb: int) -> dict[str, DataFrame]:
        """What ``evaluation.backtest`` reads of the momentum score's ``k`` best at every ``rb``-th session: their weights and next returns, days, benchmark."""
        found = self.rows.mapInArrow(_best(self.n_t, k, rb), "t_idx int, symbol long, mom double, r array<double>")
        order = W.partitionBy("t_idx").orderBy(F.col("mom").desc(), F.col("symbol").desc())
        book = cut(found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k))
        return {
            "w": book.selectExpr(f"cast(floor(t_idx / {rb}) as int) as blk", "symbol", "1e0 / count(*) over (partition by t_idx) as w"),
            "score": book.selectExpr("symbol", "t_idx as t0", "posexplode(r) as (i, ret)").selectExpr("symbol", "t0 + 1 + i as t_idx", "ret"),
            "days": self.sums.filter("t_idx >= 1").selectExpr("t_idx", f"cast(floor((t_idx - 1) / {rb}) as int) as blk"),
            "bench": self.benchmark(),
        }

    def shifted_books(self, k: int, wanted: list[tuple]) -> dict[str, DataFrame]:
        """What replicas of the momentum score read at the rebalance rows ``wanted`` (strategy, t_src, t_idx, rb), whose names may trade there but rank by ``t_src``.

        ``lng`` has the ``k`` best of each alone, with places for scores (more is better), and ``rets`` their sessions until the next rebalance row.
        """
        found = self.rows.mapInArrow(_best_shifted(self.n_t, k, wanted), "strategy string, t_src int, t_idx int, symbol long, mom double, r array<double>, ok array<boolean>")
        order = W.partitionBy("strategy", "t_src").orderBy(F.col("mom").desc(), F.col("symbol").desc())
        best = cut(found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k))
        steps = best.selectExpr("symbol", "t_idx as t0", "posexplode(arrays_zip(r, ok)) as (i, z)")
        return {
            "lng": best.selectExpr("strategy", "symbol", "t_src", f"cast({k} - rn as double) as score"),
            "rets": cut(steps.selectExpr("symbol", "t0 + i as t_idx", "z.r as ret", "z.ok as tradable").distinct()),
            "bench": self.benchmark(),
            "sessions": self.sessions,
        }

    def group_sums(self, members: DataFrame) -> DataFrame:
        """(g, t_idx, s, c) of every group of ``members`` (symbol, g int) and session: the sum of today's returns of its names that were tradable the session before, and their number."""
        named = self.rows.select("sid", "symbols").mapInArrow(_named, "sid long, symbol long")
        own = members.join(named, "symbol").groupBy("sid", "g").agg(F.collect_list("symbol").alias("names"))
        own = own.groupBy("sid").agg(F.collect_list(F.struct("g", "names")).alias("own"))
        part = self.rows.select("sid", "n", "symbols", *BARS).join(own, "sid").mapInArrow(_group_sums(self.n_t), "g int, t_idx int, s double, c long")
        return part.groupBy("g", "t_idx").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))

    def coefficients(self, horizon: int, least: int) -> DataFrame:
        """(feature, t_idx, ic, n) of every session that has one; and at ``t_idx`` -1 (feature, n, lo, hi) of all rows.

        Some features travel in each pass and their files go before the next, which bounds the disk.
        """
        out = None
        for i in range(0, len(PRICE_FEATURES), PASS):
            got = cut(self._by_session(PRICE_FEATURES[i : i + PASS], forward(horizon), coefficients_of(least), True, "feature string, t_idx int, ic double, n long, lo double, hi double"))
            out = got if out is None else out.unionByName(got)
            tidy(self.rows.sparkSession)
        return out

    def spreads(self, names: tuple[str, ...]) -> DataFrame:
        """(strategy, t_idx, x), the mean next return of the upper half by each feature less that of all."""
        return self._by_session(names, _next_return, _spreads, False, "strategy string, t_idx int, x double")

    def all_spreads(self, names: tuple[str, ...]) -> DataFrame:
        """``spreads`` of many features, a few in each pass; the rows found are kept, a pass's files are not."""
        passes = []
        for i in range(0, len(names), PASS):
            passes.append(cut(self.spreads(names[i : i + PASS])))
            tidy(self.rows.sparkSession)
        return reduce(DataFrame.unionByName, passes)

    def columns(self, names: tuple[str, ...]) -> DataFrame:
        """(symbol, t_idx, one column a feature) of the dense panel; slabs that are kept are unpacked where they lie."""
        schema = pa.schema([("symbol", pa.int64()), ("t_idx", pa.int32()), *((n, pa.float64()) for n in names)])
        ddl = ", ".join(("symbol long", "t_idx int", *(f"{n} double" for n in names)))
        out = self.rows.mapInArrow(_rows(self.n_t, self.mkt, names, schema), ddl)
        if not self.nameless:
            return out
        return out.unionByName(self.rows.sparkSession.range(1).mapInArrow(_nameless(self.n_t, self.mkt, names, schema), ddl))

    def _by_session(self, names: tuple[str, ...], target: Callable, found: Callable, totals: bool, schema: str) -> DataFrame:
        blocks = [names[i : i + BLOCK] for i in range(0, len(names), BLOCK)]
        parts = self.rows.mapInArrow(_dealt(self.n_t, self.mkt, blocks, target, totals), "t_idx int, blk int, n int, y binary, x binary")
        return parts.groupBy("t_idx", "blk").applyInArrow(_solved(blocks, found, schema), schema)


class Beside:
    """Slabs that meet further rows of their names: every slab with those of its own in one task, each slab once."""

    def __init__(self, slabs: Slabs, rows: DataFrame, bars: tuple[str, ...]) -> None:
        self.slabs, self.bars = slabs, bars
        names = slabs.rows.select("sid", "symbols").mapInArrow(_named, "sid long, symbol long")
        self.rows = rows.join(names, "symbol")

    def map(self, form: Callable[[Slab, pa.Table], Iterator[pa.RecordBatch]], ddl: str, schema: pa.Schema) -> DataFrame:
        n_t, bars, mkt = self.slabs.n_t, self.bars, self.slabs.mkt

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = [b for s in _unpack(left.to_batches(), n_t, mkt, bars) for b in form(s, right)]
            return pa.Table.from_batches(out, schema=schema)

        left = self.slabs.rows.select("sid", "n", "symbols", *self.bars)
        return left.groupBy("sid").cogroup(self.rows.groupBy("sid")).applyInArrow(run, ddl)

    def judged(self, blocks: list[tuple[str, ...]], opened: Callable[[Slab, pa.Table], None], horizon: int, least: int, flat: float) -> DataFrame:
        """Coefficients as ``JUDGED`` has them, of features that ``opened`` lays into a slab."""
        target = forward_of_all(horizon)

        def form(s: Slab, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            opened(s, rows)
            for _, _, out in dealt(s, blocks, target):
                if out:
                    yield _pieces(out)

        parts = self.map(form, "t_idx int, blk int, n int, y binary, x binary", _pieces_schema)
        return parts.groupBy("t_idx", "blk").applyInArrow(_solved(blocks, judged(least, flat), JUDGED), JUDGED)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            symbols = np.frombuffer(r["symbols"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(symbols), r["sid"], np.int64)), pa.array(symbols)], ["sid", "symbol"])


def kept_slabs(spark: SparkSession, sf_dir: str) -> Slabs:
    """Slabs for a result that is read later: their rows are a checkpoint, which goes when nothing refers to it."""
    with scratch(spark, "slabs") as at:
        slabs = Slabs(spark, sf_dir, at)
        slabs.rows = cut(slabs.rows)
        slabs.nameless = not spark.sql(f"select 1 from {Dialect(sf_dir).table('lineitem')} where l_suppkey is null limit 1").isEmpty()
    return slabs


# ---- passes ---------------------------------------------------------------------


def _session_sums(n_t: int):
    """Of every session: sum and number of returns, of today's returns of yesterday's tradable names, and of today's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rn, b, bn, k, kn = (np.zeros(n_t, kind) for kind in (float, np.int64) * 3)
        for s in _unpack(batches, n_t):
            r += np.nansum(s["r1"], axis=1)
            rn += (~np.isnan(s["r1"])).sum(axis=1)
            held = s["tradable"][:-1]
            b[1:] += (s["ret"][1:] * held).sum(axis=1)
            bn[1:] += held.sum(axis=1)
            k += (s["ret"] * s["tradable"]).sum(axis=1)
            kn += s["tradable"].sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(n_t, dtype=np.int32), r, rn, b, bn, k, kn)], ["t_idx", "r", "rn", "b", "bn", "k", "kn"])

    return run


def _group_sums(n_t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                (s,), own = _unpack(iter([row]), n_t), row.column("own").to_pylist()[0]
                held = np.zeros(s["ret"].shape)
                held[1:] = s["tradable"][:-1]
                # One column a group; names x groups.
                of = np.array([np.isin(s.symbols, g["names"]) for g in own], float).T
                r, c = (held * s["ret"]) @ of, held @ of
                for k, g in enumerate(own):
                    sums.setdefault(g["g"], np.zeros((2, n_t)))[:] += r[:, k], c[:, k]
        for g, (r, c) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n_t, g, np.int32), np.arange(n_t, dtype=np.int32), r, c.astype(np.int64))], ["g", "t_idx", "s", "c"])

    return run


def _closes(n_t: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for s in _unpack(batches, n_t):
            rest = np.fmod(s.symbols, n)
            for k in np.unique(rest):
                x = s["close"][:, rest == k]
                sums.setdefault(int(k), np.zeros((2, n_t)))[:] += np.nansum(x, axis=1), (~np.isnan(x)).sum(axis=1)
        for k, (total, c) in sums.items():
            t = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(t), k, np.int64), t.astype(np.int32), total[t], c[t].astype(np.int64))], ["k", "t_idx", "s", "c"])

    return run


def _rows(n_t: int, mkt: np.ndarray, names: tuple[str, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _unpack(batches, n_t, mkt):
            n = len(s.symbols)
            cols = [pa.array(s[f].T.ravel(), from_pandas=True) for f in names]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.symbols, n_t)), pa.array(np.tile(np.arange(n_t, dtype=np.int32), n)), *cols], schema=schema)

    return run


def _nameless(n_t: int, mkt: np.ndarray, names: tuple[str, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Slab(np.zeros(b.num_rows, np.int64), np.full((len(BARS), n_t, b.num_rows), np.nan), mkt)
            cols = [pa.array(s[f].T.ravel(), from_pandas=True) for f in names]
            yield pa.RecordBatch.from_arrays([pa.nulls(n_t * b.num_rows, pa.int64()), pa.array(np.tile(np.arange(n_t, dtype=np.int32), b.num_rows)), *cols], schema=schema)

    return run


def _best(n_t: int, k: int, rb: int):
    at = range(0, n_t - 1, rb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for s in _unpack(batches, n_t):
            mom = np.where(s["tradable"], key(s["mom_21"], 9), np.nan)
            for t in at:
                i = np.flatnonzero(~np.isnan(mom[t]))
                if not len(i):
                    continue
                new = (s.symbols[i], mom[t, i], s["ret"][t + 1 : t + 1 + rb, i].T)
                new = tuple(np.concatenate(p) for p in zip(best[t], new, strict=True)) if t in best else new
                first = np.lexsort((-new[0], -new[1]))[:k]
                best[t] = tuple(p[first] for p in new)
        for t, (symbol, m, r) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(symbol), pa.array(m), pa.array(list(r), pa.list_(pa.float64()))], ["t_idx", "symbol", "mom", "r"])

    return run


def _best_shifted(n_t: int, k: int, wanted: list[tuple]):
    """Of every (strategy, t_src, t_idx, rb) a task's best names by the momentum of ``t_src`` that are tradable on both days, with returns and masks from ``t_idx`` on."""
    src, at = np.array([(t_src, t) for _, t_src, t, _ in wanted], int).reshape(-1, 2).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        least = np.full(len(wanted), -np.inf)
        for s in _unpack(batches, n_t):
            mom = np.where(s["tradable"], key(s["mom_21"], 9), np.nan)[src]
            chance = s["tradable"][at] & (mom >= least[:, None])
            for p in np.flatnonzero(chance.any(axis=1)):
                i, (_, _, t, rb) = np.flatnonzero(chance[p]), wanted[p]
                new = (s.symbols[i], mom[p, i], s["ret"][t : t + rb + 1, i].T, s["tradable"][t : t + rb + 1, i].T)
                new = tuple(np.concatenate(x) for x in zip(best[p], new, strict=True)) if p in best else new
                first = np.lexsort((-new[0], -new[1]))[:k]
                best[p] = tuple(x[first] for x in new)
                if len(first) == k:
                    least[p] = best[p][1][-1]
        for p, (symbol, m, r, ok) in best.items():
            n, (strategy, t_src, t, _) = len(m), wanted[p]
            cols = (pa.array([strategy] * n), pa.array(np.full(n, t_src, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(symbol), pa.array(m), pa.array(r.tolist(), pa.list_(pa.float64())), pa.array(ok.tolist(), pa.list_(pa.bool_())))
            yield pa.RecordBatch.from_arrays(list(cols), ["strategy", "t_src", "t_idx", "symbol", "mom", "r", "ok"])

    return run


def forward(h: int):
    def target(s: Slab) -> tuple[np.ndarray, np.ndarray]:
        """The return from the next session to ``h`` after it, and the rows that have one and are tradable."""
        start = lag(s["close"], -1)
        y = key(lag(s["close"], -(h + 1)) / np.where(start == 0, np.nan, start) - 1, 9)
        return y, s["tradable"] & ~np.isnan(y)

    return target


def forward_of_all(h: int):
    """The same return of every tradable row, also where it is missing."""

    def target(s: Slab) -> tuple[np.ndarray, np.ndarray]:
        return forward(h)(s)[0], s["tradable"]

    return target


def _next_return(s: Slab) -> tuple[np.ndarray, np.ndarray]:
    """The return of a name's next tradable session (missing at its last), and the tradable rows."""
    r, ok = np.nan_to_num(s["r1"], nan=0.0), s["tradable"]
    y, now = np.empty_like(r), np.full(r.shape[1], np.nan)
    for t in range(len(r) - 1, -1, -1):
        y[t] = now
        now = np.where(ok[t], r[t], now)
    return y, ok


def dealt(s: Slab, blocks: list[tuple[str, ...]], target: Callable) -> Iterator[tuple[int, np.ndarray, list[tuple]]]:
    """Of every block of features of a slab: its number, the rounded features of all rows, and the pieces of sessions with the usable ones."""
    with np.errstate(all="ignore"):
        y, ok = target(s)
        kind_y, code_y = coded(y)
        cols = [np.flatnonzero(row) for row in ok]
        own = [(t, c, squeezed(kind_y, code_y[t, c])) for t, c in enumerate(cols) if len(c)]
        for k, names in enumerate(blocks):
            x = np.stack([key(s[n], 8) for n in names], axis=1)
            kind, code = coded(x)
            yield k, x, [(t, k, len(c), b, squeezed(kind, code[t][:, c])) for t, c, b in own]


def _dealt(n_t: int, mkt: np.ndarray, blocks: list[tuple[str, ...]], target: Callable, totals: bool):
    """Slabs to pieces of sessions: rounded features of the usable rows by block, each with the target. At session -1, counts and ranges of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {n: np.array([0.0, np.inf, -np.inf]) for b in blocks for n in b}
        for s in _unpack(batches, n_t, mkt):
            for k, x, out in dealt(s, blocks, target):
                if totals:
                    for i, n in enumerate(blocks[k]):
                        v = x[:, i][~np.isnan(x[:, i])]
                        seen[n] += (len(v), 0, 0)
                        seen[n][1:] = min(seen[n][1], v.min(initial=np.inf)), max(seen[n][2], v.max(initial=-np.inf))
                if out:
                    yield _pieces(out)
        if totals:
            yield _pieces([(-1, k, 0, b"", np.array([seen[n] for n in names]).tobytes()) for k, names in enumerate(blocks)])

    return run


_pieces_schema = pa.schema([("t_idx", pa.int32()), ("blk", pa.int32()), ("n", pa.int32()), ("y", pa.binary()), ("x", pa.binary())])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _pieces_schema, strict=True)], schema=_pieces_schema)


def _solved(blocks: list[tuple[str, ...]], found: Callable, schema: str):
    """All pieces of a session and block to its results."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    out = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        t, names = group[0].as_py(), blocks[group[1].as_py()]
        parts = rows.select(["n", "y", "x"]).to_pylist()
        if t < 0:
            every = np.array([np.frombuffer(r["x"], float).reshape(len(names), 3) for r in parts])
            n, lo, hi = every[..., 0].sum(axis=0), every[..., 1].min(axis=0), every[..., 2].max(axis=0)
            got = [{"feature": f, "t_idx": t, "n": int(n[i]), **({"lo": lo[i], "hi": hi[i]} if n[i] else {})} for i, f in enumerate(names)]
        else:
            y = np.concatenate([spread(r["y"], (r["n"],)) for r in parts])
            x = np.concatenate([spread(r["x"], (len(names), r["n"])) for r in parts], axis=1)
            got = [{**r, "t_idx": t} for r in found(names, x, y)]
        return pa.Table.from_pylist([{f: r.get(f) for f in out.names} for r in got], schema=out)

    return run


def average_rank(v: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Average-tie rank in (0, 1] of values without a missing one, from the order that sorts them."""
    s = v[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    last = np.append(first[1:], len(s))
    out = np.empty(len(s))
    out[order] = np.repeat((first + 1 + last) / 2.0 / len(s), last - first)
    return out


def coefficients_of(least: int):
    def found(names: tuple[str, ...], x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        by_y = np.argsort(y)
        for name, v in zip(names, x, strict=True):
            has = ~np.isnan(v) & ~np.isnan(y)
            n = int(has.sum())
            if n < least:
                continue
            # Places of the present rows among themselves, in the order of their targets.
            order = (np.cumsum(has) - 1)[by_y[has[by_y]]]
            ry, rx = average_rank(y[has], order), average_rank(v[has], np.argsort(v[has]))
            if (sx := rx.std()) > 1e-9 and (sy := ry.std()) > 1e-9:
                yield {"feature": name, "ic": float(((rx - rx.mean()) * (ry - ry.mean())).mean() / (sx * sy)), "n": n}

    return found


def judged(least: int, flat: float):
    """The coefficient of every feature where it has one, and whether its names hardly differ (``flat``: deviation to mean size), given two of them."""
    found = coefficients_of(least)

    def both(names: tuple[str, ...], x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        got = {r["feature"]: r for r in found(names, x, y)}
        for name, v in zip(names, x, strict=True):
            if len(u := v[~np.isnan(v)] / 1e8) >= 2:
                yield {"feature": name, **got.get(name, {}), "flat": float(u.std() / at_least(np.abs(u).mean()) < flat)}

    return both


JUDGED = "feature string, t_idx int, ic double, n long, flat double"


def _spreads(names: tuple[str, ...], x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
    for name, v in zip(names, x, strict=True):
        has = np.flatnonzero(~np.isnan(v))
        if not len(has):
            continue
        upper, nxt = average_rank(v[has], np.argsort(v[has])) > 0.5, y[has]
        known = ~np.isnan(nxt)
        if known.any():
            up = nxt[known & upper]
            yield {"strategy": name, "x": float(up.mean() - nxt[known].mean()) if len(up) else None}
