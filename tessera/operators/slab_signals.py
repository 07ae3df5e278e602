"""Signals of the ranked strategies from slabs: only rebalance rows of tradable names leave a task, and returns of the names that are held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slabs import Slab, Slabs, _unpack, deviation, highest, lag, mean

Form = Callable[[Slab], np.ndarray]


def past(x: np.ndarray, w: int, agg: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """``agg`` over the ``w`` sessions before each one; missing until there are ``w``."""
    out = lag(agg(x, w), 1)
    out[:w] = np.nan
    return out


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.nan, x)


def moved(back: int, skip: int = 0) -> Form:
    return lambda s: lag(s["close"], skip) / _nonzero(lag(s["close"], back)) - 1


def _with_market(s: Slab, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of every name's returns with the market's over the ``w`` sessions before, and the market's variance (missing where it does not vary)."""
    r, mk = s["ret"], s["mk"][:, 0]
    cov, var = np.full(r.shape, np.nan), np.full((len(r), 1), np.nan)
    for t in range(w, len(r)):
        x = mk[t - w : t]
        d = x - x.mean()
        cov[t] = d @ (r[t - w : t] - r[t - w : t].mean(axis=0)) / w
        var[t] = (d * d).mean() if x.max() > x.min() else np.nan
    return cov, var


def beta(w: int) -> Form:
    def form(s: Slab) -> np.ndarray:
        cov, var = _with_market(s, w)
        return cov / var

    return form


def residual(w: int) -> Form:
    def form(s: Slab) -> np.ndarray:
        cov, var = _with_market(s, w)
        out = np.sqrt(np.fmax(past(s["ret"], w, deviation) ** 2 - cov * cov / var, 0))
        out[:w] = np.nan
        return out

    return form


def volatility(s: Slab) -> np.ndarray:
    return past(s["ret"], 63, deviation)


def to_high(s: Slab) -> np.ndarray:
    return s["close"] / _nonzero(past(s["close"], 252, highest))


def largest(s: Slab) -> np.ndarray:
    return past(s["ret"], 21, highest)


def illiquidity(s: Slab) -> np.ndarray:
    return past(np.abs(s["ret"]) / _nonzero(s["dv"]) * 1e6, 21, mean)


def turnover(s: Slab) -> np.ndarray:
    return past(s["volume"], 21, mean)


def market(s: Slabs) -> DataFrame:
    """(t_idx, mk), the mean return of every session's tradable names."""
    return s.sums.selectExpr("t_idx", "k / nullif(kn, 0) as mk")


def _market(s: Slabs) -> np.ndarray:
    out = np.zeros((s.n_t, 1))
    for r in market(s).filter("mk is not null").collect():
        out[r["t_idx"]] = r["mk"]
    return out


def signals(s: Slabs, hold: int, forms: dict[str, Form], every: int | None = None) -> DataFrame:
    """(symbol, t_idx, tradable, ret, one column a form) of the tradable names at every ``hold``-th session; with ``every``, of all rows there of that name."""
    n_t, mk = s.n_t, _market(s)
    schema = pa.schema([("symbol", pa.int64()), ("t_idx", pa.int32()), ("tradable", pa.bool_()), ("ret", pa.float64()), *((n, pa.float64()) for n in forms)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _unpack(batches, n_t):
            x.made["mk"] = mk
            with np.errstate(all="ignore"):
                ok = x["tradable"] if every is None else np.broadcast_to(x.symbols == every, x["close"].shape)
                t, c = np.nonzero(ok[::hold])
                if not len(t):
                    continue
                cols = [pa.array(v[::hold][t, c], from_pandas=True) for v in (x["ret"], *(f(x) for f in forms.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(x.symbols[c]), pa.array((t * hold).astype(np.int32)), pa.array(x["tradable"][t * hold, c]), *cols], schema=schema)

    return s.rows.mapInArrow(run, ", ".join(("symbol long", "t_idx int", "tradable boolean", "ret double", *(f"{n} double" for n in forms))))


def returns(s: Slabs, names: DataFrame) -> DataFrame:
    """(symbol, t_idx, ret) of every session for the few ``names`` (symbol) that some book holds."""
    return s.columns(("ret",)).join(F.broadcast(names), "symbol")


def above_mean(s: Slabs, w: int, bps: float) -> DataFrame:
    """(t_idx, r), the net return of equal weights in the names above the mean of the ``w`` sessions before; from three sums a session."""
    n_t = s.n_t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, a, b = np.zeros((3, n_t))
        for x in _unpack(batches, n_t):
            up = x["tradable"] & (x["close"] > past(x["close"], w, mean) + 1e-9)
            u += up.sum(axis=1)
            a[1:] += (up[:-1] * x["ret"][1:]).sum(axis=1)
            b[1:] += (up[:-1] & up[1:]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(n_t, dtype=np.int32), u, a, b)], ["t_idx", "u", "a", "b"])

    sums = s.rows.mapInArrow(run, "t_idx int, u double, a double, b double").groupBy("t_idx").agg(*[F.sum(x).alias(x) for x in "uab"])
    before = sums.selectExpr("*", "coalesce(lag(u) over (order by t_idx), 0) as u0")
    at, at0 = "greatest(u, 1)", "greatest(u0, 1)"
    return before.selectExpr("t_idx", f"a / {at0} - (b * abs(1 / {at} - 1 / {at0}) + (u - b) / {at} + (u0 - b) / {at0}) * {bps} / 1e4 as r")
