"""Scores of a population of trees from slabs, and the names that its books can hold.

A slab has whole histories, so operators along time and all pointwise ones are formed where it
lies. Deviations from a session's mean need two figures a session. A rank inside a tree needs all
names of a session: rounded values of tradable rows travel there, a few trees in a pass, and
ordinals come back to their slab. A rank at the root moves no score past another, so it is not
formed for all names: the best of every task meet, and their places follow from the number of
names. A book holds its strategy's best names at rebalance rows; only those travel, with their
returns until the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut, drop, tidy

from . import expression as X
from .slabs import BARS, BLOCK, Slab, Slabs, at_least, below, coded, coefficients_of, deviation, forward, key, lag, mean, spread, squeezed, unsqueezed

BIG = 1e12
_RANKS = "array<struct<t:int,ids:array<string>,m:array<int>,x:binary>>"


# ---- trees over a slab ------------------------------------------------------------


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(np.abs(b) >= 1e-12, b, np.nan)


#: Operator -> its form; the SQL of ``expression.render`` defines it. As there, the lesser and greater of two pass over a missing one.
FORMS: dict[str, Callable[..., np.ndarray]] = {
    "neg": lambda x: -x,
    "abs": np.abs,
    "sign": np.sign,
    "log1p": lambda x: np.log(1 + np.abs(x)) * np.sign(x),
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30))),
    "square": lambda x: np.clip(x * x, -BIG, BIG),
    "sqrt_abs": lambda x: np.sqrt(np.abs(x)) * np.sign(x),
    "add": np.add,
    "sub": np.subtract,
    "mul": lambda a, b: np.clip(a * b, -BIG, BIG),
    "div": _div,
    "min": np.fmin,
    "max": np.fmax,
    "ite": lambda c, a, b: np.where(c > 0, a, b),
}
TIMED: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "delta": lambda x, w: x - lag(x, w),
    "tsmean": mean,
    "tsstd": deviation,
    "tsrank": lambda x, w: below(key(x, 9), w),
}


def masked(n: X.Node, s: Slab, moments: dict[str, tuple]) -> np.ndarray:
    """The input of an operator across names: the tradable rows alone."""
    return np.where(s["tradable"], value(n.args[0], s, moments), np.nan)


def value(n: X.Node, s: Slab, moments: dict[str, tuple]) -> np.ndarray:
    """A tree over a slab whose ranks are known; each distinct sub-tree is formed once."""
    if n.op == "feat":
        return s[n.name]
    name = f"={n.canonical()}"
    if name not in s.made:
        with np.errstate(all="ignore"):
            if n.op == "const":
                s.made[name] = np.full(s["close"].shape, n.value)
            elif n.op in X.CROSS:  # ranks are given with the slab
                m, sd = (v[:, None] for v in moments[n.canonical()])
                x = masked(n, s, moments) - m
                s.made[name] = x / at_least(sd) if n.op == "zscore" else x
            elif n.op in TIMED:
                s.made[name] = TIMED[n.op](value(n.args[0], s, moments), n.window)
            else:
                s.made[name] = FORMS[n.op](*(value(a, s, moments) for a in n.args))
    return s.made[name]


def crossings(trees: dict[str, X.Node]) -> list[list[X.Node]]:
    """Operators across names that must be known for all names, by levels: each level's inputs need earlier ones alone. A rank at a root is none of them."""
    level: dict[str, int] = {}
    found: list[dict[str, X.Node]] = []

    def place(n: X.Node, root: bool) -> int:
        at = max((place(a, False) for a in n.args), default=0)
        if n.op in X.CROSS and not (root and n.op == "rank"):
            while len(found) <= at:
                found.append({})
            found[at][n.canonical()] = n
            at += 1
        return level.setdefault(n.canonical(), at)

    for t in trees.values():
        place(t, True)
    return [list(x.values()) for x in found]


def unpack(batches: Iterator[pa.RecordBatch], n_t: int, mkt: np.ndarray) -> Iterator[Slab]:
    """Slabs with the ranks that came back to them."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            s = Slab(np.frombuffer(r["symbols"], "<i8"), np.stack([spread(r[x], (n_t, r["n"]), 1e6) for x in BARS]), mkt)
            with np.errstate(all="ignore"):
                ok = s["tradable"]
            for got in r["ranks"] or ():
                c = np.flatnonzero(ok[got["t"]])
                o = unsqueezed(got["x"], len(got["ids"]) * len(c)).reshape(len(got["ids"]), len(c))
                for name, m, row in zip(got["ids"], got["m"], o, strict=True):
                    x = s.made.setdefault(f"={name}", np.full((n_t, r["n"]), np.nan))
                    x[got["t"], c] = np.where(row > 0, (row.astype(np.int64) - 1) / max(m - 1, 1), np.nan)
            yield s


# ---- passes -----------------------------------------------------------------------


def _moments(n_t: int, mkt: np.ndarray, nodes: list[X.Node], known: dict[str, tuple]):
    """Of every session and operator: number, mean, squared deviations, least and greatest of a slab's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in unpack(batches, n_t, mkt):
            for n in nodes:
                x = masked(n, s, known)
                has = (~np.isnan(x)).sum(axis=1)
                t = np.flatnonzero(has)
                m = np.nansum(x[t], axis=1) / has[t]
                d = np.nansum((x[t] - m[:, None]) ** 2, axis=1)
                lo, hi = np.fmin.reduce(x[t], axis=1), np.fmax.reduce(x[t], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([n.canonical()] * len(t), pa.string()), pa.array(t.astype(np.int32)), *map(pa.array, (has[t], m, d, lo, hi))], ["id", "t_idx", "n", "m", "d", "lo", "hi"])

    return run


def _to_sessions(n_t: int, mkt: np.ndarray, blocks: list[list[X.Node]], known: dict[str, tuple]):
    """Rounded values of the tradable rows by session and block of ranks, each with its slab and symbols."""
    kinds = {"sid": pa.int64(), "t_idx": pa.int32(), "blk": pa.int32(), "n": pa.int32(), "y": pa.binary(), "x": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in unpack(batches, n_t, mkt):
            cols = [np.flatnonzero(row) for row in s["tradable"]]
            sid, own = int(s.symbols[0]), [squeezed(2, s.symbols[c].view(np.uint64)) for c in cols]
            for k, nodes in enumerate(blocks):
                kind, code = coded(np.stack([key(masked(n, s, known), 9) for n in nodes], axis=1))
                rows = [(sid, t, k, len(c), own[t], squeezed(kind, code[t][:, c])) for t, c in enumerate(cols) if len(c)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return run


def _ordinals(blocks: list[list[X.Node]]):
    """All pieces of a session to the ordinals (from 1; 0: missing) of each piece; ties by symbol."""
    names = [[n.canonical() for n in b] for b in blocks]
    out = pa.schema([("sid", pa.int64()), ("t", pa.int32()), ("ids", pa.list_(pa.string())), ("m", pa.list_(pa.int32())), ("x", pa.binary())])

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        t, ids = group[0].as_py(), names[group[1].as_py()]
        parts = rows.select(["sid", "n", "y", "x"]).to_pylist()
        symbol = np.concatenate([unsqueezed(r["y"], r["n"]).view(np.int64) for r in parts])
        x = np.concatenate([spread(r["x"], (len(ids), r["n"])) for r in parts], axis=1)
        place, m = np.zeros(x.shape, np.uint64), (~np.isnan(x)).sum(axis=1)
        by = np.argsort(symbol)
        for i in range(len(ids)):
            first = by[np.argsort(x[i][by], kind="stable")[: m[i]]]  # missing ones come last
            place[i, first] = np.arange(1, m[i] + 1)
        edges = np.cumsum([0, *(r["n"] for r in parts)])
        return pa.Table.from_pylist([{"sid": r["sid"], "t": t, "ids": ids, "m": m.tolist(), "x": squeezed(2, place[:, a:b])} for r, a, b in zip(parts, edges, edges[1:], strict=False)], schema=out)

    return run


def _best(n_t: int, mkt: np.ndarray, trees: dict[str, X.Node], moments: dict[str, tuple], wanted: dict[str, dict[int, tuple[int, int]]]):
    """Every tree's best names of a task at its rebalance rows, with returns and masks until the next one; the first of them brings the number of present scores."""
    kinds = {"strategy": pa.string(), "t_idx": pa.int32(), "symbol": pa.int64(), "y": pa.float64(), "n": pa.int64(), "r": pa.list_(pa.float64()), "ok": pa.list_(pa.bool_())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, list]] = {name: {} for name in trees}
        for s in unpack(batches, n_t, mkt):
            for name, tree in trees.items():
                ranked, y = tree.op == "rank", score(tree, s, moments)
                for t, (k, rb) in wanted[name].items():
                    i = np.flatnonzero(~np.isnan(y[t]))
                    if not len(i):
                        continue
                    old, n = best[name].get(t), len(i)
                    if old is not None:
                        n += old[0]
                        if len(old[1]) == k:
                            i = i[y[t, i] >= old[2][-1]]
                        if not len(i):
                            old[0] = n
                            continue
                    new = (s.symbols[i], y[t, i], s["ret"][t : t + rb + 1, i].T, s["tradable"][t : t + rb + 1, i].T)
                    if old is not None:
                        new = tuple(np.concatenate(p) for p in zip(old[1:], new, strict=True))
                    first = np.lexsort((-new[0] if ranked else new[0], -new[1]))[:k]
                    best[name][t] = [n, *(p[first] for p in new)]
        for name, found in best.items():
            for t, (n, symbol, y, r, ok) in found.items():
                cols = ([name] * len(y), np.full(len(y), t, np.int32), symbol, y, [n] + [0] * (len(y) - 1), r.tolist(), ok.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return run


def score(tree: X.Node, s: Slab, moments: dict[str, tuple]) -> np.ndarray:
    """The rounded score of the tradable rows. A rank at the root is left to the session: here are the values that it ranks."""
    if tree.op == "rank":
        return key(masked(tree, s, moments), 9)
    x = np.where(s["tradable"], value(tree, s, moments), np.nan)
    return key(np.where(np.abs(x) <= 1e300, x, np.nan), 8)


def _scored(n_t: int, mkt: np.ndarray, blocks: list[dict[str, X.Node]], moments: dict[str, tuple], target: Callable):
    """Of every session and block of trees: the scores of a slab's usable rows, each tree's packed for itself, with symbols and the target."""
    kinds = {"t_idx": pa.int32(), "blk": pa.int32(), "n": pa.int32(), "sym": pa.binary(), "y": pa.binary(), "x": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in unpack(batches, n_t, mkt):
            with np.errstate(all="ignore"):
                y, ok = target(s)
            kind_y, code_y = coded(y)
            cols = [(t, c) for t, c in enumerate(map(np.flatnonzero, ok)) if len(c)]
            for k, trees in enumerate(blocks):
                x = [coded(score(tree, s, moments)) for tree in trees.values()]
                ranked = any(tree.op == "rank" for tree in trees.values())
                rows = [(t, k, len(c), squeezed(2, s.symbols[c].view(np.uint64)) if ranked else b"", squeezed(kind_y, code_y[t, c]), [squeezed(kind, code[t, c]) for kind, code in x]) for t, c in cols]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return run


def _correlated(blocks: list[dict[str, X.Node]], found: Callable):
    """All pieces of a session and block to the coefficients of its trees; what is ranked at the root has places without ties."""
    out = pa.schema([("id", pa.string()), ("t_idx", pa.int32()), ("ic", pa.float64()), ("n", pa.int64())])

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        t, trees = group[0].as_py(), blocks[group[1].as_py()]
        parts = rows.select(["n", "sym", "y", "x"]).to_pylist()
        y = np.concatenate([spread(r["y"], (r["n"],)) for r in parts])
        x = np.stack([np.concatenate([spread(r["x"][i], (r["n"],)) for r in parts]) for i in range(len(trees))])
        ranked = [i for i, tree in enumerate(trees.values()) if tree.op == "rank"]
        if ranked:
            symbol = np.concatenate([unsqueezed(r["sym"], r["n"]).view(np.int64) for r in parts])
        for i in ranked:
            first = np.lexsort((symbol, x[i]))[: int((~np.isnan(x[i])).sum())]  # missing ones come last
            x[i, first] = np.arange(len(first))
        got = [{"id": r["feature"], "t_idx": t, "ic": r["ic"], "n": r["n"]} for r in found(tuple(trees), x, y)]
        return pa.Table.from_pylist(got, schema=out)

    return run


def _known(s: Slabs, rows: DataFrame, nodes: list[X.Node], moments: dict[str, tuple]) -> dict[str, tuple]:
    """Mean and population deviation of every session for each of ``nodes``.

    Where all names are equal, what the mean's last bit leaves of them counts
    as much as in the SQL, so it is the mean of values added one by one.
    """
    part = cut(rows.mapInArrow(_moments(s.n_t, s.mkt, nodes, moments), "id string, t_idx int, n long, m double, d double, lo double, hi double"))
    whole = part.groupBy("id", "t_idx").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    dev = part.join(whole, ["id", "t_idx"]).groupBy("id", "t_idx").agg(F.first("mu").alias("mu"), F.sqrt(F.sum(F.col("d") + F.col("n") * (F.col("m") - F.col("mu")) ** 2) / F.first("all")).alias("sd"), F.first("all").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = {n.canonical(): (np.full(s.n_t, np.nan), np.full(s.n_t, np.nan)) for n in nodes}
    for r in dev.collect():
        even = r["lo"] == r["hi"]
        out[r["id"]][0][r["t_idx"]] = np.cumsum(np.full(r["n"], r["lo"]))[-1] / r["n"] if even else r["mu"]
        out[r["id"]][1][r["t_idx"]] = 0.0 if even else r["sd"]
    return out


def _ranked(s: Slabs, at: str, trees: dict[str, X.Node], last: str | None = None) -> tuple[DataFrame, dict[str, tuple]]:
    """The slabs with every rank that simplified ``trees`` read, and the moments of their other operators across names."""
    spark = s.rows.sparkSession
    rows = s.rows.withColumn("ranks", F.lit(None).cast(_RANKS))
    moments: dict[str, tuple] = {}
    for level, nodes in enumerate(crossings(trees)):
        if even := [n for n in nodes if n.op != "rank"]:
            moments |= _known(s, rows, even, moments)
        ranked = [n for n in nodes if n.op == "rank"]
        for i in range(0, len(ranked), BLOCK):
            pieces = rows.mapInArrow(_to_sessions(s.n_t, s.mkt, [ranked[i : i + BLOCK]], moments), "sid long, t_idx int, blk int, n int, y binary, x binary")
            back = pieces.groupBy("t_idx", "blk").applyInArrow(_ordinals([ranked[i : i + BLOCK]]), "sid long, t int, ids array<string>, m array<int>, x binary")
            back = back.groupBy("sid").agg(F.collect_list(F.struct("t", "ids", "m", "x")).alias("more"))
            on = rows.join(back, "sid", "left")
            on.withColumn("ranks", F.concat(F.coalesce("ranks", F.array().cast(_RANKS)), F.coalesce("more", F.array().cast(_RANKS)))).drop("more").write.parquet(f"{at}/ranks{level}-{i}")
            del pieces, back, on
            rows = spark.read.parquet(f"{at}/ranks{level}-{i}")
            tidy(spark)
            if last:
                drop(spark, last)
            last = f"{at}/ranks{level}-{i}"
    return rows, moments


def coefficients(s: Slabs, at: str, trees: dict[str, X.Node], horizon: int, least: int) -> DataFrame:
    """(id, t_idx, ic, n) of every tree and session that has a coefficient; files go under ``at``."""
    trees = {k: X.simplify(t) for k, t in trees.items()}
    rows, moments = _ranked(s, at, trees)
    blocks = [dict(list(trees.items())[i : i + BLOCK]) for i in range(0, len(trees), BLOCK)]
    pieces = rows.mapInArrow(_scored(s.n_t, s.mkt, blocks, moments, forward(horizon)), "t_idx int, blk int, n int, sym binary, y binary, x array<binary>")
    return pieces.groupBy("t_idx", "blk").applyInArrow(_correlated(blocks, coefficients_of(least)), "id string, t_idx int, ic double, n long")


def books(s: Slabs, at: str, trees: dict[str, X.Node], wanted: dict[str, dict[int, tuple[int, int]]], last: str | None = None) -> dict[str, DataFrame]:
    """What a population's books and days read: ``lng`` and ``rets`` of the names that can be picked, ``bench``, ``sessions``.

    ``wanted``: for every tree, session -> (names, sessions until the next rebalance row) at most. Files go under ``at``;
    slabs that were written again with their ranks go, those of ``s`` only if ``last`` names their path.
    """
    spark, trees = s.rows.sparkSession, {k: X.simplify(t) for k, t in trees.items()}
    rows, moments = _ranked(s, at, trees, last)
    found = rows.mapInArrow(_best(s.n_t, s.mkt, trees, moments, wanted), "strategy string, t_idx int, symbol long, y double, n long, r array<double>, ok array<boolean>")
    ranked = F.col("strategy").isin([k for k, t in trees.items() if t.op == "rank"])
    group = W.partitionBy("strategy", "t_idx")
    found = found.withColumn("rn", F.row_number().over(group.orderBy(F.col("y").desc(), F.when(ranked, -F.col("symbol")).otherwise(F.col("symbol"))))).withColumn("n", F.sum("n").over(group))
    most = spark.createDataFrame([(k, t, n) for k, v in wanted.items() for t, (n, _) in v.items()], "strategy string, t_idx int, k int")
    score = F.when(ranked, F.round((F.col("n") - F.col("rn")) / F.greatest(F.col("n") - 1, F.lit(1)), 8)).otherwise(F.col("y") / 1e8)
    best = cut(found.join(F.broadcast(most), ["strategy", "t_idx"]).filter("rn <= k").withColumn("score", score).select("strategy", "symbol", "t_idx", "score", "r", "ok"))
    tidy(spark)
    steps = best.selectExpr("symbol", "t_idx as t0", "posexplode(arrays_zip(r, ok)) as (i, z)")
    return {
        "lng": best.selectExpr("strategy", "symbol", "t_idx as t_src", "score"),
        "rets": cut(steps.selectExpr("symbol", "t0 + i as t_idx", "z.r as ret", "z.ok as tradable").distinct()),
        "bench": s.benchmark(),
        "sessions": s.sessions,
    }
