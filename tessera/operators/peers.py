"""The most correlated others of every name, and a name against their averages.

Correlations come tile by tile: blocks of standardised histories meet in a nested loop over
partitions, which reads its right side anew and writes no copies of it, and a name keeps its best
candidates while it meets the others. Only those travel. Averages over peers are formed where all
names of some sessions meet, from their values and the lists of peers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, tidy

from .slabs import EPS, JUDGED, Slab, Slabs, at_least, change, deviation, forward_of_all, judged, key, squeezed, unsqueezed, _unpack

#: Names of a block, and blocks of a right partition.
TILE, WIDE = 2048, 32
#: Doubles of one column that a task holds for its sessions, and its sessions at most.
VALUES, LONGEST = 1 << 22, 32
#: Candidates whose correlations are formed anew at once.
AT_ONCE = 1 << 15
_BLOCK = pa.schema([("blk", pa.int32()), ("bid", pa.int64()), ("n", pa.int32()), ("symbols", pa.binary()), ("x", pa.binary())])
_FOUND = pa.schema([("blk", pa.int32()), ("symbol", pa.int64()), ("peers", pa.list_(pa.int64())), ("rho", pa.list_(pa.float64()))])
_PIECE = pa.schema([("blk", pa.int32()), ("piece", pa.int32()), ("n", pa.int32()), ("symbols", pa.binary()), ("x", pa.binary()), ("peers", pa.binary())])
FEATURES = ("peer_rel_mom_5", "peer_rel_mom_21", "peer_rel_mom_63", "peer_rel_vol", "peer_rank_mom_21", "peer_dispersion", "peer_beta", "peer_corr", "peer_rel_range")
#: What the features average.
VALUED: tuple[Callable[[Slab], np.ndarray], ...] = (
    *(lambda p, w=w: change(p["close"], w) for w in (5, 21, 63)),
    lambda p: deviation(p["r1"], 21),
    lambda p: (p["high"] - p["low"]) / at_least(p["close"]),
)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _raw(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x, dtype=np.float64).tobytes(), asbytes=True)


def _doubles(b: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(b, decompressed_size=8 * rows * columns, asbytes=True), np.float64).reshape(rows, columns)


# ---- tiles ----------------------------------------------------------------------


def _block(blk: int, symbols: np.ndarray, r: np.ndarray, least: int) -> dict:
    """A block of histories (names x sessions, missing as NaN), each of mean 0 and size 1; those with too few values are all zero."""
    order = np.argsort(symbols)
    symbols, r = symbols[order], r[order]
    n = (~np.isnan(r)).sum(axis=1)
    x = np.nan_to_num(r, nan=0.0)
    x = x - x.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1))
    x *= np.where((n >= least) & (size > 1e-12), 1 / np.where(size > 0, size, 1), 0)[:, None]
    return {"blk": blk, "bid": int(symbols[0]), "n": len(symbols), "symbols": symbols.astype("<i8").tobytes(), "x": _raw(x)}


def _of_rows(least: int, tile: int):
    """Rows (blk, symbol, r) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list]]] = {}

        def block(blk: int) -> pa.RecordBatch:
            rows = held.pop(blk)
            return pa.RecordBatch.from_pylist([_block(blk, np.array([s for s, _ in rows]), np.array([r for _, r in rows], float).reshape(len(rows), -1), least)], schema=_BLOCK)

        for b in batches:
            for row in b.to_pylist():
                held.setdefault(row["blk"], []).append((row["symbol"], row["r"]))
                if len(held[row["blk"]]) == tile:
                    yield block(row["blk"])
        for blk in list(held):
            yield block(blk)

    return run


def _of_slabs(n_t: int, spans: dict[int, tuple[int, int]], least: int, tile: int):
    """Slabs to blocks, one for each of the ``spans`` of sessions."""

    def blocks(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        symbols, r = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        for i in range(0, len(symbols), tile):
            for blk, (t0, t1) in spans.items():
                yield pa.RecordBatch.from_pylist([_block(blk, symbols[i : i + tile], r[i : i + tile, t0:t1], least)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for s in _unpack(batches, n_t):
            if n + len(s.symbols) > tile and held:
                yield from blocks(held)
                held, n = [], 0
            held.append((s.symbols, s["r1"].T))
            n += len(s.symbols)
        if held:
            yield from blocks(held)

    return run


class _Best:
    """The best candidates so far of one block's names."""

    def __init__(self, blk: int, symbols: np.ndarray, x: np.ndarray, m: int) -> None:
        self.blk, self.symbols, self.x, self.m = blk, symbols, x, m
        self.short, self.live = x.astype(np.float32), x.any(axis=1)
        self.rho = np.full((len(x), m), -np.inf)
        self.peer = np.full((len(x), m), np.iinfo(np.int64).max)

    def meet(self, symbols: np.ndarray, y: np.ndarray) -> None:
        """Candidates by single precision, with its error to spare; what counts is formed in double precision."""
        m, slack = self.m, (y.shape[1] + 8) * 2.0**-22
        s = self.short @ y.astype(np.float32).T
        # A name without a history is 0 to all, and ties go to the smaller symbol.
        s[:, np.flatnonzero(~y.any(axis=1))[m + 1 :]] = -np.inf
        s[~self.live, m + 1 :] = -np.inf
        at = np.minimum(np.searchsorted(symbols, self.symbols), len(symbols) - 1)
        same = np.flatnonzero(symbols[at] == self.symbols)
        s[same, at[same]] = -np.inf
        least = self.rho[:, -1].copy()
        if np.isneginf(least).any() and s.shape[1] > m:
            least = np.maximum(least, np.partition(s, -m, axis=1)[:, -m] - slack)
        i, j = np.nonzero(s >= np.maximum(least - slack, -2).astype(np.float32)[:, None])
        if not len(i):
            return
        rho = np.concatenate([np.einsum("ij,ij->i", self.x[i[k : k + AT_ONCE]], y[j[k : k + AT_ONCE]]) for k in range(0, len(i), AT_ONCE)])
        rows = np.unique(i)
        i = np.concatenate([i, np.repeat(rows, m)])
        rho = np.concatenate([np.round(rho, 9) + 0.0, self.rho[rows].ravel()])
        peer = np.concatenate([symbols[j], self.peer[rows].ravel()])
        order = np.lexsort((peer, -rho, i))
        i, rho, peer = i[order], rho[order], peer[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        take = first[:, None] + np.arange(m)
        self.rho[rows], self.peer[rows] = rho[take], peer[take]

    def found(self) -> pa.RecordBatch:
        there = self.rho > -np.inf
        ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[there])) for v in (self.peer, self.rho)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), self.blk, np.int32)), pa.array(self.symbols), *lists], schema=_FOUND)


def _met(m: int, width: int):
    """Pairs of blocks, the left ones in runs, to candidates."""

    def opened(n: int, symbols: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(symbols, "<i8"), _doubles(x, n, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {f: b.column(f)[r] for f in b.schema.names}
                if now != (at := (row["blk"].as_py(), row["bid"].as_py())):
                    if best is not None:
                        yield best.found()
                    now, best = at, _Best(at[0], *opened(row["n"].as_py(), row["symbols"].as_py(), row["x"].as_py()), m)
                best.meet(*opened(row["n2"].as_py(), row["symbols2"].as_py(), row["x2"].as_py()))
        if best is not None:
            yield best.found()

    return run


def _lists(blocks: DataFrame, width: int, m: int) -> DataFrame:
    """Blocks to (blk, symbol, peers), best first."""
    n = blocks.count()
    right = blocks.coalesce(max(1, -(-n // WIDE))).select("blk", *[F.col(c).alias(f"{c}2") for c in ("n", "symbols", "x")])
    pairs = blocks.join(right.hint("shuffle_replicate_nl"), "blk")
    found = pairs.select("blk", "bid", "n", "symbols", "x", "n2", "symbols2", "x2").mapInArrow(_met(m, width), _ddl(_FOUND))
    every = found.select("blk", "symbol", F.transform(F.arrays_zip("rho", "peers"), lambda s: F.struct((-s["rho"]).alias("d"), s["peers"].alias("peer"))).alias("c"))
    best = every.groupBy("blk", "symbol").agg(F.slice(F.sort_array(F.flatten(F.collect_list("c"))), 1, m).alias("c"))
    return best.select("blk", "symbol", F.col("c.peer").alias("peers"))


def top_peers(history: DataFrame, m: int, least: int, tile: int = TILE) -> DataFrame:
    """(blk, symbol, t_idx, r1) on a dense calendar -> (blk, symbol, peer), the ``m`` most correlated others.

    Ties go to the smaller symbol; a name never is its own peer.
    """
    vectors = history.groupBy("blk", "symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("t_idx", "r1"))), lambda s: s["r1"]).alias("r"))
    width = history.select("t_idx").distinct().count()
    same = history.groupBy("blk").agg(F.countDistinct("t_idx").alias("w")).select(F.min("w")).first()[0]
    if same not in (None, width):
        raise ValueError("all blocks need equally many sessions")
    blocks = cut(vectors.mapInArrow(_of_rows(least, tile), _ddl(_BLOCK)))
    return _lists(blocks, width, m).select("blk", "symbol", F.explode("peers").alias("peer"))


# ---- a name against its peers ---------------------------------------------------


def _dealt(n_t: int, pieces: list[tuple[int, int, int]], values: Callable[[Slab], list[np.ndarray]]):
    """Slabs to pieces of sessions; ``pieces`` are (blk, first session, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _unpack(batches, n_t):
            with np.errstate(all="ignore"):
                x = values(s)
            symbols = s.symbols.astype("<i8").tobytes()
            yield pa.RecordBatch.from_pylist([{"blk": k, "piece": i, "n": len(s.symbols), "symbols": symbols, "x": _raw(np.concatenate([v[t0:t1] for v in x]))} for i, (k, t0, t1) in enumerate(pieces)], schema=_PIECE)

    return run


def _listed(pieces: list[tuple[int, int, int]], m: int, more: tuple[str, ...]):
    """Lists of peers to the pieces of their block, with the columns ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blk, symbols = (b.column(c).to_numpy() for c in ("blk", "symbol"))
            lists = b.column("peers")
            size = np.diff(lists.offsets.to_numpy())
            peers = np.full((len(blk), m), 0, np.int64)
            peers[np.arange(m) < size[:, None]] = lists.flatten().to_numpy()
            extra = np.array([b.column(c).to_numpy(zero_copy_only=False) for c in more]).reshape(len(more), b.num_rows)
            for k in np.unique(blk):
                of = blk == k
                row = {"blk": int(k), "n": int(of.sum()), "symbols": symbols[of].astype("<i8").tobytes(), "x": _raw(np.vstack([size[of], extra[:, of]])), "peers": squeezed(0, ((peers[of] << 1) ^ (peers[of] >> 63)).astype(np.uint64))}
                yield pa.RecordBatch.from_pylist([{**row, "piece": i} for i, (at, _, _) in enumerate(pieces) if at == k], schema=_PIECE)

    return run


class Piece:
    """All names of some sessions with their peers. Arrays of names are in the order of ``symbols``; peers are places among them, -1 past a list's end."""

    def __init__(self, rows: pa.Table, sessions: int, columns: int, more: int, m: int) -> None:
        parts = rows.select(["n", "symbols", "x", "peers"]).to_pylist()
        slabs, lists = [r for r in parts if r["peers"] is None], [r for r in parts if r["peers"] is not None]
        every = np.concatenate([np.frombuffer(r["symbols"], "<i8") for r in slabs])
        order = np.argsort(every)
        self.symbols, place = every[order], np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.x = np.empty((columns, len(every), sessions))
        at = 0
        for r in slabs:
            self.x[:, place[at : at + r["n"]]] = _doubles(r["x"], columns * sessions, r["n"]).reshape(columns, sessions, r["n"]).transpose(0, 2, 1)
            at += r["n"]
        self.peers = np.full((m, len(every)), -1, np.int32)
        self.more = np.full((more, len(every)), np.nan)
        for r in lists:
            own = np.searchsorted(self.symbols, np.frombuffer(r["symbols"], "<i8"))
            z = unsqueezed(r["peers"], r["n"] * m).astype(np.int64)
            ids = ((z >> 1) ^ -(z & 1)).reshape(r["n"], m)
            got = _doubles(r["x"], 1 + more, r["n"])
            self.peers[:, own] = np.where(np.arange(m) < got[0][:, None], np.searchsorted(self.symbols, ids), -1).T
            self.more[:, own] = got[1:]
        self.size = (self.peers >= 0).sum(axis=0)

    def of_peers(self, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The names that have a peer at each place, and that peer's values."""
        for row in self.peers:
            has = np.flatnonzero(row >= 0)
            yield has, self.x[column, row[has]]

    def mean(self, column: int) -> np.ndarray:
        """Of the peers' present values; missing without any."""
        total, n = np.zeros_like(self.x[column]), np.zeros(self.x[column].shape, np.int16)
        for has, v in self.of_peers(column):
            there = ~np.isnan(v)
            total[has] += np.where(there, v, 0)
            n[has] += there
        return np.where(n > 0, total / np.maximum(n, 1), np.nan)

    def spread(self, column: int) -> np.ndarray:
        """Population deviation of the peers' present values."""
        m = self.mean(column)
        total, n = np.zeros_like(m), np.zeros(m.shape, np.int16)
        for has, v in self.of_peers(column):
            there = ~np.isnan(v)
            total[has] += np.where(there, (v - m[has]) ** 2, 0)
            n[has] += there
        return np.where(n > 0, np.sqrt(total / np.maximum(n, 1)), np.nan)

    def below(self, column: int) -> np.ndarray:
        """Share of all peers that lie strictly below the name; a missing value lies below nothing, and nothing below it."""
        out = np.zeros_like(self.x[column])
        for has, v in self.of_peers(column):
            out[has] += v < self.x[column, has]
        return out / np.maximum(self.size, 1)[:, None]

    def features(self) -> dict[str, np.ndarray]:
        """Name -> names x sessions, from the columns ``VALUED`` and the two of ``more``."""
        x, flat = self.x, np.ones(self.x.shape[-1])
        with np.errstate(all="ignore"):
            return {
                **{f"peer_rel_mom_{w}": x[i] - self.mean(i) for i, w in enumerate((5, 21, 63))},
                "peer_rel_vol": x[3] / at_least(self.mean(3)) - 1,
                "peer_rank_mom_21": self.below(1),
                "peer_dispersion": self.spread(1),
                "peer_beta": self.more[0][:, None] * flat,
                "peer_corr": self.more[1][:, None] * flat,
                "peer_rel_range": x[4] - self.mean(4),
            }


MOMENTS = ("n_o", "n_g", "n_b", "s_o", "s_g", "s_oo", "s_gg", "s_ob", "s_gb", "s_og")


def _moments(pieces: list[tuple[int, int, int]], m: int, schema: pa.Schema):
    """Numbers and sums of a name's returns (o) and its peers' mean (g): of each, of each where both are there (b), and of products."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        blk, (_, t0, t1) = group[0].as_py(), pieces[group[1].as_py()]
        p = Piece(rows, t1 - t0, 1, 0, m)
        o, g = p.x[0], p.mean(0)
        has_o, has_g = ~np.isnan(o), ~np.isnan(g)
        both, o, g = has_o & has_g, np.nan_to_num(o, nan=0.0), np.nan_to_num(g, nan=0.0)
        sums = [v.sum(axis=1).astype(float)[p.size > 0] for v in (has_o, has_g, both, o, g, o * o, g * g, o * both, g * both, o * g)]
        symbols = p.symbols[p.size > 0]
        return pa.Table.from_arrays([pa.array(np.full(len(symbols), blk, np.int32)), pa.array(symbols), *map(pa.array, sums)], schema=schema)

    return run


class Peers:
    """Peers of all names for every block of ``refresh`` sessions, from the ``lookback`` sessions before it."""

    def __init__(self, slabs: Slabs, m: int, lookback: int, refresh: int, least: int) -> None:
        self.slabs, self.m = slabs, m
        n_t, spark = slabs.n_t, slabs.rows.sparkSession
        names = slabs.rows.agg(F.sum("n")).first()[0] or 0
        self.step = max(1, min(LONGEST, VALUES // max(names, 1)))
        self.blocks = {k: (refresh * k + lookback, min(refresh * (k + 1) + lookback, n_t)) for k in range(max(0, -(-(n_t - lookback) // refresh)))}
        spans = {k: (t0 - lookback, t0) for k, (t0, _) in self.blocks.items()}
        rows = slabs.rows.coalesce(max(1, names // (2 * TILE)))
        self.lists = cut(_lists(cut(rows.mapInArrow(_of_slabs(n_t, spans, least, TILE), _ddl(_BLOCK))), lookback, m))
        tidy(spark)
        self._against(spans)
        tidy(spark)

    def pieces(self, spans: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
        return [(k, t, min(t + self.step, t1)) for k, (t0, t1) in spans.items() for t in range(t0, t1, self.step)]

    def dealt(self, pieces: list[tuple[int, int, int]], values: Callable[[Slab], list[np.ndarray]], more: tuple[str, ...] = ()) -> DataFrame:
        """Values and lists of every piece, to be grouped by it."""
        at = _ddl(_PIECE)
        own = self.slabs.rows.mapInArrow(_dealt(self.slabs.n_t, pieces, values), at)
        return own.unionByName(self.lists.select("blk", "symbol", "peers", *more).mapInArrow(_listed(pieces, self.m, more), at))

    def _against(self, spans: dict[int, tuple[int, int]]) -> None:
        """Every name's beta and correlation to its peers before the block, beside its list."""
        pieces = self.pieces(spans)
        schema = pa.schema([("blk", pa.int32()), ("symbol", pa.int64()), *((n, pa.float64()) for n in MOMENTS)])
        sums = self.dealt(pieces, lambda s: [s["r1"]]).groupBy("blk", "piece").applyInArrow(_moments(pieces, self.m, schema), _ddl(schema)).groupBy("blk", "symbol").agg(*[F.sum(n).alias(n) for n in MOMENTS])
        mean = sums.selectExpr("*", "s_o / nullif(n_o, 0) as mo", "s_g / nullif(n_g, 0) as mg")
        var = mean.selectExpr("blk", "symbol", "(s_og - mg * s_ob - mo * s_gb + n_b * mo * mg) / nullif(n_b, 0) as og", "greatest(s_gg / nullif(n_g, 0) - mg * mg, 0e0) as gg", "greatest(s_oo / nullif(n_o, 0) - mo * mo, 0e0) as oo")
        own = var.selectExpr("blk", "symbol", f"case when gg is not null then og / greatest(gg, {EPS}) end as peer_beta", f"case when gg is not null and oo is not null then og / greatest(sqrt(gg * oo), {EPS}) end as peer_corr")
        self.lists = cut(self.lists.join(own, ["blk", "symbol"]))

    def features(self) -> DataFrame:
        """(symbol, t_idx, one column a feature) of every session that has a block."""
        pieces = self.pieces(self.blocks)
        schema = pa.schema([("symbol", pa.int64()), ("t_idx", pa.int32()), *((n, pa.float64()) for n in FEATURES)])
        parts = cut(self.dealt(pieces, lambda s: [f(s) for f in VALUED], ("peer_beta", "peer_corr")))
        return parts.groupBy("blk", "piece").applyInArrow(_featured(pieces, self.m, schema), _ddl(schema))

    def judged(self, horizon: int, least: int, flat: float) -> DataFrame:
        """The features' coefficients as ``JUDGED`` has them, formed where all names of a session are."""
        pieces, target = self.pieces(self.blocks), forward_of_all(horizon)
        parts = self.dealt(pieces, lambda s: [*(f(s) for f in VALUED), *(v.astype(float) for v in target(s))], ("peer_beta", "peer_corr"))
        return parts.groupBy("blk", "piece").applyInArrow(_judged(pieces, self.m, judged(least, flat)), JUDGED)


def _judged(pieces: list[tuple[int, int, int]], m: int, found: Callable):
    schema = pa.schema([("feature", pa.string()), ("t_idx", pa.int32()), ("ic", pa.float64()), ("n", pa.int64()), ("flat", pa.float64())])

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        _, t0, t1 = pieces[group[1].as_py()]
        p = Piece(rows, t1 - t0, len(VALUED) + 2, 2, m)
        x, (y, ok) = p.features(), p.x[len(VALUED) :]
        got = []
        for i, t in enumerate(range(t0, t1)):
            of = (p.size > 0) & (ok[:, i] > 0)
            got += [{"t_idx": t, **r} for r in found(FEATURES, np.stack([key(x[n][of, i], 8) for n in FEATURES]), y[of, i])]
        return pa.Table.from_pylist([{f: r.get(f) for f in schema.names} for r in got], schema=schema)

    return run


def _featured(pieces: list[tuple[int, int, int]], m: int, schema: pa.Schema):
    def run(group: tuple, rows: pa.Table) -> pa.Table:
        _, t0, t1 = pieces[group[1].as_py()]
        p = Piece(rows, t1 - t0, len(VALUED), 2, m)
        has, x = p.size > 0, p.features()
        t = np.tile(np.arange(t0, t1, dtype=np.int32), int(has.sum()))
        return pa.Table.from_arrays([pa.array(np.repeat(p.symbols[has], t1 - t0)), pa.array(t), *[pa.array(x[n][has].ravel(), from_pandas=True) for n in FEATURES]], schema=schema)

    return run
