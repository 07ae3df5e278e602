"""Approximate nearest neighbours: low-dimensional stable projections in kd-trees.

Vectors are projected on a few Gaussian (2-stable) directions. For two vectors
at distance d the squared projected distance is d * d times a chi-square
variable, so neighbours are verified in the order of projected distance until
that of the next candidates is too large, at a set confidence, for any of them
to be nearer than the k-th neighbour found.

A shallow kd-tree, fitted on a bounded sample, splits the projected space into
leaves; every vector is indexed in its leaf. Each leaf is searched with a
kd-tree of its own. A query first visits its home leaf, then all leaves that
the same test does not rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut

from .common import shuffle_partitions, table

DIRECTIONS = 8
CONFIDENCE = 0.98
K = 10
#: Rows on which the upper tree is fitted; the index holds every row.
SAMPLE = 65_536
#: Most vectors of one searched shard; a fuller leaf is dealt to several.
SHARD = 16_384
BUCKET = 64
SEED = 29
#: A query stands for the rows whose id is divisible by this.
QUERY_STEP = 100


def chi2_quantile(p: float, m: int) -> float:
    """x with P(chi-square with an even number m of degrees <= x) = p."""

    def cdf(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int, m: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).normal(size=(dim, m))


class UpperTree:
    """Median splits of the sample; leaves are numbered from ``first``."""

    def __init__(self, points: np.ndarray, leaves: int, first: int) -> None:
        self.splits: list[tuple[int, float, int, int]] = []  # axis, cut, low node, high node (< 0: leaf)
        self.count, self.first = 0, first
        self.root = self._grow(points, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if leaves <= 1 or len(points) < 32 or spread.max() == 0:
            self.count += 1
            return -self.count
        axis = int(spread.argmax())
        cut = float(np.median(points[:, axis]))
        low = points[:, axis] <= cut
        if low.all():
            cut = float(points[low & (points[:, axis] < cut), axis].max(initial=points[:, axis].min()))
            low = points[:, axis] <= cut
        at = len(self.splits)
        self.splits.append((axis, cut, 0, 0))
        a, b = self._grow(points[low], leaves // 2), self._grow(points[~low], leaves - leaves // 2)
        self.splits[at] = (axis, cut, a, b)
        return at

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = self.first - node - 1
            else:
                axis, cut, a, b = self.splits[node]
                low = points[rows, axis] <= cut
                todo += [(a, rows[low]), (b, rows[~low])]
        return out


class Shard:
    """A kd-tree over the projections of one shard: buckets in a row, with their boxes."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> None:
        order, bounds = np.arange(len(ids)), []
        todo = [(0, len(ids))]
        while todo:
            a, z = todo.pop()
            if z - a <= BUCKET:
                bounds.append((a, z))
                continue
            part = points[order[a:z]]
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            mid = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, axis], mid, kind="introselect")]
            todo += [(a, a + mid), (a + mid, z)]
        bounds.sort()
        self.starts = np.array([a for a, _ in bounds])
        self.ids, self.rows, self.vectors, points = ids[order], own[order], vectors[order], points[order]
        self.ends = np.array([z for _, z in bounds])
        self.low = np.minimum.reduceat(points, self.starts, axis=0)
        self.high = np.maximum.reduceat(points, self.starts, axis=0)

    def search(self, me: int, q: np.ndarray, p: np.ndarray, k: int, limit: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest here (ids, distances) but row ``me``, given that k others lie within ``limit``."""
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        step, at = 4, 0
        while at < len(order):
            worst = min(limit, dist[k - 1] if len(dist) >= k else math.inf)
            if far[order[at]] > stop * worst * worst:
                break
            take = order[at : at + step]
            at, step = at + step, min(step * 2, 64)
            rows = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in take])
            rows = rows[self.rows[rows] != me]
            diff = self.vectors[rows] - q
            ids = np.concatenate([ids, self.ids[rows]])
            dist = np.concatenate([dist, np.sqrt((diff * diff).sum(axis=1))])
            best = np.lexsort((ids, dist))[:k]
            ids, dist = ids[best], dist[best]
        near = dist <= limit
        return ids[near], dist[near]


_ROW = "shard long, kind int, id long, row long, dim int, v binary, p binary, bound double"
_HIT = "query_row long, query_id long, vec_id long, score double"


def _search(rows: DataFrame, k: int, stop: float) -> DataFrame:
    """Vectors (kind 0) and queries (kind 1) of shards -> hits; one shard's vectors in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        held: list[tuple] = []
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, own, bound = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(7).to_numpy(zero_copy_only=False)
            v, p = b.column(5).to_pylist(), b.column(6).to_pylist()
            out: list[tuple] = []
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, len(shard)], strict=True):
                if a == z:
                    continue
                if shard[a] != now:
                    now, index, held = shard[a], None, []
                if kind[a] == 0:
                    held.append((ids[a:z], own[a:z], np.array([np.frombuffer(x) for x in v[a:z]]), np.array([np.frombuffer(x) for x in p[a:z]])))
                elif held or index:
                    if index is None:
                        index = Shard(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held = []
                    for i in range(a, z):
                        got, dist = index.search(int(own[i]), np.frombuffer(v[i]), np.frombuffer(p[i]), k, float(bound[i]), stop)
                        out += zip([int(own[i])] * len(got), [int(ids[i])] * len(got), got.tolist(), dist.tolist(), strict=True)
            cols = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, _HIT)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(~bad & some).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def nearest(vectors: DataFrame, is_query: Column | None = None, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without an id. Only vectors of the query's own
    length are compared. A row never finds itself; rows that repeat an id are
    candidates and queries each, so such an id has each of its ranks more than
    once. Ties go to the smaller id. Fewer than k candidates give all of them;
    empty input gives no rows; extra columns are dropped.
    """
    spark = vectors.sparkSession
    stop = chi2_quantile(confidence, DIRECTIONS)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases: dict[int, np.ndarray] = {}
        for b in batches:
            vs = [np.array(x, float) for x in b.column(1).to_pylist()]
            ps = []
            for x in vs:
                if len(x) not in bases:
                    bases[len(x)] = directions(len(x))
                ps.append((x @ bases[len(x)]).tobytes())
            cols = [b.column(0), pa.array([len(x) for x in vs], pa.int32()), pa.array([x.tobytes() for x in vs], pa.binary()), pa.array(ps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "dim", "v", "p"])

    placed = cut(usable(vectors).mapInArrow(project, "id long, dim int, v binary, p binary").withColumn("row", F.monotonically_increasing_id()))
    sample = placed.select("dim", "p", F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id", "v").select("dim", "p").limit(SAMPLE).collect()
    total = placed.count()
    trees: dict[int, UpperTree] = {}
    first = 1
    for dim in sorted({r["dim"] for r in sample}):
        points = np.array([np.frombuffer(r["p"]) for r in sample if r["dim"] == dim])
        share = math.ceil(total * len(points) / max(1, len(sample)) / (SHARD / 2))
        trees[dim] = UpperTree(points, max(1, share), first)
        first += trees[dim].count
    shared = spark.sparkContext.broadcast(trees)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, leaf = b.column(1).to_numpy(), np.zeros(b.num_rows, np.int64)
            ps = b.column(3).to_pylist()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) in shared.value:
                    leaf[rows] = shared.value[int(dim)].leaf(np.array([np.frombuffer(ps[i]) for i in rows]))
                else:  # a length that the sample did not meet: one leaf of its own
                    leaf[rows] = -dim
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["id", "dim", "v", "p", "row", "leaf"])

    leaved = cut(placed.mapInArrow(to_leaf, "id long, dim int, v binary, p binary, row long, leaf long"))

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[tuple[int, int], list] = {}
        for b in batches:
            leaf, dim = b.column(5).to_numpy(), b.column(1).to_numpy()
            points = np.array([np.frombuffer(x) for x in b.column(3).to_pylist()]).reshape(-1, DIRECTIONS)
            for key in set(zip(leaf.tolist(), dim.tolist(), strict=True)):
                here = points[(leaf == key[0]) & (dim == key[1])]
                lo, hi, n = boxes.get(key, (math.inf, -math.inf, 0))
                boxes[key] = (np.minimum(lo, here.min(axis=0)), np.maximum(hi, here.max(axis=0)), n + len(here))
        rows = [(a, d, n, lo.tolist(), hi.tolist()) for (a, d), (lo, hi, n) in boxes.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["leaf", "dim", "n", "lo", "hi"])

    per_part = leaved.mapInArrow(box, "leaf long, dim int, n long, lo array<double>, hi array<double>")
    ends = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(DIRECTIONS)]
    # One row per leaf: bounded by the sample.
    found = per_part.groupBy("leaf", "dim").agg(F.sum("n").alias("n"), *ends).collect()
    leaves: dict[int, dict] = {}
    number = 0
    for r in sorted(found, key=lambda r: (r["dim"], r["leaf"])):
        salts = math.ceil(r["n"] / SHARD)
        at = leaves.setdefault(r["dim"], {"leaf": [], "first": [], "salts": [], "lo": [], "hi": []})
        at["leaf"].append(r["leaf"])
        at["first"].append(number)
        at["salts"].append(salts)
        at["lo"].append([r[f"lo{i}"] for i in range(DIRECTIONS)])
        at["hi"].append([r[f"hi{i}"] for i in range(DIRECTIONS)])
        number += salts
    upper = {d: {c: np.array(x) for c, x in at.items()} for d, at in leaves.items()}
    dealt = {(d, int(a)): (int(f), int(s)) for d, at in upper.items() for a, f, s in zip(at["leaf"], at["first"], at["salts"], strict=True)}
    top = spark.sparkContext.broadcast((upper, dealt))

    def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dim, leaf, h in zip(b.column(1).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                at, salts = top.value[1][dim, leaf]
                out.append(at + h % salts)
            n = b.num_rows
            cols = [pa.array(out, pa.int64()), pa.array(np.zeros(n, np.int32)), b.column(0), b.column(4), b.column(1), b.column(2), b.column(3), pa.array(np.full(n, np.inf))]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "kind", "id", "row", "dim", "v", "p", "bound"])

    stored = leaved.withColumn("h", F.pmod(F.xxhash64("row"), F.lit(1 << 30))).mapInArrow(to_shard, _ROW)
    asks = (F.col("id") % QUERY_STEP == 0) if is_query is None else is_query
    asked = leaved.filter(asks)

    def visits(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                limits = [math.inf] * b.num_rows if home else b.column(6).to_pylist()
                for i, dim, v, p, row, leaf, limit in zip(*(b.column(c).to_pylist() for c in range(6)), limits, strict=True):
                    own, _ = top.value[1][dim, leaf]
                    if home:
                        out.append((own, 1, i, row, dim, v, p, limit))
                        continue
                    at = top.value[0][dim]
                    x = np.frombuffer(p)
                    gap = np.maximum(np.maximum(at["lo"] - x, x - at["hi"]), 0)
                    reach = np.flatnonzero((gap * gap).sum(axis=1) <= stop * limit * limit)
                    for j in reach:
                        for s in range(at["first"][j], at["first"][j] + at["salts"][j]):
                            if s != own:
                                out.append((int(s), 1, i, row, dim, v, p, limit))
                    if len(out) >= 5000:
                        yield rows(out)
                        out = []
                yield rows(out)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["shard", "kind", "id", "row", "dim", "v", "p", "bound"])

        return run

    asked = cut(asked)
    home = cut(_search(stored.union(asked.mapInArrow(visits(True), _ROW)), k, stop))
    reached = home.groupBy("query_row").agg(F.count("*").alias("n"), F.max("score").alias("m"))
    limit = F.when(F.col("n") >= k, F.col("m")).otherwise(F.lit(float("inf")))
    bounded = asked.join(reached, asked["row"] == reached["query_row"], "left").select("id", "dim", "v", "p", "row", "leaf", F.coalesce(limit, F.lit(float("inf"))).alias("bound"))
    rest = _search(stored.union(bounded.mapInArrow(visits(False), _ROW)), k, stop)
    order = W.partitionBy("query_row").orderBy("score", "vec_id")
    return home.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
