"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

A 64-bit fingerprint maps to the bit counts of 32 two-bit segments. One bit of
difference moves one count by at most one, so the Manhattan distance of two
embeddings bounds the Hamming distance from below. Two fingerprints within
four bits have a half (16 segments) whose counts are at Manhattan distance two
or less, hence a grid point at distance one or less from both. Every
fingerprint is therefore filed under its own point and the neighbouring points
of each half, and only rows of one grid cell are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

from .common import row_key, shuffle_partitions, table, whole_row
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A cell of more rows is verified block against block, in separate tasks.
BLOCK = 8192
_SMALL = 48


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits over the hashes of all word shingles of ``text`` (0: no word)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    buf = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest = xxhash.xxh64_intdigest
    starts, ends = begin[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    h = np.array([digest(buf[a:z], seed) for a, z in zip(starts, ends, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, key (of the row), fp (signed 64-bit) of whole texts; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("key"), F.col("text").cast("binary"))
    return slim.mapInArrow(run, "doc_id long, key binary, fp long")


def grid_points(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all grid points that the fingerprints are filed under.

    A cell is the half's number in bit 63 and 16 counts of 0 to 2 in base 4.
    """
    rows, cells = [], []
    n = np.arange(len(fps))
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        odd = np.uint64(0x55555555)
        point = (x & odd) + ((x >> np.uint64(1)) & odd)
        tag = np.uint64(half << 63)
        rows.append(n)
        cells.append(point | tag)
        for seg in range(16):
            one = np.uint64(1 << (2 * seg))
            count = (point >> np.uint64(2 * seg)) & np.uint64(3)
            for ok, moved in ((count < 2, point + one), (count > 0, point - one)):
                rows.append(n[ok])
                cells.append(moved[ok] | tag)
    return np.concatenate(rows), np.concatenate(cells).view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (root, member) that join all of ``fps`` that are connected within ``radius``.

    Each reached row is compared only with rows not reached yet, so a dense
    group costs little more than its size.
    """
    links, rest = [], np.sort(fps)
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            hit = _near(rest, front.pop(), radius)
            if hit.any():
                new = rest[hit]
                links += [(int(root), int(x)) for x in new]
                front += list(new)
                rest = rest[~hit]
    return links


def _cells(radius: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, fp) sorted by cell -> links inside cells, and the rows of over-full cells by block."""

    def out(links: list, over: list) -> pa.RecordBatch:
        u = np.array([x[0] for x in links], np.uint64).view(np.int64)
        v = np.array([x[1] for x in links], np.uint64).view(np.int64)
        n, m = len(links), sum(len(f) for _, _, f in over)
        cell = np.concatenate([np.zeros(n, np.int64), *(np.full(len(f), c, np.int64) for c, _, f in over)])
        blk = np.concatenate([np.full(n, -1, np.int64), *(np.full(len(f), k, np.int64) for _, k, f in over)])
        u = np.concatenate([u, *(f.view(np.int64) for _, _, f in over)])
        v = np.concatenate([v, np.zeros(m, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(blk), pa.array(u), pa.array(v)], names=["cell", "block", "u", "v"])

    def verify(cell: np.ndarray, fp: np.ndarray, links: list) -> None:
        """All whole cells of these rows, sorted by cell."""
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]])
        size = ends - starts
        for i in np.flatnonzero(size > _SMALL):
            links += forest(fp[starts[i] : ends[i]], radius)
        small = np.repeat(size <= _SMALL, size)
        for d in range(1, min(_SMALL, int(size.max(initial=0)))):
            same = (cell[d:] == cell[:-d]) & small[d:]
            if not same.any():
                break
            a, b = fp[:-d][same], fp[d:][same]
            hit = _near(a, b, radius)
            links += list(zip(a[hit].tolist(), b[hit].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        open_cell, blocks = None, 0  # a cell of which full blocks have been given out already
        for b in batches:
            links: list = []
            over: list = []
            cell = np.concatenate([cell, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            if open_cell is not None:
                n = int(np.searchsorted(cell != open_cell, True)) if len(cell) else 0
                while n >= block or (n and n < len(cell)):
                    k = min(n, block)
                    links += forest(fp[:k], radius)
                    over.append((open_cell, blocks, fp[:k]))
                    blocks, cell, fp, n = blocks + 1, cell[k:], fp[k:], n - k
                if n == 0 and len(cell):
                    open_cell = None
            if open_cell is None and len(cell):
                last = int(np.argmax(cell == cell[-1]))
                head, hfp = cell[:last], fp[:last]
                if len(head):
                    size = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1, [len(head)]]))
                    big = np.repeat(size > block, size)
                    if big.any():
                        for c in np.unique(head[big]):
                            f = hfp[head == c]
                            for k in range(0, len(f), block):
                                links += forest(f[k : k + block], radius)
                                over.append((c, k // block, f[k : k + block]))
                    verify(head[~big], hfp[~big], links)
                cell, fp = cell[last:], fp[last:]
                if len(cell) >= block:
                    open_cell, blocks = cell[0], 0
                    links += forest(fp[:block], radius)
                    over.append((open_cell, blocks, fp[:block]))
                    blocks, cell, fp = 1, cell[block:], fp[block:]
            if links or over:
                yield out(list(set(links)), over)
        if len(cell):
            if open_cell is None:
                links = []
                verify(cell, fp, links)
                yield out(list(set(links)), [])
            else:
                yield out(forest(fp, radius), [(open_cell, blocks, fp)])

    return run


def _block_pairs(radius: int) -> Callable:
    """One pair of blocks of an over-full cell -> links between them."""

    def run(t: pa.Table) -> pa.Table:
        fp, side = t.column("u").to_numpy().view(np.uint64), t.column("side").to_numpy()
        links = forest(fp, radius) if len(np.unique(side)) > 1 else []
        u = np.array([x[0] for x in links], np.uint64).view(np.int64)
        v = np.array([x[1] for x in links], np.uint64).view(np.int64)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct ``fp`` -> links (u, v) that connect all fingerprints within ``radius`` bits."""
    if not 0 <= radius <= 4:
        raise ValueError("the grid serves radii of at most 4 bits")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 20_000):
                part = fp[i : i + 20_000]
                rows, cells = grid_points(part)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part[rows].view(np.int64))], names=["cell", "fp"])

    n = shuffle_partitions(fps.sparkSession)
    filed = fps.select("fp").mapInArrow(file, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell")
    found = cut(filed.mapInArrow(_cells(radius, block), "cell long, block long, u long, v long"))
    inside = found.filter("block < 0").select("u", "v")
    over = found.filter("block >= 0")
    sizes = over.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    # Block k meets every other block of its cell once, in the task of that pair.
    pairs = over.join(sizes, "cell").filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("other <> block")
    pairs = pairs.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("block").alias("side"), "u")
    across = pairs.groupBy("cell", "lo", "hi").applyInArrow(_block_pairs(radius), "u long, v long")
    return inside.union(across)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints are linked by steps of ``radius`` bits or less
    share a component, named by its smallest doc_id. Null, empty and blank
    texts have fingerprint zero and are linked like any other. Rows with equal
    ids stay separate; a null id keeps its row but never names a component
    unless all are null. Empty input gives no rows; extra columns are dropped.
    """
    marks = cut(fingerprints(docs, shingle, seed))
    groups = _groups(marks, radius).select("fp", F.col("first.doc_id").alias("component_id"))
    return marks.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _groups(marks: DataFrame, radius: int) -> DataFrame:
    """fp -> ``first``, the row (doc_id, key) with the smallest id of its component."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    # Exact copies collapse here, before anything is compared.
    distinct = cut(marks.groupBy("fp").agg(F.min(row).alias("first")))
    roots = cut(components(links(distinct, radius)))
    named = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(first, "root").select("fp", "first")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate component, all columns unchanged.

    Null, empty and blank texts are near each other. Of rows with equal ids the
    one with the smallest key stays (see ``row_key``), of rows equal in every
    column one. An empty table stays empty; rows without an id stay only where
    their whole component has none.
    """
    groups = _groups(cut(fingerprints(docs, shingle, seed)), radius)
    stay = groups.select(F.col("first.key").alias("__key")).distinct()
    keyed = docs.select(whole_row(docs), row_key(docs).alias("__key"))
    return keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select("__row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
