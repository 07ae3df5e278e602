"""Exact substring dedup: bytes covered by a string of 200 that starts twice or more.

Every window of 200 bytes is filed under its anchor, the k-gram of the window
with the smallest hash (the leftmost of equals); neighbouring windows of one
anchor travel as one segment of text. Equal windows have equal anchors, so
only anchors that occur twice matter. Where all segments of an anchor are the
same, every window of them is repeated and no text needs to travel. The others
are compared in shards: a shard's suffix array is refined in the manner of
Larsson and Sadakane, common prefixes of its neighbours come from Kasai's pass,
and windows of one class are neighbours with a common prefix of 200 or more.

The segments of one anchor meet in one shard, unless the anchor is frequent.
Those are dealt to blocks, each with its own suffix array. What a block finds
twice is settled there; its sorted windows are then merged with those of the
other blocks, range by range, by binary search.

Digests are keyed anew in every run, so no text can be made to collide.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, scratch

from .common import shuffle_partitions, table

SPAN = 200
GRAM = 32
#: Bytes of segments in one suffix array, about.
SHARD = 1 << 20
#: An anchor met more often is frequent; the text of any other fits a shard.
FREQUENT = 2048
#: An anchor met more than FREQUENT * SPREAD ** k times is dealt to SPREAD ** (k + 1) blocks.
SPREAD = 4
#: Windows merged in one range, about.
RANGE = 1 << 19
#: Windows hashed at once; positions inside take the low bits of a hash.
_CHUNK = 1 << 17
_LOW = np.uint64((1 << 18) - 1)
#: Below the k-th of these, the first 7 - k of eight bytes are zero.
_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
#: A filter of anchors has 8 bits for each, within these bounds.
_BITS = (20, 30)


def anchors(text: np.ndarray, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of windows: (anchor hash, first window, last window) of each run of windows with one anchor."""
    if gram & (gram - 1):
        raise ValueError("gram must be a power of two")
    wide = span - gram + 1
    for base in range(0, max(0, len(text) - span + 1), _CHUNK):
        h = text[base : base + _CHUNK + span - 1].astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        s = 1
        while s < gram:
            h = h[:-s] * np.uint64(0xBF58476D1CE4E5B9) + h[s:]
            h ^= h >> np.uint64(31)
            s *= 2
        h *= np.uint64(0x94D049BB133111EB)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        d = 1
        while 2 * d <= wide:
            low = np.minimum(low[:-d], low[d:])
            d *= 2
        if wide > d:
            low = np.minimum(low[: d - wide], low[wide - d :])
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(low) - 1]])
        yield (low[first] >> np.uint64(18)).view(np.int64), first + base, last + base


def _eights(text: np.ndarray) -> np.ndarray:
    """The next eight bytes at every place (zero-padded), the first one highest."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, a prefix before what it begins.

    Larsson-Sadakane refinement: groups of suffixes with a common prefix of
    length h are split by the ranks at distance h, which doubles; groups of one
    are never touched again.
    """
    n = len(text)
    key = _eights(text)
    # The zero padding must not tie with real zero bytes: shorter suffixes first.
    order = np.lexsort((np.minimum(n - np.arange(n), 8), key)) if (text == 0).any() else np.argsort(key)
    left = np.minimum(n - order, 8)
    key = key[order]
    head = np.ones(n + 1, bool)
    head[1:n] = (key[1:] != key[:-1]) | (left[1:] != left[:-1])
    group = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    h = 8
    while True:
        slots = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(slots):
            return order
        pos = order[slots]
        ahead = pos + h
        mixed = group[slots] * (n + 2) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        o = np.argsort(mixed)
        pos, mixed = pos[o], mixed[o]
        order[slots] = pos
        fresh = np.ones(len(slots), bool)
        fresh[1:] = mixed[1:] != mixed[:-1]
        head[slots] = fresh
        start = np.maximum.accumulate(np.where(fresh, slots, 0))
        group[slots] = start
        rank[pos] = start
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it, at most ``cap``.

    Kasai's pass: the places are walked in text order, and one step to the
    right shortens the common prefix by one at most. The text is walked in many
    lanes at once; a lane pays for its first prefix and then gains the same way.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    # Past the end nothing is equal: the room left bounds every prefix.
    key = np.concatenate([_eights(text), np.zeros(2 * cap + 16, np.uint64)])
    out = np.zeros(n, np.int64)
    step = max(32, int(n**0.5) // 8)
    words = np.arange(0, cap + 8, 8)
    at = np.arange(0, n, step)
    known = np.zeros(len(at), np.int64)
    for _ in range(step):
        i = at if at[-1] < n else at[:-1]
        j = before[i]
        room = np.where(j >= 0, np.minimum(n - np.maximum(i, j), cap), 0)
        got = np.minimum(np.maximum(known[: len(i)] - 1, 0), room)
        live = np.flatnonzero(got < room)
        # One word first, which is enough for most; then all that the cap leaves.
        for wide in (words[:1], words):
            a = got[live]
            x = key[(i[live] + a)[:, None] + wide] ^ key[(j[live] + a)[:, None] + wide]
            off = (x != 0).argmax(axis=1)
            x = x[np.arange(len(live)), off]
            same = np.where(x == 0, 8 * len(wide), 8 * off + (x[:, None] < _BYTES).sum(axis=1))
            a = np.minimum(a + same, room[live])
            got[live] = a
            live = live[(x == 0) & (a < room[live])]
        out[i] = got
        known[: len(i)] = got
        at = at + 1
    return out[order]


def classes(segments: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place in it, class) of all windows in suffix order; equal windows share a class."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum([len(s) for s in segments])
    owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
    order = suffix_array(text)
    kind = np.cumsum(common_prefixes(text, order, span) < span)
    valid = order + span <= ends[owner[order]]
    order, kind = order[valid], kind[valid]
    seg = owner[order]
    return seg, order - (ends[seg] - np.array([len(s) for s in segments])[seg]), kind


def _runs(places: np.ndarray) -> list[int]:
    """First and last of the runs of neighbours in ascending places, one after the other."""
    edge = np.flatnonzero(np.diff(places) != 1)
    return np.column_stack([places[np.concatenate([[0], edge + 1])], places[np.concatenate([edge, [len(places) - 1]])]]).ravel().tolist()


def repeated(segments: list[bytes], times: list[int], span: int = SPAN) -> list[list[int]]:
    """For each distinct segment, the runs (first, last, first, ...) of windows whose string occurs twice or more."""
    seg, place, kind = classes(segments, span)
    seen = np.bincount(kind, weights=np.array(times)[seg])
    hit = seen[kind] > 1
    seg, place = seg[hit], place[hit]
    o = np.lexsort((place, seg))
    seg, place = seg[o], place[o]
    cuts = np.searchsorted(seg, np.arange(len(segments) + 1))
    return [_runs(place[a:z]) if z > a else [] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Sorted distinct keys of blocks with their counts -> for each block, whether a key occurs twice or more in all.

    Two merged blocks at a time: the places of one block's keys in the other
    are found by binary search.
    """
    todo = [r for r in runs if len(r[0])]
    while len(todo) > 1:
        joined = []
        for (a, m), (b, n) in zip(todo[::2], todo[1::2], strict=False):
            at = np.searchsorted(a, b)
            same = at < len(a)
            same[same] = a[at[same]] == b[same]
            m = m.copy()
            m[at[same]] += n[same]
            joined.append((np.insert(a, at[~same], b[~same]), np.insert(m, at[~same], n[~same])))
        todo = joined + ([todo[-1]] if len(todo) % 2 else [])
    if not todo:
        return [np.zeros(0, bool) for _ in runs]
    every, total = todo[0]
    return [total[np.searchsorted(every, k)] > 1 if len(k) else np.zeros(0, bool) for k, _ in runs]


_FLAGGED = "h long, d long, spans array<int>, range int, keys binary, counts binary, refs binary"
_NAMES = ["h", "d", "spans", "range", "keys", "counts", "refs"]
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
#: A window of a block: its key's place among the block's keys of one range, its segment and its place in that.
_REF = np.dtype([("key", "<i4"), ("h", "<i8"), ("d", "<i8"), ("at", "<i4")])


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _spread(block: list[tuple], span: int, secret: bytes, ranges: int) -> Iterator[tuple]:
    """A block's windows: (h, d, spans) of what occurs twice in it, then by range of their digests (range, sorted distinct keys, counts, refs), packed.

    All keys go to the merge, but only windows that occur once here go with them.
    """
    seg, place, kind = classes([r[3] for r in block], span)
    times = np.array([r[2] for r in block])
    kind = np.cumsum(np.concatenate([[0], np.diff(kind) != 0]))
    twice = np.bincount(kind, weights=times[seg])[kind] > 1
    o = np.lexsort((place[twice], seg[twice]))
    here, at = seg[twice][o], place[twice][o]
    cuts = np.searchsorted(here, np.arange(len(block) + 1))
    for (h, d, _, _), a, z in zip(block, cuts[:-1], cuts[1:], strict=True):
        if z > a:
            yield h, d, _runs(at[a:z]), None, None, None, None
    lead = np.flatnonzero(np.concatenate([[True], np.diff(kind) != 0]))
    keys = np.array([hashlib.blake2b(block[s][3][p : p + span], digest_size=16, key=secret).digest() for s, p in zip(seg[lead].tolist(), place[lead].tolist(), strict=True)], "S16")
    by = np.argsort(keys)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    keys, kind = keys[by], rank[kind]
    counts = np.bincount(kind, weights=times[seg], minlength=len(keys)).astype(np.int64)
    high = np.frombuffer(keys.tobytes(), ">u4")[::4].astype(np.int64)
    part = (high * ranges) >> 32
    seg, place, kind = seg[~twice], place[~twice], kind[~twice]
    refs = np.empty(len(kind), _REF)
    refs["key"], refs["at"] = kind, place
    refs["h"], refs["d"] = np.array([r[0] for r in block])[seg], np.array([r[1] for r in block])[seg]
    refs = refs[np.argsort(kind, kind="stable")]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    cut_refs = np.searchsorted(refs["key"], edge)
    for a, z, x, y in zip(edge[:-1], edge[1:], cut_refs[:-1], cut_refs[1:], strict=True):
        mine = refs[x:y].copy()
        mine["key"] -= a
        yield None, None, None, int(part[a]), keys[a:z].tobytes(), counts[a:z].tobytes(), mine.tobytes()


def _resolver(shard: int, span: int, secret: bytes, ranges: int):
    """Distinct segments (route, often, h, d, n, seg) in order of route -> (h, d, spans), and of frequent anchors windows by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []  # the segments of one route
        pool: list[tuple] = []  # whole anchors
        now, size, pooled = None, 0, 0

        def solve() -> None:
            nonlocal pooled
            if pool:
                got = repeated([r[3] for r in pool], [r[2] for r in pool], span)
                out.extend((h, d, spans, None, None, None, None) for (h, d, _, _), spans in zip(pool, got, strict=True) if spans)
            pool.clear()
            pooled = 0

        def close(often: int) -> None:
            nonlocal size, pooled
            if often and group:
                out.extend(_spread(group, span, secret, ranges))
            elif group:
                pool.extend(group)
                pooled += size
                if pooled >= shard:
                    solve()
            group.clear()
            size = 0

        frequent = 0
        for b in batches:
            for route, often, h, d, n, seg in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if route != now or (often and size > shard):
                    close(frequent)
                    now, frequent = route, often
                group.append((h, d, n, seg))
                size += len(seg)
            if len(out) > 2000:
                yield _batch(out, _NAMES, _TYPES)
                out.clear()
        close(frequent)
        solve()
        yield _batch(out, _NAMES, _TYPES)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' windows in order of range -> (h, d, spans) of those that occur twice or more in all."""

    def solve(blocks: list[tuple]) -> list[tuple]:
        runs = [(np.frombuffer(k, "S16"), np.frombuffer(c, np.int64)) for k, c, _ in blocks]
        refs = [np.frombuffer(r, _REF) for _, _, r in blocks]
        hits = np.concatenate([r[twice[r["key"]]] for r, twice in zip(refs, merge(runs), strict=True)] or [np.zeros(0, _REF)])
        hits = hits[np.lexsort((hits["at"], hits["d"], hits["h"]))]
        fresh = np.flatnonzero((np.diff(hits["h"]) != 0) | (np.diff(hits["d"]) != 0)) + 1
        return [(int(p["h"][0]), int(p["d"][0]), _runs(np.unique(p["at"]))) for p in np.split(hits, fresh) if len(p)]

    now, blocks = None, []
    for b in batches:
        for r, *block in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if r != now and blocks:
                yield _batch(solve(blocks), _NAMES[:3], _TYPES[:3])
                blocks = []
            now = r
            blocks.append(tuple(block))
    yield _batch(solve(blocks) if blocks else [], _NAMES[:3], _TYPES[:3])


def _filter(places: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit set of the hashes ``h``; its size is bounded, and false hits only cost time."""
    bits = min(_BITS[1], max(_BITS[0], int(8 * max(1, n)).bit_length()))
    chunk_bits = max(13, bits - 7)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            chunk, rest = at >> chunk_bits, at & ((1 << chunk_bits) - 1)
            for c in np.unique(chunk):
                part = parts.setdefault(int(c), np.zeros(1 << chunk_bits, bool))
                part[rest[chunk == c]] = True
        for c, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    at = F.col("h").bitwiseAND((1 << bits) - 1)
    placed = places.select(at.alias("at")).repartitionByRange(min(128, shuffle_partitions(places.sparkSession)), "at")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (chunk_bits - 3)
    for r in placed.mapInArrow(fill, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return out, bits


def _inside(filled: tuple[np.ndarray, int], h: np.ndarray) -> np.ndarray:
    known, bits = filled
    at = h & ((1 << bits) - 1)
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard: int = SHARD, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null text counts as empty. Texts shorter than ``span`` lose nothing. Equal
    texts of that length or more lose everything. Repeated rows are documents
    of their own. Empty input gives no rows; extra columns are dropped.
    """
    return _resolve(docs, span, gram, shard, frequent, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _digest(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    sha, upto = hashlib.sha256(), 0
    for a, z in spans:
        sha.update(text[upto:a])
        upto = z
    sha.update(text[upto:])
    return len(text), sum(z - a for a, z in spans), len(spans), sha.hexdigest()


def _resolve(docs: DataFrame, span: int, gram: int, shard: int, frequent: int, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    secret = uuid.uuid4().bytes
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    owner = F.unhex(F.md5(F.concat(F.lit(secret), F.col("text"))))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text")).withColumn("owner", owner)
    copies = cut(keyed.filter(F.length("text") >= span).groupBy("owner").agg(F.count("*").alias("c")).filter("c > 1").select("owner"))

    def digest(segment: bytes) -> bytes:
        return hashlib.blake2b(segment, digest_size=8, key=secret).digest()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ds = [], []
            for text in b.column(0).to_pylist():
                for h, first, last in anchors(np.frombuffer(text, np.uint8), span, gram):
                    hs.append(h)
                    ds += [digest(text[a:z]) for a, z in zip(first.tolist(), (last + span).tolist(), strict=True)]
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.frombuffer(b"".join(ds), np.int64))], names=["h", "d"])

    met_often = keyed.select("text").mapInArrow(heads, "h long, d long").groupBy("h").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.max("d").alias("e")).filter("n > 1")
    counted = cut(met_often.select("h", "n", "d", (F.col("d") != F.col("e")).alias("mixed")))
    often = (F.col("n") > frequent) & F.col("mixed")
    n = counted.agg(F.count("*").alias("all"), F.count_if("mixed").alias("mixed"), F.max(F.when(often, F.col("n"))).alias("most"), F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)).alias("times")).first()
    filters = [_filter(counted, n["all"]), _filter(counted.filter("mixed"), n["mixed"])]
    least = frequent
    while (n["most"] or 0) > least:  # one small filter for each power of SPREAD
        level = counted.filter("mixed").filter(F.col("n") > least)
        filters.append(_filter(level, level.count()))
        least *= SPREAD
    shared = spark.sparkContext.broadcast(filters)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: where an owner has a segment, and (owner null) how often this task met one whose text is needed, with that."""
        repeats, mixes, *levels = shared.value
        met: dict[tuple, list] = {}
        out: list[tuple] = []
        names = ["h", "d", "owner", "starts", "length", "often", "n", "seg"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

        def total() -> None:
            out.extend((h, d, None, None, None, x, k, seg) for (h, d), (x, k, seg) in met.items())
            met.clear()

        for b in batches:
            for text, owner in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine: dict[tuple, tuple[int, list]] = {}
                for h, first, last in anchors(np.frombuffer(text, np.uint8), span, gram):
                    hit = _inside(repeats, h)
                    h, first, last = h[hit], first[hit], last[hit]
                    needed, level = _inside(mixes, h), np.zeros(len(h), np.int32)
                    for f in levels:
                        level += _inside(f, h)
                    for x, a, z, need, o in zip(h.tolist(), first.tolist(), (last + span).tolist(), needed.tolist(), level.tolist(), strict=True):
                        seg = text[a:z]
                        k = (x, int.from_bytes(digest(seg), "little", signed=True))
                        mine.setdefault(k, (z - a, []))[1].append(a)
                        if need:
                            met.setdefault(k, [o, 0, seg])[1] += 1
                out.extend((h, d, owner, starts, length, None, None, None) for (h, d), (length, starts) in mine.items())
                if len(met) > 30_000:
                    total()
                if len(out) > 5_000:
                    yield _batch(out, names, types)
                    out.clear()
        total()
        yield _batch(out, names, types)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for text, copied, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = unpack.decompress(text) if text else b""
                cover: list[tuple[int, int]] = [(0, len(text))] if copied else []
                if not copied:
                    raw = []
                    for f in found or ():
                        ends = f["spans"] or [0, f["length"] - span]
                        raw += [(s + ends[i], s + ends[i + 1] + span) for s in f["starts"] for i in range(0, len(ends), 2)]
                    for a, z in sorted(raw):
                        if cover and a <= cover[-1][1]:
                            cover[-1] = (cover[-1][0], max(z, cover[-1][1]))
                        else:
                            cover.append((a, z))
                rows.append(finish(text, cover))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t) if t else b"" for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["doc_id", "text", "owner"])

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    with scratch(spark, "segments") as at:
        found = "h long, d long, owner binary, starts array<int>, length int, often int, n long, seg binary"
        keyed.select("text", "owner").mapInArrow(segments, found).write.parquet(at)
        stored = spark.read.parquet(at)
        # The segments of an anchor meet in one task, those of a frequent one in many.
        block = F.pmod("d", F.pow(F.lit(SPREAD), "often").cast("long"))
        route = F.when(F.col("often") > 0, F.xxhash64("h", block)).otherwise(F.col("h"))
        met = stored.filter("owner is null").select(route.alias("route"), "often", "h", "d", "n", "seg").repartition(n_parts, "route")
        # Each task has counted its own, so a row per task and segment travels and is added up without a further shuffle.
        distinct = met.groupBy("route", "often", "h", "d").agg(F.sum("n").alias("n"), F.max("seg").alias("seg"))
        ordered = distinct.sortWithinPartitions("often", "route")
        ranges = -(-int(n["times"]) * (span - gram + 1) // 2 // RANGE) or 1
        solved = cut(ordered.mapInArrow(_resolver(shard, span, secret, ranges), _FLAGGED))
        parts = solved.filter("range is not null").select("range", "keys", "counts", "refs")
        across = parts.repartition(n_parts, "range").sortWithinPartitions("range").mapInArrow(_merged, "h long, d long, spans array<int>")
        uniform = counted.filter("not mixed").select("h", "d", F.lit(None).cast("array<int>").alias("spans"))
        flagged = solved.filter("range is null").select("h", "d", "spans").union(across).union(uniform)
        single = stored.filter("owner is not null").select("h", "d", "owner", "starts", "length").join(copies, "owner", "left_anti")
        spans = single.join(flagged, ["h", "d"]).groupBy("owner").agg(F.collect_list(F.struct("starts", "length", "spans")).alias("found"))
        marks = spans.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True)
        packed = keyed.select("doc_id", "text", "owner").mapInArrow(squeeze, "doc_id long, text binary, owner binary")
        joined = packed.join(marks, "owner", "left").select("doc_id", "text", "copied", "found")
        return cut(joined.mapInArrow(close, f"doc_id long, {schema}"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
