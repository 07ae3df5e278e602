"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries whatever the number of documents: bins of one pattern are
planned together with their multiplicity. Documents are then dealt to the
planned places by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut

from .common import per_worker, table

CAPACITY = 1024
EOS = 2
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as merge ranks; used for all texts without a special token.
RANKS = "byte_bpe_50k.tiktoken"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def _slow(tokenizer: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokenizer))


def _fast(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def _encoder(tokenizer: str, ranks: str, specials: tuple[str, ...]):
    """text -> ids, as the ``tokenizers`` file gives them.

    Both libraries hold the same merges and give the same ids for ordinary
    text; a text with a special token's string goes to ``tokenizers`` itself.
    """
    fast = per_worker(("ranks", ranks), lambda: _fast(ranks))

    def encode(text: str) -> list[int]:
        if any(s in text for s in specials):
            return per_worker(("tokenizer", tokenizer), lambda: _slow(tokenizer)).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int, eos: int, tokenizer: str, ranks: str) -> DataFrame:
    """Tokenise, cut and count: one row per piece, with its rank in (part, length)."""

    specials = tuple(t.content for t in _slow(tokenizer).get_added_tokens_decoder().values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer, ranks, specials)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*(encode(text) if text else ()), eos], dtype="<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((doc_id, k, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for ``counts[length]`` pieces: rows (length, first rank, last rank, first bin, offset), and the bins used.

    Pieces above a third of the capacity fit at most twice in a bin. They are
    matched greedily: the longest takes the longest that still fits beside it.
    Shorter pieces, longest first, then go to the smallest gap that holds them.
    """
    left = {k: v for k, v in counts.items() if v}
    rank: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first bin, bins)]
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        places.append((length, rank[length], rank[length] + n - 1, first, offset))
        rank[length] += n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left.get(a):
            b = next((b for b in large if b <= capacity - a and left.get(b) and (b != a or left[a] > 1)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, bins, 0)
            left[a] -= n
            room = capacity - a
            if b is not None:
                put(b, n, bins, a)
                left[b] -= n
                room -= b
            gaps[room].append((bins, n))
            bins += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            room = next((g for g in range(s, capacity + 1) if gaps.get(g)), None)
            if room is None:
                per = capacity // s
                if left[s] < per:
                    gaps[capacity].append((bins, 1))
                    bins += 1
                else:
                    n = left[s] // per
                    for j in range(per):
                        put(s, n, bins, j * s)
                    gaps[capacity - per * s].append((bins, n))
                    bins += n
                    left[s] -= n * per
                continue
            first, n = gaps[room].pop()
            if n > left[s]:
                gaps[room].append((first + left[s], n - left[s]))
                n = left[s]
            put(s, n, first, capacity - room)
            left[s] -= n
            gaps[room - s].append((first, n))
    return places, bins


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    eos: int = EOS,
    tokenizer: str = TOKENIZER,
    ranks: str = RANKS,
) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and place.

    Null text counts as empty: a document of the end token alone. Repeated ids
    are packed each on their own; a null id stays null. Empty input gives no
    rows. Extra columns are dropped.
    """
    cuts = cut(pieces(docs, capacity, eos, tokenizer, ranks))
    by_part = cut(cuts.groupBy("length", "part").agg(F.count("*").alias("n")))
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = plan(counts, capacity)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cuts.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    by_length: dict[int, np.ndarray] = {}
    for length in counts:
        by_length[length] = np.array(sorted(p[1:] for p in places if p[0] == length), dtype=np.int64)
    # Its size depends on the capacity alone, not on the documents.
    shared = docs.sparkSession.sparkContext.broadcast(by_length)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, at = np.flatnonzero(length == n), shared.value[int(n)]
                k = np.searchsorted(at[:, 0], rank[rows], side="right") - 1
                seq[rows], off[rows] = at[k, 2] + rank[rows] - at[k, 0], at[k, 3]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
