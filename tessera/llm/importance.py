"""Importance resampling towards a target distribution of hashed word n-grams.

Long texts are split into overlapping chunks: a chunk ends at a word boundary, carries the next
n - 1 words, and owns the n-grams that start before its end. Chunks of long texts are dealt to all
tasks, so that no task has a whole one to work through; their counts and gains are summed again by
document. Every text is hashed once; bucket counts are gathered per task before they are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, scratch

from .common import running_total, shuffle_partitions, table
from .merkle import crc32_sql

#: Longest n-gram, hash buckets, seed of the draw, percent drawn, words that a drawn document needs.
NGRAM, BUCKETS, SEED, PERCENT, LEAST_WORDS = 2, 10_000, 7, 25, 20
#: Characters that a chunk owns, about; the end is moved to the end of a word.
CHUNK = 20_000
#: Letters, digits, and all beyond ASCII, once A-Z are lower-case.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def chunks(text: bytes, size: int = CHUNK, carry: int = NGRAM - 1) -> Iterator[tuple[bytes, int]]:
    """(piece, bytes of it that it owns) in order; owned parts tile the text, and none ends inside a word."""
    at = 0
    while len(text) - at > size:
        rest = WORD.match(text, at + size)
        # A word that reaches over the edge is owned whole, be it ever so long.
        end = rest.end() if rest else at + size
        stop = end
        for m in _first(WORD.finditer(text, end), carry):
            stop = m.end()
        yield text[at:stop], end - at
        at = end
    yield text[at:], len(text) - at


def _first(it: Iterator, n: int) -> Iterator:
    for _, x in zip(range(n), it, strict=False):
        yield x


def buckets(piece: bytes, own: int, ngram: int = NGRAM, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words owned, bucket of every n-gram that starts in the owned part)."""
    found = [(m.start(), m.group()) for m in WORD.finditer(piece)]
    mine = sum(s < own for s, _ in found)
    words = [w for _, w in found]
    spaced = [b" " + w for w in words]
    crc = [zlib.crc32(w) for w in words]
    out = [np.array(crc[:mine], np.uint32)]
    for n in range(1, ngram):
        # The checksum of a run goes on from that of the run without its last word.
        crc = [zlib.crc32(w, c) for c, w in zip(crc, spaced[n:], strict=False)]
        out.append(np.array(crc[:mine], np.uint32))
    return mine, (np.concatenate(out) % n_buckets).astype(_ids(n_buckets))


def _ids(n_buckets: int) -> type:
    """The smallest type that holds a bucket's number."""
    return np.uint16 if n_buckets <= 1 << 16 else np.uint32


def hashed(texts: DataFrame, keys: str, size: int = CHUNK, ngram: int = NGRAM, n_buckets: int = BUCKETS) -> DataFrame:
    """Rows (the columns of ``keys``, a DDL, then text as binary) -> one row a chunk: keys, n_words, the packed ids of its buckets."""
    names = [k.split()[0] for k in keys.split(", ")]
    out = [*names, "n_words", "ids"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for i, t in enumerate(b.column("text").to_pylist()):
                got = list(chunks(t.translate(_UPPER), size, ngram - 1))
                row = b.select(names).take(pa.array([i] * len(got)))
                cols = [pa.array(range(len(got)), pa.int64()), pa.array([p for p, _ in got], pa.binary()), pa.array([o for _, o in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*row.columns, *cols], names=[*names, "chunk", "piece", "own"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            got = [buckets(p, o, ngram, n_buckets) for p, o in zip(b.column("piece").to_pylist(), b.column("own").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array([w for w, _ in got], pa.int64()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            got = [buckets((t or b"").translate(_UPPER), size + 1, ngram, n_buckets) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array([w for w, _ in got], pa.int64()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=out)

    long, schema = F.octet_length("text") > size, f"{keys}, n_words long, ids binary"
    dealt = texts.filter(long).mapInArrow(split, f"{keys}, chunk long, piece binary, own long").repartition(shuffle_partitions(texts.sparkSession), *names, "chunk")
    return texts.filter(~F.coalesce(long, F.lit(False))).mapInArrow(whole, schema).union(dealt.mapInArrow(count, schema))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what Python makes of them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def bucket_counts(parts: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, c) of all rows; every task adds its own up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in _slices(batches):
            for ids in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, _ids(n_buckets)), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "c"])

    return parts.select("ids").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, in thousandths: log of its smoothed share in the target over that in the source."""
    spark = source.sparkSession
    s, t = cut(source.withColumnRenamed("c", "s")), cut(target.withColumnRenamed("c", "t"))
    all_s, all_t = (float(df.agg(F.sum(c)).first()[0] or 0) for df, c in ((s, "s"), (t, "t")))
    every = spark.range(n_buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    ratio = ((F.col("t") + 1.0) * (all_s + n_buckets)) / ((F.col("s") + 1.0) * (all_t + n_buckets))
    rows = every.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("g")).collect()
    out = [0] * n_buckets
    for r in rows:
        out[r["bucket"]] = r["g"]
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, size: int = CHUNK, ngram: int = NGRAM, n_buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; ``target`` has a column ``text``.

    A null, empty or wordless text has no features and weight 0. Rows are told
    apart by themselves, so that repeated ids and rows count each; among equal
    scores and ids any order serves. A null id has a null score and is drawn
    last. An empty table of documents gives no rows, an empty target equal
    shares. Extra columns are dropped.
    """
    spark = docs.sparkSession
    with scratch(spark, "importance") as at:
        mine = docs.select(F.monotonically_increasing_id().alias("nth"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
        hashed(mine.withColumn("long", F.coalesce(F.octet_length("text") > size, F.lit(False))).select("long", "nth", "doc_id", "text"), "long boolean, nth long, doc_id long", size, ngram, n_buckets).write.parquet(f"{at}/docs")
        parts = spark.read.parquet(f"{at}/docs")
        goal = hashed(target.select(F.lit(0).cast("long").alias("one"), F.col("text").cast("binary").alias("text")), "one long", size, ngram, n_buckets)
        gain = np.array(gains(bucket_counts(parts, n_buckets), bucket_counts(goal, n_buckets), n_buckets), np.int64)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                ids = [np.frombuffer(x, _ids(n_buckets)) for x in b.column("ids").to_pylist()]
                cols = [b.column(k) for k in ("long", "nth", "doc_id", "n_words")]
                cols += [pa.array([len(x) for x in ids], pa.int64()), pa.array([int(gain[x].sum()) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["long", "nth", "doc_id", "n_words", "n_features", "gain"])

        each = parts.mapInArrow(weigh, "long boolean, nth long, doc_id long, n_words long, n_features long, gain long")
        summed = each.groupBy("long", "nth").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
        scored = cut(
            summed.withColumn("weight", F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")).select(
                "doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))).alias("score")
            )
        )
    fit = scored.filter(F.col("n_words") >= least_words)
    n = percent * fit.count() // 100
    ranked = running_total(fit, [F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last()], F.lit(1).cast("long"), "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank").union(rest.select("doc_id", "n_features", "weight", "score", "rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    """The same draw in DuckDB SQL; every distinct n-gram is hashed once."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = " || ".join(f"list_transform(range(1, len(ws) - {n - 2}), lambda i: {' || chr(32) || '.join(f'ws[i + {k}]' for k in range(n))})" for n in range(1, NGRAM + 1))
    return f"""
with d as materialized (select row_number() over () as id, doc_id, regexp_extract_all(coalesce({low}, ''), '{word}') as ws from documents),
b as materialized (select regexp_extract_all(coalesce({low}, ''), '{word}') as ws from benchmark),
df as materialized (select id, unnest({runs}) as f from d),
bf as materialized (select unnest({runs}) as f from b),
hx as materialized (select f, hex(encode(f)) as x from (select f from df union select f from bf)),
hb as materialized (select f, ({crc32_sql('x')} % {BUCKETS})::bigint as bucket from hx),
s as (select bucket, count(*) as s from df join hb using (f) group by bucket),
t as (select bucket, count(*) as t from bf join hb using (f) group by bucket),
g as materialized (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from df) + {BUCKETS})::double) / ((s + 1)::double * ((select count(*) from bf) + {BUCKETS})::double)))::bigint as gain from s left join t using (bucket)),
w as (select id, count(*) as n, sum(gain) as gain from df join hb using (f) join g using (bucket) group by id),
sc as (select d.id, doc_id, len(ws) as n_words, coalesce(w.n, 0)::bigint as n_features, coalesce(floor(w.gain::double / w.n), 0)::bigint as weight, ('0x' || substr(sha256('{SEED}:' || doc_id::varchar), 1, 8))::bigint::double as h from d left join w using (id)),
x as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))))::bigint as score from sc),
r as (select id, row_number() over (order by score desc, doc_id) as k, count(*) over () as n from x where n_words >= {LEAST_WORDS})
select x.doc_id, n_features, weight, score, case when k <= {PERCENT} * r.n // 100 then k end::bigint as rank from x left join r using (id)"""


ORACLE_OP13 = _oracle()
