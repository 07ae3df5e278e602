"""N-gram Jaccard join by PartEnum signatures.

Two sets whose smaller one has a members and whose Jaccard similarity is t or more differ in
k = a (1 - t) / t members at most. Sets are filed in bands of size. For a band, the domain of
members is split by hash into first-level partitions, and each of those into parts; a signature is
a first-level partition without one of its parts. With k // 2 + 1 first-level partitions, one holds
no more than one of the k differences, and leaves it out with the part that it lies in: the two
sets share that signature. x first-level partitions more give x + 1 shared signatures, so that every
set may leave out its x thinnest ones (by one order for all sets), which many strangers share.

Sets that share a signature meet its first few members; what that settles is joined into
components, and a signature of few sets is done with. In one of many, sets of different components
then meet each other where size and histogram leave a chance. Every pair that may be linked is
verified on the whole texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, drop, scratch, tidy

from .common import row_key, shuffle_partitions, table
from .components import components

SHINGLE = 4
#: Percent of the union that the intersection must have at least.
PERCENT = 85
#: Growth of the bands of size, and from which k on a first-level partition has two parts in place of three.
GROWTH, COARSE = 1.35, 33
#: Texts of a signature that all its others meet first.
LEADS = 4
#: Passes over the signatures, which bound what their shuffle holds on disk at once.
PASSES = 3
#: Rows that a task may hold to filter texts by; more of them are joined by a shuffle.
HELD = 500_000
#: Rows of one signature that are compared at once; more of them are compared block by block.
BLOCK = 1024
#: Fewest and most buckets of a histogram, which has one for each two members up to that.
BUCKETS = 32, 32_768
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``n`` words (of all words, where they are fewer), each mixed from its words' hashes in order."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = mixed(out) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out)) if n else h


def most_apart(size: int, percent: int = PERCENT) -> int:
    """Members that two similar sets differ in at most, where the smaller one has ``size``."""
    return size * (100 - percent) // percent


class Bands:
    """Bands of set sizes, and how each splits the domain."""

    def __init__(self, percent: int = PERCENT, growth: float = GROWTH, coarse: int = COARSE) -> None:
        if not 50 < percent <= 100:
            raise ValueError("similarities above one half only")
        self.percent, self.growth, self.coarse, self.starts = percent, growth, coarse, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.growth)))
        return bisect_right(self.starts, size) - 1

    def layout(self, band: int) -> tuple[int, int, int]:
        """(first-level partitions, parts of each, signatures that a set leaves out)."""
        k = most_apart(self.starts[band + 1] - 1, self.percent)
        if k == 0:
            return 1, 1, 0
        spare = max(1, k // 8)
        return k // 2 + 1 + spare, 2 if k >= self.coarse else 3, spare

    def signatures(self, members: np.ndarray) -> np.ndarray:
        """All signatures of a set, in the bands of every size that a similar smaller set may have."""
        n = len(members)
        if not n:
            return np.zeros(0, np.uint64)
        top = self.of(n)
        low = self.of(-(-n * self.percent // 100))
        return np.concatenate([self._band(members, b) for b in range(low, top + 1)])

    def _band(self, members: np.ndarray, band: int) -> np.ndarray:
        first, parts, spare = self.layout(band)
        salt = mixed(np.array([band + 1], np.uint64))
        if first == 1:
            return mixed(members.sum(keepdims=True, dtype=np.uint64) ^ salt)
        home = (mixed(members ^ salt) % np.uint64(first * parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(first * parts + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(members[order]), dtype=np.uint64)])
        part = (sums[edges[1:]] - sums[edges[:-1]]).reshape(first, parts)
        count = np.diff(edges).reshape(first, parts)
        # One part left out of each partition.
        rest, left = part.sum(axis=1, keepdims=True, dtype=np.uint64) - part, count.sum(axis=1, keepdims=True) - count
        place = mixed(np.arange(first * parts, dtype=np.uint64) + (salt << np.uint64(1)))
        sig = mixed(rest.ravel() ^ place)
        return sig[np.lexsort((sig, left.ravel()))[spare:]]


def histogram(members: np.ndarray) -> np.ndarray:
    """Counts of the members by hash, to 255 each, in a power of two of buckets; half as many add up neighbours in halves."""
    n = BUCKETS[0]
    while n < min(BUCKETS[1], len(members) // 2):
        n *= 2
    return np.minimum(np.bincount((members & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8)


def text_id(text: Column) -> Column:
    """16 bytes of a text, A-Z in lower case."""
    return F.unhex(F.md5(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")))


def filed(docs: DataFrame, shingle: int, bands: tuple) -> DataFrame:
    """sid, n (size of its set) and sigs of every text; of the copies of a text that one task reads, the first alone is filed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, seen = Bands(*bands), set()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, got = b.slice(i, 512), []
                for sid, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if sid not in seen:
                        seen.add(sid)
                        members = shingles(t or b"", shingle)
                        got.append((sid, len(members), how.signatures(members).view(np.int64)))
                if got:
                    ids, n, sigs = zip(*got, strict=True)
                    edges = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(edges, np.concatenate(sigs))], names=["sid", "n", "sigs"])

    return docs.select(text_id(F.col("text")).alias("sid"), F.col("text").cast("binary")).mapInArrow(run, "sid binary, n long, sigs array<long>")


def those_of(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``df`` joined with ``ids``, which has every ``on`` once: held in each task while it is small, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= HELD else ids, on)


def shared(rows: DataFrame) -> DataFrame:
    """(sig, sid) -> (sig, sid, place, leads): the rows of signatures that two or more texts have, each once, numbered from 0, with the first few texts before them.

    Rows come sorted by signature and text, and are passed on one by one, so a
    signature of any number of texts takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, sid, place, leads = None, None, 0, []
        for b in batches:
            out: list = []
            # Nearly all rows are alone; a batch's ends may have company in the next one.
            same = np.diff(b.column(0).to_numpy()) == 0
            some = b.filter(pa.array(np.concatenate([[True], same]) | np.concatenate([same, [True]]))) if b.num_rows else b
            for s, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                if s != sig:
                    sig, place, leads = s, 0, [x]
                elif x != sid:
                    if place == 0:
                        out.append((sig, sid, 0, []))
                    place += 1
                    out.append((sig, x, place, list(leads)))
                    if len(leads) < LEADS:
                        leads.append(x)
                sid = x
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["sig", "sid", "place", "leads"])

    types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary())]
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "sig").sortWithinPartitions("sig", "sid").mapInArrow(run, "sig long, sid binary, place long, leads array<binary>")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar; ``texts`` (sid, text) has every text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            for u, tu, tv in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if u != last:
                    last, held = u, shingles(tu, shingle)
                other = shingles(tv, shingle)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held) + len(other) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("sid").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("sid").alias("v"), F.col("text").alias("tv"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "tu", "tv").mapInArrow(run, "u binary, v binary")


def chances(rows: list[tuple], percent: int, split: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of ``rows`` (sid, root, n, hist) of different roots that may be similar; with ``split``, only those of a row before it with one from it on."""
    n = np.array([r[2] for r in rows], np.int64)
    code: dict[bytes, int] = {}
    root = np.array([code.setdefault(r[1], len(code)) for r in rows], np.int64)
    width = min(len(r[3]) for r in rows)
    # A histogram of more buckets folds into the shortest; full buckets tell nothing.
    hist = np.stack([np.frombuffer(r[3], np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int16) for r in rows])
    full = hist >= 255
    every = np.arange(len(rows))
    for i in range(len(rows) if split is None else split):
        js = every[i + 1 if split is None else split :]
        js = js[(root[js] != root[i]) & (100 * np.minimum(n[i], n[js]) >= percent * np.maximum(n[i], n[js]))]
        if not len(js):
            continue
        gap = np.where(full[js] | full[i], 0, np.abs(hist[js] - hist[i])).sum(axis=1)
        for j in js[gap <= (n[i] + n[js]) * (100 - percent) // (100 + percent)]:
            yield rows[i][0], rows[int(j)][0]


def _by_group(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The pairs within every group of ``keys``; where there is a column ``side``, pairs of both sides only. Groups are read one by one, in order."""
    cols = [*keys, "sid", "root", "n", "hist", "side"]

    def close(group: list) -> set:
        if len({r[-1] for r in group}) == 1 and group[0][-1] is not None or len({r[1] for r in group}) == 1:
            return set()
        split = None if group[0][-1] is None else sum(r[-1] == 0 for r in group)
        return set(chances(group, percent, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for b in batches:
            found: set = set()
            key = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
            for k, r in zip(key, zip(*(b.column(c).to_pylist() for c in cols[len(keys) :]), strict=True), strict=True):
                if k != at:
                    if len(group) > 1:
                        found |= close(group)
                    at, group = k, []
                group.append(r)
            if found:
                yield _pairs(found)
        if len(group) > 1:
            yield _pairs(close(group))

    n = shuffle_partitions(rows.sparkSession)
    return rows.select(cols).repartition(n, *keys).sortWithinPartitions(*keys, "side", "sid").mapInArrow(run, "u binary, v binary")


def met(rows: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(sig, sid, root, n, hist) -> distinct pairs (u, v) of one signature and different roots that may be similar.

    Signatures of more than ``block`` rows are cut into blocks by hash of the
    text; each block meets itself and every other block, in tasks of their own.
    """
    size = rows.groupBy("sig").agg(F.count("*").alias("c"))
    cutting = rows.join(size.select("sig", F.expr(f"cast((c - 1) div {block} + 1 as int)").alias("blocks")), "sig")
    dealt = cut(cutting.withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")))
    near = _by_group(dealt.withColumn("side", F.lit(None).cast("int")), ["sig", "blk"], percent)
    meets = dealt.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> blk")
    meets = meets.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).withColumn("side", F.when(F.col("blk") < F.col("other"), 0).otherwise(1))
    far = _by_group(meets, ["sig", "lo", "hi"], percent)
    return near.union(far).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _pairs(got: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.binary()), pa.array([b for _, b in got], pa.binary())], names=["u", "v"])


def sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """sid and text with n and the histogram of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sets = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([histogram(s).tobytes() for s in sets], pa.binary())], names=["sid", "text", "n", "hist"])

    return texts.select("sid", "text").mapInArrow(run, "sid binary, text binary, n long, hist binary")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``root``: the text that names the component of ``sid``."""
    roots = components(links).withColumnRenamed("u", "sid")
    return rows.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, growth: float = GROWTH, coarse: int = COARSE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Null, empty and blank texts have an empty set, are linked with nothing and
    are components of their own. A text of fewer words than a shingle is one
    shingle. Documents linked by steps share a component, named by its
    smallest doc_id. Rows with equal ids stay separate; a null id keeps its
    row but never names a component unless all its ids are null. An empty
    table gives no rows; extra columns are dropped.
    """
    spark = docs.sparkSession
    with scratch(spark, "jaccard") as at:
        filed(docs, shingle, (percent, growth, coarse)).write.parquet(f"{at}/filed")
        sets = spark.read.parquet(f"{at}/filed")
        size = sets.groupBy("sid").agg(F.max("n").alias("n"))
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), text_id(F.col("text")).alias("sid")).write.parquet(f"{at}/marks")
        marks = spark.read.parquet(f"{at}/marks")
        # One row speaks for all copies of a text.
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
        marks.groupBy("sid").agg(F.min(row).alias("first")).join(size, "sid").write.parquet(f"{at}/firsts")
        firsts = spark.read.parquet(f"{at}/firsts")
        for i in range(PASSES):
            mine = F.expr(f"explode(filter(sigs, s -> pmod(s, {PASSES}) = {i}))")
            shared(sets.select(mine.alias("sig"), "sid")).write.mode("append").parquet(f"{at}/shared")
            tidy(spark)
        del sets, size
        drop(spark, f"{at}/filed")
        rows = spark.read.parquet(f"{at}/shared")
        wanted = cut(firsts.join(rows.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("first.key").alias("key")))
        keyed = docs.select(row_key(docs).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        sketched(those_of(keyed, wanted, "key").dropDuplicates(["key"]), shingle).write.parquet(f"{at}/texts")
        del wanted, keyed
        tidy(spark)
        texts = spark.read.parquet(f"{at}/texts")
        lead = rows.select(F.col("sid").alias("v"), F.explode("leads").alias("u")).select("u", "v").distinct()
        links = cut(verified(lead, texts, shingle, percent))
        tidy(spark)
        # Signatures of few texts are done with; of the others, those that still have more than one component can hold another link.
        many = rows.filter(F.col("place") == LEADS + 1).select("sig")
        rooted = cut(_rooted(rows.select("sig", "sid").join(many, "sig", "left_semi"), links))
        mixed_sigs = rooted.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("sig")
        left = rooted.join(mixed_sigs, "sig", "left_semi")
        pairs = met(left.join(texts.select("sid", "n", "hist"), "sid").select("sig", "sid", "root", "n", "hist"), percent, block)
        done = lead.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = cut(pairs.join(done, ["u", "v"], "left_anti"))
        ends = cut(pairs.select(F.col("u").alias("sid")).union(pairs.select(F.col("v").alias("sid"))).distinct())
        more = verified(pairs, those_of(texts.select("sid", "text"), ends, "sid"), shingle, percent)
        named = _rooted(firsts, links.union(cut(more)))
        best = named.groupBy("root").agg(F.min("first").alias("best"))
        groups = cut(named.select("sid", "root", "n").join(best, "root").select("sid", "n", F.col("best.doc_id").alias("component_id")))
        out = marks.select("doc_id", "sid").join(groups, "sid")
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
