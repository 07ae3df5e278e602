"""Toxicity: a convolutional text classifier on hashed word embeddings.

Trained in numpy on the driver from a bounded sample of labelled documents.
The score of a text depends on its words alone; the decision threshold is set
per language as read from the text's own function words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

from .common import table
from .quality import COMMON_WORDS

BUCKETS = 1 << 16
EMBED = 16
#: A word is embedded as the sum of its own bucket and those of its beginnings.
BEGINNINGS = (4, 5)
FEATURES = 1 + len(BEGINNINGS)
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Most labelled documents of either class that are fetched for training.
MAX_TRAIN = {1: 4000, 0: 6000}
#: Most characters of them; a document that does not fit what is left is passed over, none is cut.
MAX_CHARS = {1: 10_000_000, 0: 16_000_000}
#: Documents and words of one training step, about.
BATCH = 64
BATCH_WORDS = 100_000
MIN_STEPS = 500
SEED = 5
_WORD = re.compile(r"\w+")
_LANGS = tuple(sorted(COMMON_WORDS))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class Hasher:
    """Words of a text -> buckets (one row a word), with a bounded cache."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        cache = self.cache
        if len(cache) > 300_000:
            cache.clear()
        out: list[int] = []
        for w in _WORD.findall(text.lower()):
            k = cache.get(w)
            if k is None:
                k = cache[w] = (bucket(w), *(bucket(w[:n] + "*") for n in BEGINNINGS))
            out += k
        return np.array(out, np.int32).reshape(-1, FEATURES)


def language_of(ids: np.ndarray) -> int:
    """Index of the language with the most function words; len(_LANGS) for none."""
    if not len(ids):
        return len(_LANGS)
    hits = _language_table()[ids[:, 0]].sum(axis=0)
    return int(hits.argmax()) if hits.any() else len(_LANGS)


def _language_table() -> np.ndarray:
    out = np.zeros((BUCKETS, len(_LANGS)), np.int32)
    for j, lang in enumerate(_LANGS):
        out[[bucket(w) for w in COMMON_WORDS[lang]], j] = 1
    return out


@dataclass
class TextNet:
    embed: np.ndarray
    kernels: list[np.ndarray]  # one (width, EMBED, FILTERS) each
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(len(_LANGS) + 1))
    scale: float = 1.0

    def tables(self) -> list[list[np.ndarray]]:
        """Every bucket's share of every filter, so that scoring only looks up and adds."""
        return [[np.ascontiguousarray(self.embed @ k[j]) for j in range(len(k))] for k in self.kernels]

    def logit(self, ids: np.ndarray, tables: list[list[np.ndarray]]) -> float:
        pooled = []
        for t, bias in zip(tables, self.biases, strict=True):
            n = len(ids) - len(t) + 1
            top = np.zeros(FILTERS, np.float32)
            for a in range(0, max(n, 0), 8192):  # bounded memory for any length
                z = min(a + 8192, n)
                conv = np.zeros((z - a, FILTERS), np.float32)
                for j in range(len(t)):
                    for f in range(FEATURES):
                        conv += t[j][ids[a + j : z + j, f]]
                top = np.maximum(top, conv.max(axis=0) + bias)
            pooled.append(top)
        return float(np.concatenate(pooled) @ self.out + self.out_bias[0])

    def score(self, logit: float, lang: int) -> float:
        z = self.scale * (logit - self.shifts[lang])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> TextNet:
    """Adam on batches of whole documents; every fifth document calibrates instead."""
    rng = np.random.default_rng(seed)
    net = TextNet(
        rng.normal(0, 0.05, (BUCKETS, EMBED)).astype(np.float32),
        [rng.normal(0, 0.4 / np.sqrt(w), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        np.zeros(1, np.float32),
    )
    held = np.arange(len(docs)) % 5 == 4
    use = np.flatnonzero(~held)
    if not len(use) or len(np.unique(labels[use])) < 2:
        net.out[:] = 0
        net.out_bias[0] = -4.0 if not labels.any() else 4.0
        return net
    params = [net.embed, *net.kernels, *net.biases, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(labels == 1, (labels[use] == 0).sum() / max(1, (labels[use] == 1).sum()), 1.0)
    step, rounds = 0, max(3, -(-MIN_STEPS * BATCH // len(use)))
    for _ in range(rounds):
        rng.shuffle(use)
        for rows in _batches(use, docs):
            picked = [np.concatenate([docs[r], np.zeros((max(WIDTHS), FEATURES), np.int32)]) for r in rows]
            ends = np.cumsum([len(d) for d in picked])
            begins = ends - [len(d) for d in picked]
            ids = np.concatenate(picked)
            x = net.embed[ids].sum(axis=1)
            pooled = np.zeros((len(rows), FILTERS * len(WIDTHS)), np.float32)
            tops = []
            for k, w in enumerate(WIDTHS):
                n = len(ids) - w + 1
                conv = x[:n] @ net.kernels[k][0]
                for j in range(1, w):
                    conv += x[j : n + j] @ net.kernels[k][j]
                # Only windows of real words, as in scoring; a text that is too short for any gives zero.
                last = [z - max(WIDTHS) - w + 1 for z in ends]
                top = np.array([a + conv[a:z].argmax(axis=0) if z > a else np.full(FILTERS, a) for a, z in zip(begins, last, strict=True)])
                tops.append(top)
                some = np.array([z > a for a, z in zip(begins, last, strict=True)])[:, None]
                pooled[:, k * FILTERS : (k + 1) * FILTERS] = (conv[top, np.arange(FILTERS)] + net.biases[k]) * some
            live = pooled > 0
            act = pooled * live
            logit = act @ net.out + net.out_bias[0]
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
            d = d.astype(np.float32)
            d_act = d[:, None] * net.out[None] * live
            g_embed = np.zeros_like(net.embed)
            g_k, g_b = [], []
            for k, w in enumerate(WIDTHS):
                g = d_act[:, k * FILTERS : (k + 1) * FILTERS]
                g_b.append(g.sum(axis=0))
                gk = np.zeros_like(net.kernels[k])
                for j in range(w):
                    at = np.minimum(tops[k] + j, len(ids) - 1)  # rows x FILTERS
                    gk[j] = np.einsum("rfe,rf->ef", x[at], g)
                    moved = g[..., None] * net.kernels[k][j].T[None]
                    for f in range(FEATURES):
                        np.add.at(g_embed, ids[at, f], moved)
                g_k.append(gk)
            grads = [g_embed, *g_k, *g_b, act.T @ d, np.array([d.sum()], np.float32)]
            step += 1
            for p, g, a, c in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                c += 0.01 * (g * g - c)
                p -= 0.004 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)
    calibrate(net, [docs[i] for i in np.flatnonzero(held)], labels[held])
    return net


def _batches(use: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    a = words = 0
    for z in range(len(use)):
        words += len(docs[use[z]])
        if z + 1 - a == BATCH or words >= BATCH_WORDS or z + 1 == len(use):
            yield use[a : z + 1]
            a, words = z + 1, 0


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap above it."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float((z[order][k] + below) / 2)


def calibrate(net: TextNet, docs: list[np.ndarray], labels: np.ndarray, prior: float = 10) -> None:
    """Set the shift of every language, so that score 0.5 is its own best cut.

    The cut of a language with few toxic documents leans to that of all, which counts as ``prior`` documents.
    """
    if not len(docs) or not labels.any():
        return
    tables = net.tables()
    z = np.array([net.logit(d, tables) for d in docs])
    langs = np.array([language_of(d) for d in docs])
    every = _best_cut(z, labels)
    net.shifts[:] = every
    for lang in range(len(_LANGS) + 1):
        here = langs == lang
        if toxic := float(labels[here].sum()):
            net.shifts[lang] = (toxic * _best_cut(z[here], labels[here]) + prior * every) / (toxic + prior)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed words and labels of labelled documents that are not held out, whole texts.

    A sample bounded by MAX_TRAIN documents and MAX_CHARS characters a class,
    in the order of a hash of the id. Only chosen ids are sent to the scans of
    the texts, and only what fits the bounds comes back.
    """
    ok = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    ok = ok.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    parts = [ok.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in MAX_TRAIN.items()]
    chosen = parts[0].union(parts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for b in batches:
            ids = [hashed(t or "").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "ids"])

    # At most the sum of MAX_TRAIN ids go out, and as many sizes come back (rows that repeat an id count as one).
    chosen = cut(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")))
    asked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    sizes = asked.groupBy("doc_id", "toxic").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).collect()
    left, fits = dict(MAX_CHARS), []
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"])):
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            fits.append((r["doc_id"], r["toxic"]))
    few = docs.sparkSession.createDataFrame(fits, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id")
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, ids binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["ids"])))
    return [np.frombuffer(r["ids"], np.int32).reshape(-1, FEATURES) for r in rows], np.array([r["toxic"] for r in rows], np.float32)


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, net: TextNet | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The score reads the whole text and nothing else; null counts as empty. A
    label counts once per id (the largest); ids without a usable label train
    nothing. Without labels of both classes every score is constant. Repeated
    rows are scored each; empty input gives no rows; extra columns are dropped.
    """
    if net is None:
        net = fit(*training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashed = shared.value, Hasher()
        tables, langs = model.tables(), _language_table()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                ids = hashed(t or "")
                hits = langs[ids[:, 0]].sum(axis=0)
                lang = int(hits.argmax()) if hits.any() else len(_LANGS)
                out.append(model.score(model.logit(ids, tables), lang))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
