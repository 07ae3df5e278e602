"""Importance resampling against a loop over words, chunked and whole."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T
from test_operators import AWKWARD, DOCS, clashing

from tessera.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def brute(docs, target, percent=25, least=20):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])

    s, t = count(x for _, x in docs), count(target)
    n_s, n_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (n_s + 10_000.0)) / ((s[b] + 1.0) * (n_t + 10_000.0)))) for b in s}
    rows = []
    for d, x in docs:
        words, fs = features(x)
        w = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in fs) // len(fs) if fs else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(fs), w, score, len(words)])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (r[3] is None, -(r[3] or 0), r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    out = Counter()
    for r in rows:
        rank = next((i for i, x in enumerate(drawn, 1) if x is r), None)
        out[(*r[:4], rank)] += 1
    return out


@pytest.mark.parametrize("size", [37, 400, 20_000])
def test_resample_matches_brute_force(spark, small, size):
    docs, goal = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, importance.resample(docs, goal, size=size).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in goal.collect()])


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    goal = spark.createDataFrame([("one two three",), (None,), ("ha ha",)], "text string")
    got = Counter(map(tuple, importance.resample(clashing(df), goal, percent=60, least_words=3, size=1000).collect()))
    assert got == brute([(r[0], r[1]) for r in AWKWARD], ["one two three", None, "ha ha"], 60, 3)
    assert importance.resample(spark.createDataFrame([], DOCS), goal).collect() == []
    assert len(importance.resample(df, goal.limit(0)).collect()) == len(AWKWARD)


def test_chunks_own_every_starting_position_once():
    rng = np.random.default_rng(5)
    for ngram in (1, 2, 3):
        text = "".join(rng.choice(list("ab é.,\n"), 3000)).encode() + b"x" * 500 + " ö".encode()
        whole = importance.buckets(text, len(text), ngram)
        parts = [importance.buckets(p, o, ngram) for p, o in importance.chunks(text, 61, ngram - 1)]
        assert len(parts) > 10 and sum(n for n, _ in parts) == whole[0]
        assert Counter(np.concatenate([b for _, b in parts]).tolist()) == Counter(whole[1].tolist())


def test_schema(spark, small):
    got = importance.op13_importance(spark, small).schema
    assert [(f.name, f.dataType) for f in got] == [(c, T.LongType()) for c in ("doc_id", "n_features", "weight", "score", "rank")]
