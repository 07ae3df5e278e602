"""The Jaccard join against all pairs, and its signatures' guarantee on random sets."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T
from test_operators import AWKWARD, DOCS, clashing

from tessera.llm import jaccard


def brute(rows):
    """(doc_id, text) -> Counter of (doc_id, n_shingles, component_id); every pair is compared."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df, **how):
    return Counter(map(tuple, jaccard.classes(df, **how).collect()))


def test_classes_match_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert found(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("block", [6, 4096])
def test_chains_of_copies_and_a_shared_passage(spark, block):
    """Copies of copies drift apart, so that links go by steps; a passage makes strangers share signatures."""
    rng = np.random.default_rng(2)
    vocab = np.array([f"w{i}" for i in range(300)])
    passage = list(rng.choice(vocab, 40))
    rows = []
    for n in (5, 7, 9, 14, 30, 70, 250):
        at = list(rng.choice(vocab, n))
        for k in range(25):
            if k % 2:
                at[int(rng.integers(len(at)))] = str(rng.choice(vocab))
            rows.append(" ".join(at + (passage if k % 3 == 0 else [])))
    rows += [" ".join(passage + list(rng.choice(vocab, int(rng.integers(3, 30))))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = found(df, block=block)
    assert got == brute(list(enumerate(rows)))
    assert max(Counter(c for _, _, c in got).values()) > 5


def test_awkward_rows(spark):
    extra = [(11, "Ab  cd\tEF gh ij kl", "en", "a", 1), (10, "ab cd ef gh ij kl", "en", "a", 1), (None, "ab cd ef gh ij kl", None, None, None), (12, "\x00", None, None, 1)]
    df = spark.createDataFrame(AWKWARD + extra, DOCS)
    assert found(clashing(df)) == brute([(r[0], r[1]) for r in AWKWARD + extra])
    assert jaccard.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_similar_sets_share_a_signature():
    """Pairs at the very limit, of all sizes."""
    rng, bands = np.random.default_rng(9), jaccard.Bands()
    for a in [*range(1, 60), 75, 113, 190, 320, 700, 1500]:
        for _ in range(20):
            base = rng.integers(0, 2**63, 3 * a + 20, dtype=np.uint64)
            k = int(rng.integers(0, jaccard.most_apart(a) + 1))
            gone = int(rng.integers(0, k + 1))
            x, y = np.sort(base[:a]), np.sort(np.concatenate([base[gone:a], base[a : a + k - gone]]))
            common, union = a - gone, a + k - gone
            if len(y) and 100 * common >= 85 * union:
                assert np.intersect1d(bands.signatures(x), bands.signatures(y)).size, (a, k, gone)


def test_histograms_never_part_similar_sets():
    rng = np.random.default_rng(4)
    for a in (6, 40, 300, 2500):
        base = np.unique(rng.integers(0, 2**63, a + a // 5, dtype=np.uint64))
        x, y = base[:a], base[a // 13 : a]
        rows = [(b"x", b"1", len(x), jaccard.histogram(x).tobytes()), (b"y", b"2", len(y), jaccard.histogram(y).tobytes())]
        assert list(jaccard.chances(rows, 85)) == [(b"x", b"y")]


def test_schema(spark, small):
    got = jaccard.op12_jaccard(spark, small).schema
    assert [(f.name, f.dataType) for f in got] == [(c, T.LongType()) for c in ("doc_id", "n_shingles", "component_id")]


def test_signatures_come_in_passes_and_go_once_they_are_shared(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + (" x" if i % 3 == 2 else "")) for i in range(60)]
    docs, dropped, dealt, whole = spark.createDataFrame(rows, "doc_id long, text string"), [], [], jaccard.shared
    monkeypatch.setattr(jaccard, "drop", lambda _, at: dropped.append(at.rsplit("/", 1)[-1]))
    monkeypatch.setattr(jaccard, "shared", lambda df: dealt.append(df) or whole(df))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    assert got == {i: i // 3 * 3 for i, _ in rows}
    assert len(dealt) == jaccard.PASSES and dropped == ["filed"]


def test_passes_deal_every_signature_once(spark, small, monkeypatch):
    dealt, whole = [], jaccard.shared
    monkeypatch.setattr(jaccard, "shared", lambda df: dealt.extend(r["sig"] for r in df.collect()) or whole(df))
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    jaccard.classes(docs).collect()
    how = jaccard.Bands()
    want = {int(s) for r in docs.collect() for s in how.signatures(jaccard.shingles((r["text"] or "").encode())).view(np.int64)}
    assert set(dealt) == want
