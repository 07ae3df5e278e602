"""The Merkle manifest against a loop over lists, and its proofs on awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T
from test_operators import AWKWARD, DOCS, clashing

from tessera.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """(doc_id, source, lang, n_chars, text) -> Counter of result rows; ties by leaf."""

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """Root of ``nodes`` and each one's siblings level by level, (left, right)."""
        paths, home = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, h in zip(paths, home, strict=True):
                run = nodes[h // 3 * 3 : h // 3 * 3 + 3]
                p.append(("".join(run[: h % 3]), "".join(run[h % 3 + 1 :])))
            nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
            home = [h // 3 for h in home]
        return nodes[0], paths

    by = defaultdict(list)
    for d, s, lang, n, t in rows:
        leaf = H(*map(enc, (d, s, lang, n, t)))
        tampered = leaf
        if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
            tampered = H(*map(enc, (d, s, lang, n, t if t is None else t.replace("\n", ""))))
        by[s].append((d, leaf, tampered))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: tree([leaf for _, leaf, _ in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for s in order}
    if not order:
        return Counter()
    root, tops = tree([sub[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops, strict=True):
        for (d, leaf, fold), path in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])), sub[s][1], strict=True):
            for left, right in path + top:
                fold = H(left, fold, right)
            out[(d, leaf, sub[s][0], root, H(*(x for p in path + top for x in p)), fold, fold == root)] += 1
    return out


def rows_of(df):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_is_the_loops_over_several_rounds(spark, levels):
    lines = [(i, "one\ntwo" if i % 3 else "flat", "en", f"s{i % 2 if i < 40 else i % 5}", i) for i in range(61)]
    df = spark.createDataFrame(lines, DOCS)
    got = Counter(map(tuple, merkle.manifest(df, levels).collect()))
    assert got == brute(rows_of(df))
    assert {r[-1] for r in got} == {True, False}


def test_awkward_rows_and_repeats_have_proofs_of_their_own(spark):
    df = spark.createDataFrame(AWKWARD + AWKWARD[3:4] + [(None, "é\n", None, None, None), (9, "a\nb", "en", "", 3)], DOCS)
    assert Counter(map(tuple, merkle.manifest(clashing(df)).collect())) == brute(rows_of(df))
    one = spark.createDataFrame(AWKWARD[:1], DOCS)
    (r,) = merkle.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == H() and r["verified"]
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_text_with_line_feeds_is_found_out_and_nothing_else(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    found = {r["doc_id"] for r in merkle.manifest(df).collect() if not r["verified"]}
    assert found == {r["doc_id"] for r in df.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")}


def test_sql_of_crc32():
    for s in ("7", "123456789", "é x"):
        assert duckdb.sql("select " + merkle.crc32_sql(f"hex(encode('{s}'))")).fetchall() == [(zlib.crc32(s.encode()),)]


def test_schema(spark, small):
    got = merkle.op11_merkle(spark, small).schema
    assert [(f.name, f.dataType) for f in got] == [("doc_id", T.LongType()), *((c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", T.BooleanType())]
