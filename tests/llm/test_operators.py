"""Every text operator against a brute-force version, and on awkward rows."""

import base64
import dataclasses
import hashlib
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import types as T

from tessera.llm import html, mixing, neighbours, packing, quality, queries, secrets, simhash, substrings, toxicity, urls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "".join(chr(97 + (i * i // 7) % 26) + (" " if i % 6 == 0 else "") for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, "   \n\t ", "xx", "b", 6),
    (4, "one two three", "en", "a", 13),
    (4, "one two three", "en", "a", 13),
    (None, "the id is missing here and there are words", "en", None, 40),
    (5, LONG, "de", "b", len(LONG)),
    (6, LONG, "de", "b", len(LONG)),
    (7, "é" * 300 + " ü\u2028x <|endoftext|> \U0001f600 end", "fr", "c", 320),
    (8, "ha " * 500, "en", "c", 1500),
]
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("key", "fp", "size", "kept", "taken", "owner", "length", "__s", "part", "words", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df


# ---- 1 ------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w.encode() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    fps, ids = [f for _, f in rows], [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("name", ["docs", "awkward"])
def test_simhash_matches_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    expect = Counter((i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == expect


def test_simhash_blocks_of_full_cells_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(150):
            x = int(b)
            for k in rng.integers(0, 64, 3):
                x ^= 1 << int(k)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 100, dtype=np.uint64)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([Row(fp=f if f < 2**63 else f - 2**64) for _, f in rows])
    for block in (8, 8192):
        got = simhash.components(simhash.links(df, block=block)).collect()
        part = {r["u"] % 2**64: r["root"] % 2**64 for r in got}
        ours = {}
        for _, f in rows:
            ours.setdefault(part.get(f, f), set()).add(f)
        theirs = {}
        for (_, f), c in zip(rows, brute_components(rows), strict=True):
            theirs.setdefault(c, set()).add(f)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_keep_first_leaves_one_of_each_group(docs, awkward):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    comps = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(comps)
    ids = [r["doc_id"] for r in simhash.keep_first(awkward).collect()]
    assert ids.count(4) == 1 and (5 in ids) and (6 not in ids)


# ---- 2 ------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["docs", "awkward"])
def test_quality_base_counts(request, name):
    df = request.getfixturevalue(name)
    got = Counter(tuple(r)[:6] for r in quality.judge(df).collect())
    assert got == Counter((r["doc_id"], *brute_quality(r["text"])) for r in df.collect())


def test_quality_keeps_clean_and_drops_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.judge(d).collect() if r["doc_id"] in labels and not r["base_failed"]]
    clean = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    assert np.mean(clean) > 0.98
    junk = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert len(junk) >= 20 and np.mean(junk) < 0.35
    kept = [r["doc_id"] for r in quality.keep_good(d).collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in quality.judge(d).collect() if r["kept"])


# ---- 3 ------------------------------------------------------------------------


def test_neighbours_recall_and_scores(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = v.collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    got = {}
    for r in neighbours.nearest(v).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        mine = sorted(got[int(ids[q])])
        assert [k for k, _, _ in mine] == list(range(1, 11))
        dist = dict(zip(ids.tolist(), d.tolist(), strict=True))
        assert all(abs(dist[i] - s) < 1e-12 for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & set(ids[order].tolist()))
        total += 10
    assert hit / total >= 0.9


def test_neighbours_recall_over_many_shards(spark, monkeypatch):
    """Two hundred queries over leaves of the upper tree, leaves in several shards, and the second pass."""
    monkeypatch.setattr(neighbours, "SHARD", 300)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 20_000)] + 0.3 * rng.normal(size=(20_000, 16))).astype(np.float32)
    x[5000:5400] = x[0]  # more equal vectors than a shard holds
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    found = {}
    for r in neighbours.nearest(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 20_000, 100))
    x = x.astype(float)
    recall = []
    for q, mine in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert [k for k, _, _ in sorted(mine)] == list(range(1, 11))
        recall.append(len({i for _, i, _ in mine} & set(order)) / 10)
        if d[order].max() == 0:
            assert [i for _, i, _ in sorted(mine)] == order
    assert np.mean(recall) >= 0.95


def test_neighbours_count_rows_not_ids(spark):
    """A row with the query's id is a candidate like any other; each of them asks."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 2.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(df).collect())
    assert got == [(100, 1, 5, 1.0), (100, 1, 5, 1.414214), (100, 2, 100, 2.236068), (100, 2, 100, 2.236068)]
    more = df.withColumns({c: neighbours.F.lit("x") for c in ("id", "row", "v", "p", "dim", "leaf", "shard")})
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(more).collect()) == got


def test_neighbours_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 9), (0, 2, 9), (0, 3, 100), (0, 4, 7), (100, 1, 0), (100, 2, 9), (100, 3, 9), (100, 4, 7)]
    assert neighbours.nearest(df.limit(0)).count() == 0


# ---- 4 ------------------------------------------------------------------------


def brute_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if m.end() - m.start() >= n]
    return ",".join(s for *_, s in sorted(out))


def test_secrets_base_spans(spark, docs):
    tricky = [(1, "é secret=token:abcdefgh PASSWORD = 'hunter22' api_key:short"), (2, "x" + "a1" * 20 + " AKIA" + "B2" * 10 + "\U0001f600 token=" + "deadbeef" * 4), (3, None)]
    for df in (docs, spark.createDataFrame(tricky, "doc_id long, text string")):
        for r in secrets.find_secrets(df).join(df.withColumnRenamed("doc_id", "id"), [secrets.F.col("id") == secrets.F.col("doc_id")]).collect():
            base = ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"] if f["kind"] != "model")
            assert base == brute_secrets(r["text"])


def test_secrets_reads_the_middle_of_long_runs(spark):
    net = secrets.train()
    key = "q7Xz9LmP2vK8sWd4RtY6bN1cH3jF5gTa"
    path = "/opt/data/reports/archive/year/summary/tables/", "/pages/index/common/static/output/final.html"
    runs = [(0, 16), (3, 51), (0, 49), (5, 400)]
    for a, z in runs:
        w = secrets.windows(a, z)
        assert w[0][0] == a and w[-1][1] == z and all(y - x <= 48 for x, y in w)
        assert all(v[0] <= u[1] - 32 for u, v in zip(w, w[1:]))
    plain, planted = f"see {path[0]}v2{path[1]} now", f"see {path[0]}{key}{path[1]} now"
    assert not [f for f in secrets.scan(plain, net) if f[2] == "model"]
    assert [f for f in secrets.scan(planted, net) if f[2] == "model"] == [(4, len(planted) - 4, "model")]
    # A base match of the tail alone leaves the rest to the network.
    run = f"{key}.token=abc123"
    assert [k for *_, k in secrets.scan(f"see {run} now", net)] == ["model", "assign"]
    df = spark.createDataFrame([(1, f"see {run} now"), (2, planted)], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(df).orderBy("doc_id").collect()] == ["see [secret] now"] * 2


def test_secrets_network_on_held_out_findings():
    net = secrets.train()
    rows = secrets.labelled_findings(1500, 991)
    sort = np.array([secrets.token_class(t[a:z]) for t, a, z, _ in rows])
    p = net.scores(np.array([secrets.encode(t, a, z) for t, a, z, _ in rows])) >= net.thresholds[sort]
    y = np.array([r[3] for r in rows], bool)
    assert p[y].mean() > 0.93 and p[~y].mean() < 0.02
    for c in ("hex", "plain", "marked"):
        assert p[y & (sort == secrets.CLASSES.index(c))].mean() > 0.85


def planted_secrets(n=300):
    """Keys of formats that the labelled findings do not have, none of which a base rule finds."""
    rng = np.random.default_rng(77)
    alnum = np.array(list(string.ascii_letters + string.digits))

    def draw(k):
        return "".join(rng.choice(alnum, k))

    forms = [lambda: f"ghp_{draw(36)}", lambda: f"AIza{draw(35)}", lambda: f"glpat-{draw(20)}", lambda: f"SG.{draw(22)}.{draw(43)}", lambda: base64.b64encode(rng.bytes(32)).decode(), lambda: f"npm_{draw(36)}", lambda: f"rk_test_{draw(24)}"]
    before = ["use ", "Authorization: Bearer ", "export KEY ", "set the credential to ", "login with "]
    return [(i, f"the small house stands there. {before[i % len(before)]}", forms[i % len(forms)]()) for i in range(n)]


def test_secrets_network_finds_planted_keys_through_the_query(spark, docs):
    planted = planted_secrets()
    df = spark.createDataFrame([(i, f"{b}{k} and then it went on as before.") for i, b, k in planted], "doc_id long, text string")
    got = {r["doc_id"]: {(f["start"], f["end"]) for f in r["findings"] if f["kind"] == "model"} for r in secrets.find_secrets(df).collect()}
    whole = sum((len(b), len(b) + len(k)) in got[i] for i, b, k in planted)
    assert whole >= 0.95 * len(planted)
    # Without the network's verdict nothing of them is found, and clean texts are left alone with it.
    silent = dataclasses.replace(secrets.train(), thresholds=np.full(len(secrets.CLASSES), np.inf))
    assert not any(r["findings"] for r in secrets.find_secrets(df, silent).collect())
    added = sum(f["kind"] == "model" for r in secrets.find_secrets(docs).collect() for f in r["findings"])
    assert added <= 0.01 * docs.count()


def test_redact_replaces_every_finding(spark, awkward):
    df = spark.createDataFrame([(1, "a token = " + "0f" * 12 + " b", "en", "s", 3)], DOCS)
    assert secrets.redact(df).first()["text"] == "a [secret] b"
    assert secrets.redact(awkward).count() == len(AWKWARD)


# ---- 5 ------------------------------------------------------------------------


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= total
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - total) <= max(r["size"] for r in rows)
    again = sorted(map(tuple, mixing.mix(docs.repartition(7)).drop("key").collect()))
    assert again == sorted(tuple(r)[:-1] for r in rows)


def test_mixing_targets_stop_at_three_times(spark):
    df = spark.createDataFrame([(i, "w " * 100, "en", "a", 0) for i in range(20)] + [(100, "w w", "en", "b", 0), (101, None, "en", None, 0)], DOCS)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[100]["target"] == 6.0 and got[101]["target"] == 0.0
    assert got[0]["target"] == 2002 - 6.0
    assert got[100]["taken"] == 6


# ---- 6 ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["docs", "awkward"])
def test_packing_is_exact_and_tight(request, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(df).collect()
    expect = Counter()
    for r in df.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        n = len(ids)
        first = n % 1024 or min(n, 1024)
        for k, s in enumerate([0, *range(first, n, 1024)]):
            e = first if k == 0 else s + 1024
            expect[(r["doc_id"], k, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expect
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.02 + 2


# ---- 7 ------------------------------------------------------------------------


def test_url_rules_and_parts(spark):
    cases = [
        ("http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/2#t", "m.example.com", "/en/2", "example.com/en/", "block"),
        ("https://a.com/x", "a.com", "/x", "com/", "allow"),
        ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
        ("http://notexample.com", "notexample.com", "", None, None),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("x://h?y/z", "h", "", None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    for r, c in zip(urls.judge_urls(df).orderBy("page_id").collect(), cases, strict=True):
        assert (r["host"], r["path"], r["rule"]) == c[1:4]
        assert r["verdict"] == c[4] if c[4] else r["verdict"] in ("allow", "block")


def test_url_model_on_held_out_sites_through_the_query(spark, small):
    held = urls.labelled_urls(held=True)
    names = {h for h, _, _ in urls.labelled_urls()}
    assert not names & {h for h, _, _ in held}
    # No evaluated host of the tables trains the model either.
    assert not names & {urls.host_and_path(r["url"])[0] for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()}
    df = spark.createDataFrame([(i, f"https://{h}{p}") for i, (h, p, _) in enumerate(held)], "page_id long, url string")
    blocked = {r["page_id"] for r in urls.judge_urls(df, rules=()).filter("verdict = 'block'").collect()}
    real = {i for i, r in enumerate(held) if r[2]}
    assert len(blocked & real) >= 0.95 * len(real) and len(blocked & real) >= 0.97 * len(blocked)
    nothing = urls.UrlModel(np.zeros(urls.BUCKETS), -1.0)
    assert urls.judge_urls(df, rules=(), model=nothing).filter("verdict = 'block'").count() == 0


def test_urls_on_awkward_tables(spark):
    long = "https://my-casino.example.org/" + "a/" * 50_000
    rows = [(1, long), (1, long), (2, ""), (None, "https://city-library.example.org/"), (3, "HTTP://EXAMPLE.COM/en/?q"), (3, "HTTP://EXAMPLE.COM/en/?q")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(map(str, urls.judge_urls(df).collect()))
    assert len(got) == len(rows)
    more = df.withColumns({c: urls.F.lit("x") for c in ("host", "path", "rule", "verdict", "score")})
    assert sorted(map(str, urls.judge_urls(more).collect())) == got
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(df).filter("page_id = 1").collect()} == {"block"}


# ---- 8 ------------------------------------------------------------------------


def test_toxicity_learns_planted_words_and_never_reads_held_out_labels(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        t = list(rng.choice(words, 60))
        bad = i % 3 == 0
        if bad:
            t[int(rng.integers(60))] = "vilewort"
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.fit(*toxicity.training_rows(d, lab))
    out = toxicity.toxicity(d, lab, net).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    flipped = lab.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.training_rows(d, lab), toxicity.training_rows(d, flipped)
    assert len(a[0]) == len(b[0]) and (a[1] == b[1]).all()


def test_toxicity_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(awkward, none).count() == len(AWKWARD)
    assert toxicity.toxicity(empty, none).count() == 0


# ---- 9 ------------------------------------------------------------------------


def test_html_article_of_every_page(spark, small):
    from html import unescape

    for r in html.extract(spark.read.parquet(f"{small}/pages.parquet")).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_html_leaves_out_everything_around_the_article(spark):
    page = '<html><body><header><a href="/">Home</a></header><div class="cookie-notice">We use cookies</div><main><h1>Head</h1><p>Some &lt;b&gt;&nbsp;text &amp;amp; more<p>Next<script>var a="</p>";</script> one.<aside>side</aside><form><label>Mail</label></form><section id="comments"><p>Nice post</p></section></main><footer>foot</footer>'
    assert html.main_text(page) == "Head\nSome <b> text &amp; more\nNext one."
    plain = "<ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><p>" + "word " * 60 + "</p><p>" + "text " * 50 + "</p>"
    assert html.main_text(plain).startswith("word word")
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<div " + "x" * 5000)], "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(df).orderBy("page_id").collect()][:2] == ["", ""]


@pytest.mark.parametrize("made, least", [({}, 0.98), ({"named": 0.0}, 0.97), ({"named": 0.0, "landmarks": 0.0}, 0.95), ({"article": ""}, 0.97), ({"article": "", "named": 0.0, "landmarks": 0.0}, 0.93)])
def test_html_tree_on_held_out_pages(made, least):
    """With and without class names, elements made for boilerplate, and an element around the article."""
    x, y = html.labelled_blocks(200, seed=991, **made)
    p = np.array([html.is_main(html.train(), r) for r in x])
    assert (p & (y == 1)).sum() >= least * max(p.sum(), (y == 1).sum())


def test_html_tree_needs_word_counts_and_link_densities():
    made = {"article": "", "named": 0.0, "landmarks": 0.0}
    x, y = html.labelled_blocks(200, seed=991, **made)
    blind_x, blind_y = html.labelled_blocks()
    blind_x, x_blind = blind_x.copy(), x.copy()
    blind_x[:, :6] = x_blind[:, :6] = 0
    tree = html.grow(blind_x, blind_y)
    wrong = np.mean([html.is_main(html.train(), r) != bool(k) for r, k in zip(x, y, strict=True)])
    blind = np.mean([html.is_main(tree, r) != bool(k) for r, k in zip(x_blind, y, strict=True)])
    assert wrong < 0.03 and 2 * wrong < blind


def test_html_pages_of_the_table_without_their_marks(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    bare = pages.withColumn("html", html.F.regexp_replace("html", r"</?article>| class=\"[^\"]*\"", ""))
    with_marks = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    same = [r["text"] == with_marks[r["page_id"]] for r in html.extract(bare).collect()]
    assert np.mean(same) > 0.9


def test_html_on_awkward_tables(spark):
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, "<p>text"), (2, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(str, html.extract(df).collect()))
    assert len(got) == 4 and sum("word word" in r for r in got) == 2
    more = df.withColumns({c: html.F.lit("x") for c in ("text", "n_chars")})
    assert sorted(map(str, html.extract(more).collect())) == got
    assert html.extract(df.limit(0)).count() == 0


# ---- 10 -----------------------------------------------------------------------


def brute_repeats(texts, span=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                cover[i] += 1
                cover[i + span] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard, frequent", [(2000, 2), (2000, 10), (substrings.SHARD, substrings.FREQUENT)])
def test_substrings_match_brute_force(spark, docs, awkward, shard, frequent):
    for df in (docs.limit(60), awkward):
        rows = df.collect()
        expect = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows]), strict=True))
        assert Counter(map(tuple, substrings.remove_repeats(df, shard=shard, frequent=frequent).collect())) == expect


@pytest.mark.parametrize("low, high, n", [(97, 99, 900), (0, 2, 700), (97, 98, 500), (97, 98, 1)])
def test_suffix_array_and_common_prefixes(low, high, n):
    rng = np.random.default_rng(2)
    text = rng.integers(low, high, n).astype(np.uint8)
    text[n // 2 : n // 2 + 150] = text[10:160] if n > 400 else text[n // 2 : n // 2 + 150]
    raw, order = text.tobytes(), substrings.suffix_array(text)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])

    def common(a: int, b: int) -> int:
        return next((k for k in range(200) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or max(a, b) + k >= n), 200)

    assert substrings.common_prefixes(text, order, 200).tolist() == [0, *(common(a, b) for a, b in zip(order[:-1], order[1:], strict=True))]


def test_blocks_merge_by_binary_search():
    rng = np.random.default_rng(3)
    blocks = []
    for _ in range(7):
        keys = np.unique(rng.integers(0, 60, rng.integers(0, 30)))
        blocks.append((np.array([b"%016d" % k for k in keys], "S16"), rng.integers(1, 3, len(keys))))
    total = Counter()
    for k, n in blocks:
        for x, c in zip(k.tolist(), n.tolist(), strict=True):
            total[x] += c
    for (k, _), twice in zip(blocks, substrings.merge(blocks), strict=True):
        assert twice.tolist() == [total[x] > 1 for x in k.tolist()]


# ---- all ----------------------------------------------------------------------


@pytest.mark.parametrize("op", ["near_duplicates", "judge", "find_secrets", "mix", "pack", "remove_repeats", "keep_first", "keep_good", "redact", "repeat_taken"])
def test_empty_tables_and_clashing_names(op, awkward, empty):
    module = next(m for m in (simhash, quality, secrets, mixing, packing, substrings) if hasattr(m, op))
    f = getattr(module, op)
    assert f(empty).count() == 0
    plain = f(awkward)
    shown = [c for c in plain.columns if c not in ("sequence_id", "offset", "key")]
    extra = f(clashing(awkward)).select(shown)
    assert sorted(map(str, plain.select(shown).collect())) == sorted(map(str, extra.collect()))
    assert f(clashing(empty)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    ours = queries.QUERIES[name](spark, small).toPandas()
    theirs = con.execute(queries.ORACLES[name]).df()[list(ours.columns)]
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))


# ---- pipeline -----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, awkward, docs, tmp_path):
    """Every stage against its operator's plain results, over real and awkward rows; nothing is lost between."""
    import corpus_pipeline as pipeline

    prose = " ".join(f"the {w} of a {w}" for w in "river garden house music bridge window letter market".split())
    twins = [(900, prose + " twin", "en", s, n) for s, n in (("a", 1), ("b", 1), ("b", 2), ("b", 2))]
    key = "ghp_" + "q7Xz9LmP2vK8sWd4RtY6bN1cH3jF5gTa9bQ1"
    more = [(901, prose + " login with " + key + " and password=hunter22 done", "en", "c", 3), (902, prose.upper() + " other words here now", None, None, None)]
    base = docs.limit(120).select(*DOCS.fieldNames()).union(awkward).union(spark.createDataFrame(twins + more, DOCS))

    def stage(name, df):
        out = dict(pipeline.STAGES)[name](spark, df, "")
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def bag(df):
        return Counter(map(str, df.collect()))

    first = stage("quality", base)
    kept = Counter((r["doc_id"], r["n_words"]) for r in quality.judge(base).collect() if r["kept"])
    assert Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in first.collect()) == kept
    assert not bag(first) - bag(base)

    second = stage("near_dedup", first)
    parts = Counter(r["component_id"] for r in simhash.near_duplicates(first).collect())
    ids = Counter(r["doc_id"] for r in second.collect())
    assert set(ids) == set(parts) and max(ids.values()) == 1 and not bag(second) - bag(first)

    third = stage("secrets", second)
    net = secrets.train()
    for a, b in zip(second.orderBy("doc_id").collect(), third.orderBy("doc_id").collect(), strict=True):
        assert (a["doc_id"], a["lang"], a["source"]) == (b["doc_id"], b["lang"], b["source"]) and b["n_chars"] == len(b["text"])
        assert a["text"] == b["text"] or (secrets.scan(a["text"], net) and "[secret]" in b["text"])
        assert not [f for f in secrets.scan(b["text"], net) if f[2] != "model"]
    assert not [r for r in third.collect() if key in r["text"] or "hunter22" in r["text"]]

    # Rows equal in id and text but not in all columns are documents of their own.
    rows = third.union(spark.createDataFrame(twins, DOCS))
    fourth = stage("mixing", rows)
    taken = Counter()
    for r in mixing.mix(rows).collect():
        taken[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in fourth.collect()) == +taken
    assert not set(bag(fourth)) - set(bag(rows))
    twin = Counter((r["source"], r["n_chars"]) for r in fourth.collect() if r["doc_id"] == 900)
    assert all(n <= 3 * k for (_, n), k in zip(sorted(twin.items()), (1, 1, 2), strict=False))
    assert {s for s, _ in twin} <= {"a", "b"}

    last = dict(pipeline.STAGES)["packing"](spark, fourth, "").collect()
    used = Counter()
    for r in last:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAPACITY
    assert Counter(r["doc_id"] for r in last if r["start"] == 0) == Counter(r["doc_id"] for r in fourth.collect())


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
