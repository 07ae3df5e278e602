"""URL filters: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed rules: (verdict, host, path). The longest that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
SEED = 3

# What the labelled table is made of (fixed values). No site of it is taken from the tables that are judged.
BLOCKED_STEMS = "casino poker roulette slots jackpot betting bets wager lottery bingo pills pharma viagra cialis meds steroids xxx porn adult nude sex escort webcam hookup spam malware phish scam warez crack keygen torrent replica counterfeit payday loans ads advert adserver banner popup tracker tracking clickbait".split()
ALLOWED_STEMS = "news library garden museum school weather history science cooking train council math river music art travel health sport book recipe forum wiki code data film photo bird tree village market kitchen letter harbour mountain teacher student doctor nature ocean planet bridge".split()
#: These say nothing by themselves: they go with either kind.
MODIFIERS = "best top my new online city world daily super mega hub zone club house shop store land box spot quick first big".split()
INVENTED = 240
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = ("example.com", "example.org", "example.net")
PAGES = ("/en/1204", "/de/77.html", "/fr/31/", "/es/902", "/about")
#: A path that alone speaks for blocking.
BLOCKED_PAGES = ("/ads/banner", "/casino/bonus", "/xxx/video", "/spam/list", "/pills/buy")
#: Every so many sites, one is held back from training, with all its hosts.
HELD = 5


def host_and_path(url: str | None) -> tuple[str, str]:
    """ASCII-lower-cased host and the path of a url; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def _grams(kind: str, s: str) -> list[int]:
    """Buckets of the character n-grams of a host or a path; digits are alike."""
    s = "".join("0" if c.isdigit() else c for c in f"^{s}$")
    return [zlib.crc32(f"{kind}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in GRAMS for i in range(len(s) - n + 1)]


def labelled_sites(seed: int = SEED) -> list[tuple[str, int]]:
    """(site name, 1 for block): each stem alone and with modifiers or another stem on either side, and invented names."""
    rng = np.random.default_rng(seed)
    out: dict[str, int] = {}
    for label, stems in ((1, BLOCKED_STEMS), (0, ALLOWED_STEMS)):
        for stem in stems:
            for k in range(10):
                other = str(rng.choice(MODIFIERS if k < 8 else stems))
                parts = [stem, other] if rng.integers(0, 2) else [other, stem]
                out[str(rng.choice(["-", "", ""])).join(parts if k else [stem])] = label
    for _ in range(INVENTED):
        # Neutral names: letters drawn alone, in pairs of consonant and vowel, or pairs doubled.
        syllables = ["".join(rng.choice(list(pool)) for pool in ("bcdfghjklmnprstvwz", "aeiou", "nrst")[: rng.integers(1, 4)]) for _ in range(rng.integers(2, 6))]
        name = "".join(syllables) if rng.integers(0, 3) else "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(4, 11)))
        out.setdefault(name, 0)
    return list(out.items())


def labelled_urls(seed: int = SEED, held: bool = False) -> list[tuple[str, str, int]]:
    """(host, path, label) of the small labelled table, 1 for block: the sites that train, or those held back."""
    out = []
    for i, (site, label) in enumerate(labelled_sites(seed)):
        if (zlib.crc32(site.encode()) % HELD == 0) is held:
            for j, p in enumerate(PREFIXES):
                end = ENDINGS[(i + j) % len(ENDINGS)]
                out.append((f"{p}{site}.{end}", PAGES[(i + j) % len(PAGES)], label))
                if label == 0 and (i + j) % 4 == 0:
                    out.append((f"{p}{site}.{end}", BLOCKED_PAGES[(i + j) % len(BLOCKED_PAGES)], 1))
    return out


class UrlModel:
    """Additive score: bias, n-grams of the host, n-grams of the path."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def part(self, kind: str, s: str) -> float:
        ids = np.unique(_grams(kind, s))
        return float(self.weights[ids].sum() / np.sqrt(len(ids))) if len(ids) else 0.0

    def score(self, host: str, path: str) -> float:
        z = self.bias + self.part("h", host) + self.part("p", path)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@lru_cache(maxsize=2)
def train(rounds: int = 30, rate: float = 0.5, decay: float = 1e-4, seed: int = SEED) -> UrlModel:
    rows = labelled_urls(seed)
    ids = [[np.unique(_grams("h", h)), np.unique(_grams("p", p))] for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    w, bias = np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        for i in rng.permutation(len(rows)):
            z = bias + sum(w[g].sum() / np.sqrt(len(g)) for g in ids[i] if len(g))
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            step = rate / (1 + r / 10)
            bias -= 0.1 * step * d
            for g in ids[i]:
                if len(g):
                    w[g] -= step * (d / np.sqrt(len(g)) + decay * w[g])
    return UrlModel(w, bias)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, model: UrlModel | None = None, cutoff: float = 0.5) -> DataFrame:
    """page_id, host, path, the rule that fits (null: none), verdict and the model's score.

    A rule decides where one fits, else the model: block at ``cutoff`` or more.
    Null urls and urls without ``://`` have an empty host and path and are
    judged like any other. Repeated rows are judged each; empty input gives no
    rows; extra columns are dropped.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    out = "page_id long, host string, path string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hosts = shared.value, {}
        for b in batches:
            parts = [host_and_path(u) for u in b.column(1).to_pylist()]
            scores = []
            for host, path in parts:
                if host not in hosts:
                    if len(hosts) > 100_000:
                        hosts.clear()
                    hosts[host] = m.part("h", host)
                z = m.bias + hosts[host] + m.part("p", path)
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            cols = [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "score"])

    judged = pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, out)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= cutoff, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(F.col("host"), F.col("path"), r)
        rule = F.when(fits, r[1] + r[2]).otherwise(rule)
        verdict = F.when(fits, r[0]).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")
