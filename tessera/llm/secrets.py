"""Secret scans: fixed rules, and a character convolutional network over every candidate token.

The network reads a window of characters (context, token, context) and is
trained on the driver from labelled findings made by a seeded generator. Its
scores are calibrated, and for every class of token the threshold is the
highest that keeps a set recall on findings held back from training.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed patterns and least lengths of the base rules.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "model")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Runs of these characters, of this length at least, are candidates unless they are plain words (see ``candidates``).
TOKEN_CHARS = string.ascii_letters + string.digits + "+/_.=-"
MIN_CANDIDATE = 8
#: From this length on a plain word is a candidate too.
LONG_WORD = 20
#: Classes of tokens, each with its own threshold.
CLASSES = ("numeric", "word", "hex", "plain", "marked")
CONTEXT, HEAD, TAIL = 24, 32, 16
LENGTH = 2 * CONTEXT + HEAD + TAIL
EMBED, WIDTH, FILTERS = 10, 5, 24
RECALL = 0.97
TRAIN_FINDINGS = 6000
#: Held-back secrets that a class needs for a threshold of its own.
LEAST_HELD = 20
SEED = 11
_ASSIGN_STEMS = (b"passw", b"secret", b"token", b"api")
#: Most texts scored against the network at once.
_BATCH = 512


def _spans(pattern: re.Pattern, text: str, least: int, group: int = 0) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if len(m[group]) >= least]


_SORT = np.zeros(129, np.int8)
_SORT[[ord(c) for c in "/.-"]] = 1
_SORT[[ord(c) for c in "+_="]] = 2
_SORT[[ord(c) for c in string.ascii_lowercase]] = 3
_SORT[[ord(c) for c in string.ascii_uppercase]] = 4
_SORT[[ord(c) for c in string.digits]] = 5


def token_runs(text: str) -> tuple[list[tuple[int, int]], list[bool]]:
    """Maximal runs of token characters of candidate length (code points, end exclusive), and which are candidates.

    A candidate holds a digit, or one of ``+ _ =`` between letters, or a capital behind a
    small letter, or is longer than words are. What is left out are plain words,
    capitalised or not, with hyphens, dots and slashes.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sort = np.zeros(len(codes) + 2, np.int8)
    sort[1:-1] = _SORT[np.minimum(codes, 128)]
    edge = np.flatnonzero((sort[1:] > 0) != (sort[:-1] > 0))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= MIN_CANDIDATE]
    if not len(runs):
        return [], []
    sort = sort[1:-1]
    mark = sort == 5
    mark[1:] |= (sort[1:] == 4) & (sort[:-1] == 3)
    mark[1:-1] |= (sort[1:-1] == 2) & (sort[:-2] > 2) & (sort[2:] > 2)
    upto = np.concatenate([[0], np.cumsum(mark)])
    odd = (upto[runs[:, 1]] > upto[runs[:, 0]]) | (runs[:, 1] - runs[:, 0] >= LONG_WORD)
    return [tuple(r) for r in runs.tolist()], odd.tolist()


def token_class(token: str) -> int:
    """Index in CLASSES."""
    letters = [c for c in token if c.isalpha()]
    if not letters:
        return 0
    if not any(c in string.digits for c in token):
        return 1
    if all(c in "0123456789abcdef" or c in "+/_.=-" for c in token):
        return 2
    return 4 if any(c in "+/_.=-" for c in token.strip("+/_.=-")) else 3


def base_findings(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed rules, leftmost and non-overlapping within each kind."""
    runs = token_runs(text)[0] if runs is None else runs
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(s in low for s in _ASSIGN_STEMS):
        found += [(a, z, "assign") for a, z in _spans(re.compile(ASSIGN, re.I | re.A), text, MIN_ASSIGN, 2)]
    if "AKIA" in text:
        found += [(a, z, "access") for a, z in _spans(re.compile(ACCESS), text, MIN_ACCESS)]
    for a, z in runs:  # every long hexadecimal run lies in a token run
        if z - a >= MIN_HEX:
            found += [(a + x, a + y, "hex") for x, y in _spans(re.compile(HEX), text[a:z], MIN_HEX)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping parts of a run, which together hold all of it; a run that fits the network is its only part."""
    size = HEAD + TAIL
    if end - start <= size:
        return [(start, end)]
    return [(a, a + size) for a in (*range(start, end - size, TAIL), end - size)]


def parts(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """What the network reads of a run: all of it and, where it does not fit, its windows and its parts between separators.

    The windows have the context of the run: the network knows tokens in prose, and takes
    letters on both sides for a part of a key.
    """
    yield encode(text, start, end)
    if end - start > HEAD + TAIL:
        yield from (encode(text, x, y, (start, end)) for x, y in windows(start, end))
        for m in re.finditer(r"[^/.=]+", text[start:end]):
            if m.end() - m.start() >= MIN_CANDIDATE:
                yield from (encode(text, x, y) for x, y in windows(start + m.start(), start + m.end()))


def encode(text: str, start: int, end: int, around: tuple[int, int] | None = None) -> np.ndarray:
    """Character classes of the window: 0 padding, 1 other, 2.. printable ASCII; a token longer than its place shows head and tail.

    The context is that of the span ``around``, of the token itself by default.
    """
    first, last = around or (start, end)
    token = text[start:end]
    if len(token) > HEAD + TAIL:
        token = token[:HEAD] + token[-TAIL:]
    left, right = text[max(0, first - CONTEXT) : first], text[last : last + CONTEXT]
    row = np.zeros(LENGTH, np.int64)

    def put(s: str, at: int) -> None:
        row[at : at + len(s)] = [ord(c) - 30 if " " <= c <= "~" else 1 for c in s]

    put(left, CONTEXT - len(left))
    put(token, CONTEXT)
    put(right, LENGTH - CONTEXT)
    return row


@dataclass
class Net:
    embed: np.ndarray  # (97, EMBED)
    kernel: np.ndarray  # (WIDTH * (EMBED + 1), FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS,)
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(CLASSES), 0.5))

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = len(rows)
        mark = np.zeros((n, LENGTH, 1), np.float32)
        mark[:, CONTEXT : LENGTH - CONTEXT] = (rows[:, CONTEXT : LENGTH - CONTEXT] > 0)[..., None]
        x = np.concatenate([self.embed[rows], mark], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)  # n, L', E+1, W
        flat = view.transpose(0, 1, 3, 2).reshape(n, LENGTH - WIDTH + 1, -1)
        conv = np.maximum(flat @ self.kernel + self.bias, 0)
        top, mean = conv.argmax(axis=1), conv.mean(axis=1)
        pooled = np.concatenate([conv.max(axis=1), mean], axis=1)
        return pooled @ self.out + self.out_bias[0], (flat, conv, top, pooled)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if not len(rows):
            return np.zeros(0)
        logits = np.concatenate([self.forward(rows[i : i + _BATCH])[0] for i in range(0, len(rows), _BATCH)])
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): invented secrets, and tokens that only look like one."""
    rng = np.random.default_rng(seed)
    letters = np.array(list(string.ascii_lowercase))
    pools = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", "0123456789abcdef", string.ascii_uppercase + string.digits]
    lead = ["key ", "key: ", "auth ", "Bearer ", "credential=", "pwd: ", "access key ", "private ", "Authorization: ", "signature ", "", "", "secret ", "token "]
    prefixes = ["sk_live_", "ghx_", "xox-", "pk-", "", "", "", "", "eyJ"]
    strong = lead[:10] + ["password ", "login ", "api-key ", "client_secret ", "pass ", "auth_token "]

    def draw(pool: str, k: int) -> str:
        return "".join(rng.choice(list(pool), k))

    def word() -> str:
        return "".join(rng.choice(letters, rng.integers(2, 9)))

    def prose() -> str:
        ends = ["", "!!", "###", ".", " |"][rng.choice(5, p=[0.8, 0.05, 0.05, 0.05, 0.05])]
        words = [word() + ends for _ in range(rng.integers(2, 7))]
        return " ".join(w.upper() if ends == "!!" else w for w in words)

    def digits(k: int) -> str:
        return draw(string.digits, k)

    def camel() -> str:
        return word() + "".join(word().capitalize() for _ in range(rng.integers(1, 4)))

    def harmless() -> str:
        return str(
            [
                lambda: digits(int(rng.integers(8, 24))),
                lambda: f"{word()}.{word()}.{digits(2)}-{word()}{word()}.com",
                lambda: f"{digits(4)}-{digits(2)}-{digits(2)}_{digits(2)}.{digits(2)}.{digits(2)}",
                lambda: f"/{word()}/{word()}/{word()}{digits(1)}/{word()}.html",
                lambda: "=" * int(rng.integers(12, 30)) + digits(int(rng.integers(4, 6))),
                lambda: f"{word()}-{word()}-{word()}-{digits(4)}{word()}",
                lambda: ".".join(digits(int(rng.integers(1, 4))) for _ in range(rng.integers(4, 8))),
                lambda: f"{word()}{word()}{word()}{word()}{word()}{digits(1)}.",
                lambda: f"+{digits(2)}-{digits(3)}-{digits(4)}-{digits(6)}",
                lambda: f"{digits(3)}-{digits(4)}",
                lambda: f"{word()}{digits(int(rng.integers(1, 3)))}.{word()}.{rng.choice(['com', 'org', 'net'])}",
                lambda: f"{word()}.{digits(2)}",
                lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
                lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}-{word()}{digits(1)}",
                camel,
                lambda: f"{word()}_{word()}_{word()}",
                lambda: f"{word()}_{word()}.{word()[:3]}",
                lambda: f"{word()}{word()}{word()}{word()}{word()}{word()}",
                lambda: f"{word()}-{word()}-{word()}-{word()}-{word()}".upper(),
                lambda: f"{word().capitalize()}{word()}{digits(int(rng.integers(1, 5)))}",
                lambda: "-" * int(rng.integers(8, 40)),
                lambda: f"{word()}/{word()}/{word()}={digits(2)}",
                lambda: f"{word().upper()}-{digits(3)}.{digits(2)}",
            ][rng.integers(0, 23)]()
        )

    out = []
    while len(out) < n:
        label = int(len(out) % 2 == 0)
        if label:
            prefix, size = str(rng.choice(prefixes)), int(rng.integers(10, 64))
            # Without a telling prefix a short secret needs telling words before it.
            before = f"{prose()} {rng.choice(lead if size >= 20 or prefix else strong)}"
            token = prefix + draw(str(rng.choice(pools)), size)
            if size >= 20:  # some stand in a longer run
                inside = [token] * 8 + [f"{token}.{word()}={word()}{digits(2)}", f"/{word()}/{word()}/{token}/{word()}.{word()}"]
                token = str(rng.choice(inside))
        else:
            before, token = f"{prose()} {rng.choice([*[''] * 9, 'key ', 'see ', 'at '])}", harmless()
        quote = str(rng.choice(["", "", '"', "'"]))
        text = f"{before}{quote}{token}{quote} {prose()}"
        start = len(before) + len(quote)
        if len(token) >= MIN_CANDIDATE:
            out.append((text, start, start + len(token), label))
    return out


@lru_cache(maxsize=4)
def train(n: int = TRAIN_FINDINGS, seed: int = SEED, recall: float = RECALL) -> Net:
    """Fit on four fifths of ``n`` labelled findings; calibrate and set the thresholds on the rest."""
    rows = labelled_findings(n, seed)
    x = np.array([encode(t, a, z) for t, a, z, _ in rows])
    y = np.array([r[3] for r in rows], np.float32)
    held = np.arange(n) % 10 >= 8
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.3, (97, EMBED)).astype(np.float32),
        rng.normal(0, 0.15, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )
    params = [net.embed, net.kernel, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    where = np.flatnonzero(~held)
    for _ in range(8):
        rng.shuffle(where)
        for i in range(0, len(where), 64):
            b = where[i : i + 64]
            logit, (flat, conv, top, pooled) = net.forward(x[b])
            d = (1 / (1 + np.exp(-logit)) - y[b]).astype(np.float32) / len(b)
            g_out, g_ob = pooled.T @ d, np.array([d.sum()], np.float32)
            d_pool = d[:, None] * net.out[None]
            d_conv = np.repeat((d_pool[:, FILTERS:] / conv.shape[1])[:, None], conv.shape[1], axis=1)
            np.put_along_axis(d_conv, top[:, None], np.take_along_axis(d_conv, top[:, None], 1) + d_pool[:, None, :FILTERS], 1)
            d_conv *= conv > 0
            g_k = np.tensordot(flat, d_conv, axes=([0, 1], [0, 1]))
            d_x = (d_conv @ net.kernel.T).reshape(len(b), conv.shape[1], WIDTH, EMBED + 1)[..., :EMBED]
            g_e = np.zeros_like(net.embed)
            for w in range(WIDTH):
                np.add.at(g_e, x[b][:, w : w + conv.shape[1]], d_x[:, :, w])
            grads = [g_e, g_k, d_conv.sum(axis=(0, 1)), g_out, g_ob]
            step += 1
            for p, g, a, c in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    logits = net.forward(x[held])[0].astype(float)
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(net.scale * logits + net.shift, -30, 30)))
        net.scale -= 0.1 * float(np.mean((p - y[held]) * logits))
        net.shift -= 0.1 * float(np.mean(p - y[held]))
    scores = net.scores(x[held])
    sort = np.array([token_class(t[a:z]) for t, a, z, _ in rows])[held]
    for c in range(len(CLASSES)):
        mine = (y[held] == 1) & (sort == c)
        if not any(r[3] and token_class(r[0][r[1] : r[2]]) == c for r in rows):
            net.thresholds[c] = math.inf  # no labelled finding of this class is a secret
            continue
        positive = np.sort(scores[mine if mine.sum() >= LEAST_HELD else y[held] == 1])
        net.thresholds[c] = min(0.9, positive[int((1 - recall) * len(positive))])
    return net


def scan(text: str, net: Net) -> list[tuple[int, int, str]]:
    """All findings of one text: the base rules' and, where these do not cover the whole run, the network's."""
    return scan_many([text], net)[0]


def _covered(start: int, end: int, spans: list) -> bool:
    """Whether the spans, in order of their starts, hold all of start to end."""
    for a, z, _ in spans:
        if a > start:
            break
        start = max(start, z)
    return start >= end


def scan_many(texts: list[str], net: Net) -> list[list[tuple[int, int, str]]]:
    """The findings of every text. A run is marked by the highest score of its ``parts``."""
    found, rows, owner = [], [], []
    best: dict[tuple[int, int, int], float] = {}

    def score() -> None:
        for k, p in zip(owner, net.scores(np.array(rows)) if rows else (), strict=True):
            best[k] = max(best.get(k, 0.0), float(p))
        rows.clear()
        owner.clear()

    for i, text in enumerate(texts):
        runs, odd = token_runs(text)
        found.append(base_findings(text, runs))
        for (a, z), candidate in zip(runs, odd, strict=True):
            if not candidate or _covered(a, z, found[i]):
                continue
            for row in parts(text, a, z):
                rows.append(row)
                owner.append((i, a, z))
                if len(rows) >= 8 * _BATCH:
                    score()
    score()
    for (i, a, z), p in best.items():
        if p >= net.thresholds[token_class(texts[i][a:z])]:
            found[i].append((a, z, "model"))
    for f in found:
        f.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def find_secrets(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id and ``findings``, an array of (start, end, kind) in code points of the whole text.

    Null text counts as empty. Ids may be null or repeated: every row is
    scanned on its own. Findings may overlap; they come by start, then by kind
    in the order of KINDS. Empty input gives no rows; extra columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [[{"start": a, "end": z, "kind": k} for a, z, k in f] for f in scan_many(texts, shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "findings"])

    out = "doc_id long, findings array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def redact(docs: DataFrame, mark: str = "[secret]", net: Net | None = None) -> DataFrame:
    """The same rows and columns with every finding in ``text`` replaced by ``mark``.

    Findings that overlap share one mark. Null and empty texts stay as they
    are, repeated rows are treated alike, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or train())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            clean = []
            for text, found in zip(texts, scan_many([t or "" for t in texts], shared.value), strict=True):
                if text is not None and found:
                    parts, upto = [], 0
                    for a, z, _ in found:
                        if a >= upto:
                            parts += [text[upto:a], mark]
                        elif z <= upto:
                            continue
                        upto = max(upto, z)
                    text = "".join(parts) + text[upto:]
                clean.append(text)
            cols = list(b.columns)
            cols[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans, kinds: tuple[str, ...] | None = None):
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in KINDS[:3]]
    base = F.sha2(_joined(F.col("findings"), KINDS[:3]).cast("binary"), 256)
    return found.select("doc_id", *n, base.alias("base_sha256"), _joined(F.col("findings")).alias("spans"))
