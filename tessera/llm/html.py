"""Main-text extraction: flat text blocks, judged by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its
word count and link density and those of its neighbours, by what kind of block
it is, and by raw marks of its open elements. None of these marks decides
alone: the labelled table holds pages whose article has no element of its own
and pages whose boilerplate has no telling name. The tree is grown here on
that small table, pages written out as html and read like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed element groups.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NESTING = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
HIDDEN = frozenset("button canvas head iframe noscript object option script select style svg template textarea title video audio datalist math".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BOILER = frozenset("aside dialog footer form menu nav".split())
MAIN = frozenset("article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus respond replies reply discussion sidebar widget widgets menu nav navbar navigation topbar breadcrumb breadcrumbs footer footnav related recommended recommendations pagination pager login search copyright toolbar teaser".split()
)
#: Hints that do not count inside the article itself, where they name its own parts.
OUTER_HINTS = frozenset("header masthead top bottom".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = ("words", "words_before", "words_after", "links", "links_before", "links_after", "kind", "kind_before", "kind_after", "landmark", "hint", "inside", "marked_page")
TRAIN_PAGES = 400
#: Kinds of blocks by the tag that opened them; anything else is 0.
KINDS = {**dict.fromkeys(("p", "blockquote", "pre"), 1), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2), **dict.fromkeys(("li", "dt", "dd"), 3), **dict.fromkeys(("td", "th", "caption"), 4)}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    kind: int
    landmark: bool
    hint: bool
    inside: bool


def _attributes(raw: str, inside: bool) -> tuple[bool, bool]:
    """(the element's name or role is one that boilerplate often has, the element is hidden)."""
    hint = hidden = False
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            hint |= value.lower() in ROLES
        elif name in ("class", "id"):
            words = {w.lower() for w in _PIECES.findall(value)}
            hint |= bool(words & HINTS) or (not inside and bool(words & OUTER_HINTS))
    return hint, hidden


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed and stray tags are tolerated."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []  # tag, (landmark, hint, inside the article, hidden)
    parts: list[str] = []
    linked = kind = 0
    link = False
    hide: str | None = None  # the innermost open element that shows nothing
    state = outer = (False, False, False, False)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not state[3]:
                out.append(Block(text, text.count(" ") + 1, linked, kind, *state[:3]))
            parts.clear()
            linked = 0

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        chunk = html[at : m.start()] if m else html[at:]
        if chunk and hide is None:
            text = unescape(chunk)
            parts.append(text)
            if link:
                linked += len(text.split())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if hide is not None:
            if closing and tag == hide:
                hide = None
            continue
        if tag in HIDDEN:
            if not closing and not (m[3] or "").endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                    at = end.start() if end else len(html)
                hide = tag
            continue
        if tag == "a":
            link = not closing
            continue
        if tag in ("br", "img", "wbr", "input"):
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        link = False
        kind = 0 if closing else KINDS.get(tag, 0)
        hint, hidden = _attributes(m[3], outer[2]) if not closing and m[3] else (False, False)
        if tag in NESTING:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif not m[3].endswith("/"):
                first = tag in MAIN and not outer[2]
                landmark = outer[0] or tag in BOILER or (tag == "header" and not outer[2])
                stack.append((tag, (landmark, hint or outer[1], outer[2] or first, hidden or outer[3])))
            state = outer = stack[-1][1] if stack else (False, False, False, False)
        else:  # a marked paragraph or heading: it ends at the next block boundary
            state = (outer[0], outer[1] or hint, outer[2], outer[3] or hidden)
    flush()
    return out


def describe(page: list[Block]) -> np.ndarray:
    """One feature row per block, see FEATURES; there is an empty block before the first and after the last."""
    n = len(page)
    words = np.array([0, *(b.words for b in page), 0], float)
    links = np.array([0, *(min(1.0, b.linked / b.words) for b in page), 0], float)
    kinds = np.array([0, *(b.kind for b in page), 0], float)
    flags = np.array([(b.landmark, b.hint, b.inside, any(x.inside for x in page)) for b in page], float).reshape(n, 4) if n else np.zeros((0, 4))
    around = [c[k : k + n] for c in (words, links, kinds) for k in (1, 0, 2)]
    return np.column_stack([*around, flags])


# What the labelled pages are made of (fixed values).
_NAMES = "ad cookie-notice newsletter share-bar sidebar comments related promo subscribe banner".split()
_NEUTRAL = "box row c1 wrap inner col unit x7 block part".split()


def labelled_page(rng: np.random.Generator, article: str | None = None, named: float | None = None, landmarks: float | None = None) -> tuple[str, set[str]]:
    """An invented page and the texts of its main blocks.

    ``article`` is the element around the main text ("" for none); ``named`` and
    ``landmarks`` are the shares of boilerplate with a telling class name or in
    an element made for it. Left open, they are drawn for the page.
    """
    article = str(rng.choice(["article", "main", "div", "", "article"])) if article is None else article
    named = float(rng.choice([0, 0.5, 1])) if named is None else named
    landmarks = float(rng.choice([0, 0.5, 1])) if landmarks is None else landmarks
    main: set[str] = set()
    count = 0

    def words(lo: int, hi: int) -> str:
        nonlocal count
        count += 1
        return " ".join([f"w{count}"] + ["lorem"] * (int(rng.integers(lo, hi)) - 1))

    def around(tag: str, inner: str) -> str:
        own = tag if rng.random() < landmarks else "div"
        name = str(rng.choice(_NAMES)) if rng.random() < named else str(rng.choice(_NEUTRAL))
        return f'<{own} class="{name}">{inner}</{own}>' if own == "div" or rng.integers(0, 2) else f"<{own}>{inner}</{own}>"

    def links(lo: int, hi: int) -> str:
        items = [f'<a href="/{k}">{words(1, 4)}</a>' for k in range(rng.integers(lo, hi))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.integers(0, 3) else "<p>" + " | ".join(items) + "</p>"

    def aside() -> str:
        """Boilerplate with running text: a notice, an advert, a reader's comment, a form."""
        tag = str(rng.choice(["aside", "form", "div", "aside"]))
        text = words(3, 60)
        if rng.integers(0, 2):
            text += f' <a href="/more">{words(2, 12)}</a>'
        return around(tag, text if rng.integers(0, 2) else f"<p>{text}</p>")

    def content() -> str:
        # Without an element of its own main text is told by its length and its neighbours alone.
        short = article in ("article", "main")
        parts = [f"<h1>{words(3, 14)}</h1>"] if rng.integers(0, 3) else []
        tag = str(rng.choice(["p", "p", "p", "div", "td", "blockquote", ""] if short else ["p", "p", "div"]))
        for _ in range(rng.integers(2, 9)):
            text = words(*((1, 140) if short else (25, 140)))
            if rng.integers(0, 4) == 0:
                text += f' <a href="/x">{words(1, 4)}</a>' if len(text) > 120 else ""
            parts.append(f"<{tag}>{text}</{tag}>" if tag else f"<section>{text}</section>")
            if rng.integers(0, 7) == 0:
                parts.append(f"<h2>{words(2, 9)}</h2>")
        if short and rng.integers(0, 4) == 0:
            parts.append("<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(3)) + "</ul>")
        main.update(b.text for b in blocks("".join(parts)))
        if rng.integers(0, 3) == 0:  # boilerplate among the paragraphs, which only shows by a mark
            own = str(rng.choice(["aside", "form", "nav"]))
            inner = f"<p>{words(3, 40)}</p>"
            at = int(rng.integers(1, len(parts) + 1))
            parts.insert(at, f"<{own}>{inner}</{own}>" if rng.integers(0, 2) or not short else f'<div class="{rng.choice(_NAMES)}">{inner}</div>')
        body = "".join(parts)
        return f"<{article}>{body}</{article}>" if article else body

    before = [around("nav", links(2, 9))] + [aside() for _ in range(rng.integers(0, 2))]
    if rng.integers(0, 6) == 0:
        before = []
    elif rng.integers(0, 2):
        before.insert(0, around("header", f'<a href="/">{words(1, 4)}</a>'))
    marked = article in ("article", "main")
    after = [aside() if marked or rng.integers(0, 2) else around("aside", links(3, 8)) for _ in range(rng.integers(0, 4))]
    after.append(around("footer", f"&copy; {words(2, 40 if marked else 12)}" if rng.integers(0, 2) else links(2, 6)))
    if rng.integers(0, 4) == 0:
        after = []
    return "<html><body>" + "".join([*before, content(), *after]) + "</body></html>", main


def labelled_blocks(n: int = TRAIN_PAGES, seed: int = 7, **made) -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: the blocks of ``n`` invented pages, 1 for main text."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(n):
        page, main = labelled_page(rng, **made)
        found = blocks(page)
        rows.append(describe(found))
        labels += [int(b.text in main) for b in found]
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3):
    """A Gini tree: (feature, cut, low side, high side), or a leaf's share of main text."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows on the low side of every cut
        k = k[(k >= least) & (len(y) - k >= least)]
        if not len(k):
            continue
        a, b = hits[k - 1] / k, (hits[-1] - hits[k - 1]) / (len(y) - k)
        loss = 2 * a * (1 - a) * k + 2 * b * (1 - b) * (len(y) - k)
        i = int(loss.argmin())
        if loss[i] < best[0]:
            best = (float(loss[i]), f, float((v[k[i]] + v[k[i] - 1]) / 2))
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(maxsize=2)
def train():
    return grow(*labelled_blocks())


def is_main(tree, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(html: str, tree=None) -> str:
    """The blocks judged main text, joined by line feeds."""
    page = blocks(html)
    if not page:
        return ""
    tree = tree if tree is not None else train()
    return "\n".join(b.text for b, row in zip(page, describe(page), strict=True) if is_main(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page.

    Null html counts as empty. Whole pages are read, broken markup and cut-off
    ends included. Repeated rows are extracted each; empty input gives no
    rows; extra columns are dropped.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "", tree) for h in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
