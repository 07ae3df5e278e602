"""The expression language: a tree over feature columns, compiled to staged window plans.

A tree alternates between operators along time (partitioned by symbol) and
across names (partitioned by session). The compiler numbers every distinct
sub-tree, puts it on the first level where its inputs are ready, and emits one
projection a level, so equal sub-trees of a whole population are computed once
and all operators of a level share their exchange.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np

from tessera.functions import series as S
from tessera.plans.sql import Chain

WINDOWS = (5, 10, 21, 63, 126)
UNARY = ("neg", "abs", "sign", "log1p", "sigmoid", "square", "sqrt_abs")
CROSS = ("rank", "zscore", "demean")
TIMED = ("delta", "tsmean", "tsstd", "tsrank")
BINARY = ("add", "sub", "mul", "div", "min", "max")
BIG = "1e12"


@dataclass(frozen=True)
class Node:
    """``op`` is feat, const, a unary or timed or binary operator, or ite."""

    op: str
    args: tuple[Node, ...] = ()
    name: str = ""
    value: float = 0.0
    window: int = 0

    def size(self) -> int:
        return 1 + sum(a.size() for a in self.args)

    def depth(self) -> int:
        return 1 + max((a.depth() for a in self.args), default=0)

    def features(self) -> set[str]:
        own = {self.name} if self.op == "feat" else set()
        return own.union(*(a.features() for a in self.args)) if self.args else own

    def canonical(self) -> str:
        if self.op == "feat":
            return self.name
        if self.op == "const":
            return f"{self.value:.6g}"
        w = f"_{self.window}" if self.window else ""
        return f"{self.op}{w}({','.join(a.canonical() for a in self.args)})"

    def fingerprint(self) -> str:
        return hashlib.sha1(self.canonical().encode()).hexdigest()[:16]

    def to_dict(self) -> dict:
        out: dict = {"op": self.op}
        if self.op == "feat":
            out["name"] = self.name
        elif self.op == "const":
            out["value"] = self.value
        if self.window:
            out["window"] = self.window
        if self.args:
            out["args"] = [a.to_dict() for a in self.args]
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)


def feat(name: str) -> Node:
    return Node("feat", name=name)


def const(value: float) -> Node:
    return Node("const", value=float(value))


def un(op: str, x: Node, window: int = 0) -> Node:
    return Node(op, (x,), window=window)


def bi(op: str, a: Node, b: Node) -> Node:
    return Node(op, (a, b))


def ite(c: Node, a: Node, b: Node) -> Node:
    return Node("ite", (c, a, b))


def from_dict(d: dict) -> Node:
    op = d["op"]
    if op not in {"feat", "const", "ite", *UNARY, *CROSS, *TIMED, *BINARY}:
        raise ValueError(f"unknown operator {op!r}")
    return Node(op, tuple(from_dict(a) for a in d.get("args", ())), d.get("name", ""), float(d.get("value", 0.0)), int(d.get("window", 0)))


# ---- rewriting ---------------------------------------------------------------

_CONST = {
    "neg": lambda v: -v,
    "abs": abs,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: max(-1e12, min(1e12, a * b)),
    "min": min,
    "max": max,
}


def simplify(n: Node) -> Node:
    """An equal, smaller tree. Rewrites that would invent a value for a missing input are left out."""
    args = tuple(simplify(a) for a in n.args)
    n = replace(n, args=args) if args else n
    if args and all(a.op == "const" for a in args):
        if n.op in _CONST:
            return const(_CONST[n.op](*(a.value for a in args)))
        if n.op == "div" and abs(args[1].value) >= 1e-12:
            return const(args[0].value / args[1].value)
    if n.op == "neg" and args[0].op == "neg":
        return args[0].args[0]
    if n.op in ("abs", "sign", *CROSS) and args[0].op == n.op:
        return args[0]
    if n.op == "abs" and args[0].op == "neg":
        return simplify(un("abs", args[0].args[0]))
    if n.op in ("zscore", "demean") and args[0].op == "const":
        return const(0.0)
    if n.op == "ite":
        if args[0].op == "const":
            return args[1] if args[0].value > 0 else args[2]
        if args[1] == args[2]:
            return args[1]
    return n


# ---- compiling -----------------------------------------------------------------


def _window_key(op: str) -> str:
    return "time" if op in TIMED else "cross" if op in CROSS else ""


def render(n: Node, c: Chain, args: list[str]) -> str:
    """One operator over its rendered inputs."""
    x = args[0] if args else ""
    w = n.window
    mask = f"case when tradable then {x} end"
    frame = S.trailing(w) if w else ""
    match n.op:
        case "feat":
            return n.name
        case "const":
            return f"cast({n.value!r} as double)"
        case "neg":
            return f"(-({x}))"
        case "abs":
            return f"abs({x})"
        case "sign":
            return f"cast(sign({x}) as double)"
        case "log1p":
            return f"(ln(1 + abs({x})) * sign({x}))"
        case "sigmoid":
            return f"(1 / (1 + exp(-({S.clip(x, '-30', '30')}))))"
        case "square":
            return f"({S.clip(f'({x}) * ({x})', f'-{BIG}', BIG)})"
        case "sqrt_abs":
            return f"(sqrt(abs({x})) * sign({x}))"
        case "rank":
            return S.cs_rank(f"round({mask}, 9)")
        case "zscore":
            return S.cs_zscore(mask)
        case "demean":
            return S.cs_demean(mask)
        case "delta":
            return f"(({x}) - {S.shift(x, w)})"
        case "tsmean":
            return S.roll_mean(x, w)
        case "tsstd":
            return S.roll_std(x, w)
        case "tsrank":
            n_ = f"count({x}) over {frame}"
            return f"(case when {n_} > 1 then {c.d.count_below(f'round({x}, 9)', frame)} / nullif({n_} - 1e0, 0) end)"
        case "add" | "sub":
            return f"(({x}) {'+' if n.op == 'add' else '-'} ({args[1]}))"
        case "mul":
            return f"({S.clip(f'({x}) * ({args[1]})', f'-{BIG}', BIG)})"
        case "div":
            return f"(({x}) / (case when abs({args[1]}) >= 1e-12 then {args[1]} end))"
        case "min":
            return f"least({x}, {args[1]})"
        case "max":
            return f"greatest({x}, {args[1]})"
        case "ite":
            return f"(case when ({x}) > 0 then {args[1]} else {args[2]} end)"
    raise ValueError(f"unknown operator {n.op!r}")


def compile_population(c: Chain, frm: str, trees: dict[str, Node], name: str = "scored") -> str:
    """Relation ``name``: ``frm`` with one score column per tree, missing where not tradable."""
    level: dict[str, int] = {}
    nodes: dict[str, Node] = {}

    def place(n: Node) -> int:
        key = n.canonical()
        if key not in level:
            below = max((place(a) for a in n.args), default=0)
            inner = any(_window_key(a.op) or level[a.canonical()] for a in n.args)
            level[key] = below + 1 if _window_key(n.op) or (inner and below) else below
            nodes[key] = n
            if _window_key(n.op) and not below:
                level[key] = 1
        return level[key]

    trees = {k: simplify(t) for k, t in trees.items()}
    for t in trees.values():
        place(t)
    stored: dict[str, str] = {}

    def text(n: Node, at: int) -> str:
        key = n.canonical()
        if key in stored and level[key] < at:
            return stored[key]
        return render(n, c, [text(a, at) for a in n.args])

    used = {"symbol", "t_idx", "tradable"}.union(*(t.features() for t in trees.values()))
    top = max(level.values(), default=0) + 1
    texts: list[list[str]] = []
    for at in range(1, top):
        here = [n for key, n in nodes.items() if level[key] == at]
        texts.append([f"{text(n, at)} as e_{n.fingerprint()}" for n in here])
        stored.update({n.canonical(): f"e_{n.fingerprint()}" for n in here})
    scores = [f"case when tradable then {text(t, top)} end as {k}" for k, t in trees.items()]
    # Every level passes on only what some later one reads.
    last, ready = frm, sorted(used)
    for at, cols in enumerate(texts, 1):
        later = " ".join(x for part in [*texts[at:], scores] for x in part)
        read = set(re.findall(r"\w+", later)) | {"symbol", "t_idx", "tradable"}
        ready = [x for x in ready if x in read]
        c.add(f"{name}_l{at}", f"select {', '.join([*ready, *cols])} from {last}")
        ready += [col.rsplit(" as ", 1)[1] for col in cols]
        last = f"{name}_l{at}"
    c.add(f"{name}_raw", f"select symbol, t_idx, tradable, {', '.join(scores)} from {last}")
    # What is no finite number is missing, here as everywhere (both engines sort NaN above all).
    c.add(name, f"select symbol, t_idx, tradable, {', '.join(f'case when abs({k}) <= 1e300 then {k} end as {k}' for k in trees)} from {name}_raw")
    return name


# ---- random trees and edits ------------------------------------------------------


#: Operators by shape: their inputs, and how often the shape is drawn relative to the others.
SHAPES = {"pointwise": (UNARY, 1, 3), "across": (CROSS, 1, 4), "timed": (TIMED, 1, 3), "pair": (BINARY, 2, 6), "choice": (("ite",), 3, 1)}
#: One leaf in so many is a number.
CONSTANTS = 10


class Grammar:
    """Draws and edits trees over given features; every draw comes from the generator passed in.

    A tree is drawn by size: a budget of nodes is dealt out from the root down,
    so sizes are spread evenly and no branch is starved by the depth of another.
    """

    def __init__(self, features: Iterable[str], max_depth: int = 5, max_size: int = 24) -> None:
        self.features = tuple(features)
        self.max_depth = max_depth
        self.max_size = max_size
        self.odds: np.ndarray | None = None

    def weigh(self, weights: dict[str, float], family_of: Callable[[str], str]) -> None:
        """From now on draw features by their family's weight; a family without one weighs 1, and none is ever ruled out."""
        w = np.array([max(weights.get(family_of(f), 1.0), 1e-6) for f in self.features])
        self.odds = w / w.sum()

    def terminal(self, rng: np.random.Generator) -> Node:
        if rng.integers(CONSTANTS) == 0:
            return const(round(float(rng.uniform(-3, 3)), 2))
        if self.odds is not None:
            return feat(self.features[rng.choice(len(self.features), p=self.odds)])
        return feat(self.features[rng.integers(len(self.features))])

    def tree(self, rng: np.random.Generator, depth: int = 0) -> Node:
        """A tree that fits below ``depth`` levels."""
        return self._grow(rng, int(rng.integers(2, self.max_size + 1)), self.max_depth - depth)

    def _grow(self, rng: np.random.Generator, size: int, levels: int) -> Node:
        shapes = [s for s in SHAPES.values() if s[1] < size]
        if levels <= 1 or not shapes:
            return self.terminal(rng)
        odds = np.array([s[2] for s in shapes], float)
        ops, inputs, _ = shapes[rng.choice(len(shapes), p=odds / odds.sum())]
        # The rest of the budget falls on the inputs at random, one node each at least.
        shares = 1 + rng.multinomial(size - 1 - inputs, np.full(inputs, 1 / inputs))
        args = tuple(self._grow(rng, int(k), levels - 1) for k in shares)
        op = ops[rng.integers(len(ops))]
        return Node(op, args, window=int(WINDOWS[rng.integers(len(WINDOWS))]) if op in TIMED else 0)

    def paths(self, n: Node, at: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
        return [at] + [p for i, a in enumerate(n.args) for p in self.paths(a, (*at, i))]

    def get(self, n: Node, path: tuple[int, ...]) -> Node:
        for i in path:
            n = n.args[i]
        return n

    def put(self, n: Node, path: tuple[int, ...], new: Node) -> Node:
        if not path:
            return new
        args = list(n.args)
        args[path[0]] = self.put(args[path[0]], path[1:], new)
        return replace(n, args=tuple(args))

    def point(self, n: Node, rng: np.random.Generator) -> Node:
        """Change one operator, feature or window in place."""
        path = self.paths(n)[rng.integers(n.size())]
        x = self.get(n, path)
        for group in (UNARY, CROSS, BINARY):
            if x.op in group:
                return self.put(n, path, replace(x, op=str(rng.choice(group))))
        if x.op in TIMED:
            return self.put(n, path, replace(x, op=str(rng.choice(TIMED)), window=int(rng.choice(WINDOWS))))
        return self.put(n, path, self.terminal(rng)) if not x.args else n

    def subtree(self, n: Node, rng: np.random.Generator) -> Node:
        path = self.paths(n)[rng.integers(n.size())]
        return self.put(n, path, self.tree(rng, min(len(path), self.max_depth - 1)))

    def hoist(self, n: Node, rng: np.random.Generator) -> Node:
        return self.get(n, self.paths(n)[rng.integers(n.size())])

    def shrink(self, n: Node, rng: np.random.Generator) -> Node:
        return self.put(n, self.paths(n)[rng.integers(n.size())], self.terminal(rng))

    def wrap(self, n: Node, rng: np.random.Generator) -> Node:
        return un(str(rng.choice(UNARY + CROSS)), n) if n.depth() < self.max_depth else n

    def jitter(self, n: Node, rng: np.random.Generator) -> Node:
        spots = [p for p in self.paths(n) if self.get(n, p).op == "const"]
        if not spots:
            return n
        path = spots[rng.integers(len(spots))]
        return self.put(n, path, const(self.get(n, path).value * float(rng.normal(1, 0.2))))

    def crossover(self, a: Node, b: Node, rng: np.random.Generator) -> Node:
        child = self.put(a, self.paths(a)[rng.integers(a.size())], self.hoist(b, rng))
        return child if child.depth() <= self.max_depth else a

    def edit(self, n: Node, rng: np.random.Generator, other: Node | None = None) -> tuple[str, Node]:
        """One random edit, simplified, never deeper than allowed."""
        kinds = ["point", "subtree", "hoist", "shrink", "wrap", "jitter"] + (["crossover"] if other else [])
        kind = str(rng.choice(kinds))
        new = self.crossover(n, other, rng) if kind == "crossover" else getattr(self, kind)(n, rng)
        new = simplify(new)
        return kind, new if new.depth() <= self.max_depth else n
