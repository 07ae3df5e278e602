"""Evolution of expressions: bandits on the driver, each generation scored as one Spark plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import expression as X
from tessera.operators import slab_scores
from tessera.operators.governance import POLICIES
from tessera.operators.slabs import Slabs
from tessera.session import scratch


@dataclass
class Bandit:
    """Choice by decayed success counts, every option keeping a least share."""

    options: tuple[str, ...]
    decay: float = 0.995
    floor: float = 0.05
    good: dict[str, float] = field(default_factory=dict)
    tried: dict[str, float] = field(default_factory=dict)

    def choose(self, rng: np.random.Generator) -> str:
        if rng.random() < self.floor * len(self.options):
            return str(rng.choice(self.options))
        draw = {o: rng.beta(1 + self.good.get(o, 0.0), 1 + self.tried.get(o, 0.0) - self.good.get(o, 0.0)) for o in self.options}
        return max(draw, key=draw.get)

    def learn(self, option: str, success: bool) -> None:
        for k in self.tried:
            self.tried[k] *= self.decay
            self.good[k] = self.good.get(k, 0.0) * self.decay
        self.tried[option] = self.tried.get(option, 0.0) + 1
        self.good[option] = self.good.get(option, 0.0) + bool(success)


@dataclass
class FamilyBandit:
    """Which families of features last: beliefs about surviving where the search could not look.

    Credit comes from the held-back tail alone, never from fitness, so a family
    that shines in sample and fades beyond it is drawn less often. Every family
    keeps a least weight, and what was learnt fades.
    """

    families: tuple[str, ...]
    floor: float = 0.15
    decay: float = 0.997
    lived: dict[str, float] = field(default_factory=dict)
    died: dict[str, float] = field(default_factory=dict)

    def learn(self, families: set[str], survived: bool) -> None:
        side = self.lived if survived else self.died
        for f in families & set(self.families):
            side[f] = side.get(f, 0.0) + 1

    def fade(self) -> None:
        for side in (self.lived, self.died):
            for f in side:
                side[f] *= self.decay

    def belief(self, family: str) -> float:
        """Expected share of survivors among strategies built from the family."""
        a, b = 1 + self.lived.get(family, 0.0), 1 + self.died.get(family, 0.0)
        return a / (a + b)

    def weights(self, rng: np.random.Generator) -> dict[str, float]:
        """One draw of every belief, never below the floor; for ``Grammar.weigh``."""
        return {f: self.floor + (1 - self.floor) * float(rng.beta(1 + self.lived.get(f, 0.0), 1 + self.died.get(f, 0.0))) for f in self.families}


def score_population(spark: SparkSession, sf_dir: str, trees: dict[str, X.Node], horizon: int = 5, slabs: Slabs | None = None) -> dict[str, float]:
    """Mean information coefficient of every tree, found in one plan for all of them; 0 for one that has none in any session.

    Scores are formed in ``slabs`` (made here, if none are given), so no panel is written.
    """
    with scratch(spark, "scores") as at:
        slabs = slabs or Slabs(spark, sf_dir, f"{at}/bars")
        ics = slab_scores.coefficients(slabs, at, trees, horizon, E.LEAST_NAMES)
        found = {r["id"]: r["ic"] for r in ics.groupBy("id").agg(F.avg("ic").alias("ic")).collect()}
    return {k: float(found.get(k) or 0.0) for k in trees}


@dataclass
class Evolver:
    """Keeps the best of every (size, feature count) cell and breeds from them."""

    grammar: X.Grammar
    evaluate: Callable[[dict[str, X.Node]], dict[str, float]]
    seed: int = 0
    parsimony: float = 0.001
    archive: dict[tuple[int, int], tuple[float, X.Node]] = field(default_factory=dict)
    seen: dict[str, float] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        self.edits = Bandit(("point", "subtree", "hoist", "shrink", "wrap", "jitter"))

    def cell(self, n: X.Node) -> tuple[int, int]:
        return int(np.searchsorted([5, 10, 20, 40], n.size())), len(n.features())

    def step(self, population: int = 12) -> float:
        """One generation; trees already seen by fingerprint are not scored again."""
        pool = [n for _, n in self.archive.values()]
        fresh: dict[str, tuple[str, X.Node]] = {}
        for _ in range(population * 10):
            if len(fresh) >= population:
                break
            if pool and self.rng.random() < 0.7:
                how = self.edits.choose(self.rng)
                parent = pool[int(self.rng.integers(len(pool)))]
                n = X.simplify(getattr(self.grammar, how)(parent, self.rng))
            else:
                how, n = "random", X.simplify(self.grammar.tree(self.rng))
            if n.features() and n.depth() <= self.grammar.max_depth and f"s_{n.fingerprint()}" not in self.seen:
                fresh[f"s_{n.fingerprint()}"] = (how, n)
        got = self.evaluate({k: n for k, (_, n) in fresh.items()}) if fresh else {}
        for k, (how, n) in fresh.items():
            fit = got.get(k, 0.0) - self.parsimony * n.size()
            self.seen[k] = fit
            better = self.cell(n) not in self.archive or fit > self.archive[self.cell(n)][0]
            if how != "random":
                self.edits.learn(how, better)
            if better:
                self.archive[self.cell(n)] = (fit, n)
        best = max((f for f, _ in self.archive.values()), default=0.0)
        self.history.append({"generation": len(self.history), "best": best, "trials": len(self.seen)})
        return best


def replay(world: dict[str, list[float]], policy: str, budget: int, rng: np.random.Generator, price: float = 0.0008, top: float | None = None) -> dict:
    """Run a choice policy over recorded outcomes by method; value is the best found less the cost of looking.

    ``top`` is the best possible outcome, where ``world`` holds only what the budget can reach.
    """
    at, seen = dict.fromkeys(world, 0), []
    sums: dict[str, list[float]] = {m: [] for m in world}
    for k in range(budget):
        open_ = [m for m in sorted(world) if at[m] < len(world[m])]
        if not open_:
            break
        m = POLICIES[policy].choose(k, {m: sums[m] for m in open_}, rng)
        x = world[m][at[m]]
        at[m] += 1
        sums[m].append(x)
        seen.append(x)
    best = max(seen, default=0.0)
    if top is None:
        top = max((x for v in world.values() for x in v), default=0.0)
    return {"policy": policy, "best": best, "value": best - price * len(seen), "regret": top - best}


def thesis_verdict(sessions: int, forward: float, trailing: float) -> tuple[str, bool]:
    """(verdict, had it moved already) of a thesis from its excess returns before and since."""
    moved = trailing > 0.25
    if sessions < 20:
        return "too early", moved
    return ("holding" if forward > 0.02 else "not holding" if forward < -0.02 else "flat"), moved
