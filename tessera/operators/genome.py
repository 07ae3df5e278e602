"""Genomes: an expression with the parameters that turn its score into a book, and where it came from.

A genome is a row: the population is a small table that the backtest joins, so that each strategy
brings its own number of names, interval and weighting.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import expression as X

# Fixed: what a genome's parameters are drawn from.
POSITIONS = (10, 15, 20, 25, 30, 40, 50)
INTERVALS = (1, 2, 5, 10, 21)
WEIGHTINGS = ("equal", "score")

SCHEMA = "id string, tree string, positions int, interval int, weighting string, born int, parents array<string>, made_by string"


@dataclass(frozen=True)
class Genome:
    tree: X.Node
    positions: int = 25
    interval: int = 5
    weighting: str = "equal"
    born: int = 0
    parents: tuple[str, ...] = ()
    made_by: str = "init"

    @property
    def id(self) -> str:
        """Equal for genomes that trade alike, whatever their lineage; also a column name."""
        text = f"{self.tree.canonical()};{self.positions};{self.interval};{self.weighting}"
        return f"g_{hashlib.sha1(text.encode()).hexdigest()[:12]}"

    def row(self) -> tuple:
        return self.id, self.tree.to_json(), self.positions, self.interval, self.weighting, self.born, list(self.parents), self.made_by

    @classmethod
    def from_row(cls, r) -> Genome:
        """The genome of a row of ``SCHEMA``; an unknown weighting or a parameter below one raises."""
        g = cls(X.from_dict(json.loads(r["tree"])), r["positions"], r["interval"], r["weighting"], r["born"], tuple(r["parents"]), r["made_by"])
        if g.weighting not in WEIGHTINGS or g.positions < 1 or g.interval < 1:
            raise ValueError(f"not a genome: {r}")
        return g


def to_table(spark: SparkSession, genomes: list[Genome]) -> DataFrame:
    return spark.createDataFrame([g.row() for g in genomes], SCHEMA)


class Breeder:
    """Draws genomes and edits them: the tree by the grammar's edits, the parameters by ``params``."""

    def __init__(self, grammar: X.Grammar) -> None:
        self.grammar = grammar

    def draw(self, rng: np.random.Generator, born: int = 0) -> Genome:
        """A random tree over at least one feature, ranked at its root more often than not, with random parameters."""
        tree = X.const(0)
        while not tree.features():
            tree = X.simplify(self.grammar.tree(rng))
        if rng.random() < 0.55:
            tree = X.simplify(X.un("rank", tree))
        return Genome(tree, int(rng.choice(POSITIONS)), int(rng.choice(INTERVALS)), str(rng.choice(WEIGHTINGS)), born)

    def params(self, g: Genome, rng: np.random.Generator) -> Genome:
        """Another value for one of the three parameters; the tree stays."""
        u = rng.random()
        name, choices = ("positions", POSITIONS) if u < 0.4 else ("interval", INTERVALS) if u < 0.8 else ("weighting", WEIGHTINGS)
        others = [v for v in choices if v != getattr(g, name)]
        return replace(g, **{name: others[int(rng.integers(len(others)))]})

    def child(self, parent: Genome, rng: np.random.Generator, mate: Genome | None = None, how: str | None = None, born: int = 0) -> Genome:
        """One edit of ``parent``, chosen by ``how`` or at random; an edit that leaves no feature returns the parent."""
        if how == "params" or (how is None and rng.random() < 0.2):
            how, new = "params", self.params(parent, rng)
        else:
            if how is None:
                how, tree = self.grammar.edit(parent.tree, rng, mate and mate.tree)
            elif how == "crossover":
                tree = self.grammar.crossover(parent.tree, mate.tree if mate else parent.tree, rng)
            else:
                tree = getattr(self.grammar, how)(parent.tree, rng)
            tree = X.simplify(tree)
            if not tree.features() or tree.depth() > self.grammar.max_depth + 1:
                return parent
            new = replace(parent, tree=tree)
        lineage = (parent.id, mate.id) if mate and how == "crossover" else (parent.id,)
        return replace(new, born=born, parents=lineage, made_by=how)


def sample(breeder: Breeder, n: int, seed: int) -> list[Genome]:
    """``n`` distinct genomes of one seed."""
    rng, out = np.random.default_rng(seed), {}
    while len(out) < n:
        g = breeder.draw(rng)
        out.setdefault(g.id, g)
    return list(out.values())
