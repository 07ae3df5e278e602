"""What stands between a search and its money: gates, duplicates, sealed holdouts, choice policies, method variants."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metrics
from tessera.sources.stores import override, read_json, write_json

# ---- gates --------------------------------------------------------------------

_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def gate_record(gate: str, value: float, op: str, threshold: float) -> dict:
    """One check. A value that is no number never passes."""
    ok = value is not None and not math.isnan(value) and _COMPARE[op](value, threshold)
    return {"gate": gate, "value": value, "op": op, "threshold": threshold, "pass": bool(ok)}


def gate(values: dict[str, float], limits: list[tuple[str, str, float]], dear: list[tuple[str, Callable[[], float], str, float]] = ()) -> list[dict]:
    """All cheap checks; the dear ones, which are computed here, only for what passed them, and no further than the first that fails."""
    out = [gate_record(n, values.get(n, math.nan), op, lim) for n, op, lim in limits]
    if all(r["pass"] for r in out):
        for n, compute, op, lim in dear:
            try:
                value = float(compute())
            except (ValueError, ArithmeticError):
                value = math.nan
            out.append(gate_record(n, value, op, lim))
            if not out[-1]["pass"]:
                break
    return out


def passed(checks: list[dict]) -> bool:
    return bool(checks) and all(c["pass"] for c in checks)


def null_bar(trials: int, floor: float = 2.0) -> float:
    """The largest |t| that so many independent looks find in noise, never below the floor."""
    return max(floor, math.sqrt(2 * math.log(max(trials, 1))))


def holdout_verdict(t: float, sharpe: float, n: int, registered: int, skew: float = 0.0, kurt: float = 3.0) -> dict:
    """Whether a sealed test stands: its t against the bar of what was registered, and the deflated Sharpe ratio."""
    bar = null_bar(registered)
    dsr = metrics.deflated_sharpe(sharpe, n, max(registered, 1), 1 / max(n, 1), skew, kurt)
    return {"t": t, "bar": bar, "dsr": dsr, "needs": metrics.min_track_record(sharpe, 0.0, skew, kurt), "stands": t >= bar and dsr >= 0.95}


# ---- likeness -----------------------------------------------------------------


def pair_correlations(curves: DataFrame, least: int = 60, id: str = "strategy", x: str = "x") -> DataFrame:
    """(a, b, rho) of every pair of curves with a < b on the sessions that both have, ``least`` of them or more.

    The curves are those of an archive, some hundreds, so their pairs are few
    against the rows that are aggregated for them.
    """
    a = curves.select(F.col(id).alias("a"), "t_idx", F.col(x).alias("xa"))
    b = curves.select(F.col(id).alias("b"), "t_idx", F.col(x).alias("xb"))
    both = a.join(b, "t_idx").filter("a < b and xa is not null and xb is not null").groupBy("a", "b")
    return both.agg(F.corr("xa", "xb").alias("rho"), F.count("*").alias("n")).filter(F.col("n") >= least).select("a", "b", F.coalesce("rho", F.lit(0.0)).alias("rho"))


def decorrelated(ranked: list[str], rho: dict[tuple[str, str], float], limit: float = 0.7, k: int = 5) -> list[str]:
    """From the best down, every one that is not too much like one already taken, up to ``k``."""
    out: list[str] = []
    for s in ranked:
        if len(out) == k:
            break
        if all(abs(rho.get((min(s, o), max(s, o)), 0.0)) <= limit for o in out):
            out.append(s)
    return out


def distinct_behaviour(sizes: dict[str, int], rho: dict[tuple[str, str], float], limit: float = 0.999) -> list[str]:
    """Of strategies that move as one the simplest stays (then the first by name)."""
    out: list[str] = []
    for s in sorted(sizes, key=lambda s: (sizes[s], s)):
        if all(abs(rho.get((min(s, o), max(s, o)), 0.0)) < limit for o in out):
            out.append(s)
    return out


def revalidate(hall: dict[str, dict], evaluate: Callable[[str], dict], limits: list[tuple[str, str, float]]) -> tuple[dict[str, dict], dict[str, list[dict]]]:
    """Entries that still pass the gate on today's data, with their new values; and the failed checks of the others."""
    kept, gone = {}, {}
    for name, entry in hall.items():
        now = evaluate(name)
        checks = gate(now, limits)
        if passed(checks):
            kept[name] = entry | now
        else:
            gone[name] = [c for c in checks if not c["pass"]]
    return kept, gone


# ---- holdouts -----------------------------------------------------------------


def digest(rows: DataFrame, key: str, columns: list[str]) -> str:
    """A fingerprint of rows whatever their order: a hash a key over its sorted rows, hashed together."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    each = rows.groupBy(key).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("h"))
    body = "\n".join(f"{r[key]}:{r['h']}" for r in sorted(each.collect(), key=lambda r: str(r[key])))
    return hashlib.sha256(body.encode()).hexdigest()


class Refused(RuntimeError):
    """A reserve does not allow what was asked; ``reasons`` has all of them."""

    def __init__(self, reasons: list[str]) -> None:
        super().__init__("; ".join(reasons))
        self.reasons = reasons


@dataclass(frozen=True)
class Standing:
    """What a reserve's events add up to."""

    first: str = ""
    last: str | None = None
    after: str | None = None
    data: str = ""
    need: int = 0
    tries: int = 0
    named: frozenset[str] = frozenset()
    spent: int = 0
    leaks: tuple[str, ...] = ()

    def fold(self, e: dict) -> Standing:
        what = e["what"]
        match e["kind"]:
            case "kept":
                return replace(self, **what)
            case "named":
                return replace(self, named=self.named | set(what["ids"]))
            case "used":
                return replace(self, spent=self.spent + 1)
            case "leaked":
                return replace(self, leaks=(*self.leaks, what["by"]))
        return self

    def usable(self, sessions: list[str]) -> list[str]:
        """Those that lie in the window and, for one kept ahead of time, after the day it was promised."""
        return [d for d in sessions if d >= self.first and (self.last is None or d <= self.last) and (self.after is None or d > self.after)]


class Reserve:
    """Sessions kept for a last test: a chain of events, and a fold over it that says what is still allowed.

    A window of the past is known by the digest of its data. One of the future
    begins after the day it was promised and needs some sessions first. Each
    event carries the hash of all before it, so a changed history shows.
    """

    def __init__(self, events: list[dict] | None = None) -> None:
        self.events = list(events or ())

    @classmethod
    def past(cls, first: str, last: str, sessions: list[str], data: str, need: int = 60, tries: int = 1) -> Reserve:
        new = cls()._add("kept", first=first, last=last, data=data, need=need, tries=tries)
        short = new._short(sessions)
        if short:
            raise Refused(short)
        return new

    @classmethod
    def future(cls, today: str, need: int = 250, tries: int = 1) -> Reserve:
        return cls()._add("kept", first=today, after=today, need=need, tries=tries)

    def _link(self, n: int) -> str:
        return hashlib.sha256(json.dumps(self.events[:n], sort_keys=True).encode()).hexdigest()

    def _add(self, kind: str, **what) -> Reserve:
        self.events.append({"kind": kind, "what": what, "before": self._link(len(self.events))})
        return self

    def unbroken(self) -> bool:
        return all(e["before"] == self._link(i) for i, e in enumerate(self.events))

    def now(self) -> Standing:
        return reduce(Standing.fold, self.events, Standing())

    def left(self) -> int:
        s = self.now()
        return max(0, s.tries - s.spent)

    def _short(self, sessions: list[str]) -> list[str]:
        n, need = len(self.now().usable(sessions)), self.now().need
        return [f"{n} usable sessions, {need} are needed"] if n < need else []

    def objections(self, who: str, sessions: list[str], data: str = "") -> list[str]:
        """Everything that stands against ``who`` being tested now."""
        s, out = self.now(), self._short(sessions)
        if not self.left():
            out.append(f"used {s.spent} times, {s.tries} allowed")
        if s.named and who not in s.named:
            out.append(f"{who} is not among the candidates named beforehand")
        if s.data and s.data != data:
            out.append("these are other data than were kept")
        if not self.unbroken():
            out.append("its history was changed")
        return out

    def name(self, ids: list[str]) -> None:
        """Say beforehand which candidates will be tested."""
        if self.now().spent:
            raise Refused(["candidates are named before the first use"])
        self._add("named", ids=sorted(ids))

    def use(self, who: str, sessions: list[str], data: str = "") -> list[str]:
        """Spend one try; the sessions that ``who`` may be tested on."""
        if reasons := self.objections(who, sessions, data):
            raise Refused(reasons)
        self._add("used", id=who)
        return self.now().usable(sessions)

    def leak(self, by: str, what: str) -> None:
        """The window was read outside a test; that stays on record."""
        self._add("leaked", by=by, what=what)

    def outcome(self, who: str, values: dict) -> None:
        self._add("outcome", id=who, values=values)

    def training(self, rows: DataFrame, date: str = "date") -> DataFrame:
        """The rows before the window: all that a search may read."""
        return rows.filter(F.col(date) < F.lit(self.now().first))

    def save(self, path: str) -> None:
        write_json(path, {"events": self.events})

    @classmethod
    def load(cls, path: str) -> Reserve | None:
        s = read_json(path)
        return cls(s["events"]) if s else None


# ---- choice policies ----------------------------------------------------------


class Policy(ABC):
    """Which method to try next, from what each has given so far."""

    @abstractmethod
    def choose(self, step: int, given: dict[str, list[float]], rng: np.random.Generator) -> str: ...


class RoundRobin(Policy):
    def choose(self, step: int, given: dict[str, list[float]], rng: np.random.Generator) -> str:
        return sorted(given)[step % len(given)]


class Greedy(Policy):
    """Whatever gave the best single outcome; what has not been tried comes first."""

    def choose(self, step: int, given: dict[str, list[float]], rng: np.random.Generator) -> str:
        return max(sorted(given), key=lambda m: max(given[m], default=math.inf))


class Thompson(Policy):
    """The best draw of the beliefs about gaining anything at all."""

    def choose(self, step: int, given: dict[str, list[float]], rng: np.random.Generator) -> str:
        won = {m: sum(x > 0 for x in given[m]) for m in sorted(given)}
        draws = {m: rng.beta(1 + w, 1 + len(given[m]) - w) for m, w in won.items()}
        return max(draws, key=draws.get)


class Uniform(Policy):
    def choose(self, step: int, given: dict[str, list[float]], rng: np.random.Generator) -> str:
        return str(rng.choice(sorted(given)))


class Exploring(Policy):
    """Greedy, but for a share of uniform choices."""

    def __init__(self, share: float = 0.2) -> None:
        self.share, self.greedy, self.uniform = share, Greedy(), Uniform()

    def choose(self, step: int, given: dict[str, list[float]], rng: np.random.Generator) -> str:
        return (self.uniform if rng.random() < self.share else self.greedy).choose(step, given, rng)


POLICIES: dict[str, Policy] = {"round_robin": RoundRobin(), "greedy": Greedy(), "thompson": Thompson(), "random": Uniform(), "exploring": Exploring()}


# ---- methods ------------------------------------------------------------------

#: A method is a way to run the search: changes to its configuration at dotted paths.
METHODS: dict[str, dict[str, object]] = {"plain": {}}


def register_method(name: str, **changes: object) -> None:
    """Changes are given with double underscores for dots: ``search__population=60``."""
    if name in METHODS:
        raise ValueError(f"method {name!r} exists")
    METHODS[name] = {k.replace("__", "."): v for k, v in changes.items()}


def configured(base: dict, name: str) -> dict:
    return override(base, METHODS[name])


register_method("wide", search__population=96, search__generations=2)
register_method("deep", search__max_depth=6)
register_method("long_hold", backtest__rebalance=21, backtest__names=50)


# ---- theses -------------------------------------------------------------------


def review(theses: list[dict], excess: Callable[[list[str], str], tuple[int, float, float]], today: dt.date) -> list[dict]:
    """Every thesis (id, tickers, since) with its sessions and excess before and since, its age, and what that says."""
    from tessera.operators.search import thesis_verdict

    out = []
    for t in theses:
        n, trailing, forward = excess(t["tickers"], t["since"])
        verdict, moved = thesis_verdict(n, forward, trailing)
        out.append({"id": t["id"], "age_days": (today - dt.date.fromisoformat(t["since"])).days, "sessions": n, "trailing": trailing, "forward": forward, "verdict": verdict, "already_moved": moved})
    return sorted(out, key=lambda r: r["id"])
