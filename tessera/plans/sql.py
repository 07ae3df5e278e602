"""One declarative text per query, rendered for Spark and for an ANSI engine.

A query is a chain of named relations. Where the two engines spell a function
differently, the dialect supplies the spelling; everything else is shared, so
the plan that Catalyst optimises and its oracle cannot drift apart.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import cut

class Dialect:
    """Spelling of what differs between engines. This one is Spark's."""

    name = "spark"

    def __init__(self, sf_dir: str = "") -> None:
        self.sf_dir = sf_dir

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def median(self, x: str, frame: str) -> str:
        """Median over a window frame: the middle of its sorted values, which is lighter than a percentile's counts."""
        return f"transform(array(sort_array(collect_list({x}) over {frame})), v -> (get(v, cast(floor((size(v) - 1) / 2) as int)) + get(v, cast(floor(size(v) / 2) as int))) / 2)[0]"

    def count_below(self, x: str, frame: str) -> str:
        """How many values of ``x`` in the frame lie strictly below the current one."""
        return f"size(filter(collect_list({x}) over {frame}, v -> v < {x}))"

    def explode(self, array: str, name: str) -> str:
        return f"lateral view explode({array}) __e as {name}"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def days(self, end: str, start: str) -> str:
        return f"datediff({end}, {start})"

    def add_days(self, d: str, n: str) -> str:
        return f"date_add({d}, cast({n} as int))"

    def extract(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, r'{pattern}', {group})"

    def matches(self, s: str, pattern: str) -> str:
        return f"{s} rlike r'{pattern}'"

    def json(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def try_cast(self, x: str, kind: str) -> str:
        return f"try_cast({x} as {kind})"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def product(self, x: str) -> str:
        """Product of values above zero."""
        return f"exp(sum(ln({x})))"

    def concat_sorted(self, x: str, order: str) -> str:
        return f"array_join(transform(sort_array(collect_list(struct({order} as o, {x} as x))), s -> s.x), '|')"

    def epoch(self, ts: str) -> str:
        return f"unix_timestamp({ts})"

    def argmax(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def pair(self, a: str, b: str) -> str:
        """Two values that compare in order."""
        return f"struct({a} as a, {b} as b)"

    def string_list(self, s: str, sep: str) -> str:
        return f"split({s}, '{sep}')"


class Duck(Dialect):
    name = "duckdb"

    def table(self, name: str) -> str:
        return name

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def median(self, x: str, frame: str) -> str:
        return f"quantile_cont({x}, 0.5) over {frame}"

    def count_below(self, x: str, frame: str) -> str:
        return f"len(list_filter(list({x}) over {frame}, lambda v: v < {x}))"

    def explode(self, array: str, name: str) -> str:
        return f", unnest({array}) as __e({name})"

    def sequence(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def days(self, end: str, start: str) -> str:
        return f"date_diff('day', {start}, {end})"

    def add_days(self, d: str, n: str) -> str:
        return f"cast({d} + cast({n} as int) as date)"

    def extract(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, '{pattern}', {group})"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, '{pattern}')"

    def json(self, s: str, key: str) -> str:
        return f"json_extract_string({s}, '$.{key}')"

    def sha(self, s: str) -> str:
        return f"sha256({s})"

    def concat_sorted(self, x: str, order: str) -> str:
        return f"string_agg({x}, '|' order by {order})"

    def epoch(self, ts: str) -> str:
        return f"cast(floor(epoch({ts})) as bigint)"

    def argmax(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def pair(self, a: str, b: str) -> str:
        return f"row({a}, {b})"

    def string_list(self, s: str, sep: str) -> str:
        return f"string_split({s}, '{sep}')"


class Chain:
    """Named relations in order; ``select`` renders the whole text.

    A relation added with ``keep`` is worth writing once where several others read it.
    """

    def __init__(self, d: Dialect) -> None:
        self.d = d
        self.parts: dict[str, str] = {}
        self.kept: set[str] = set()
        self.final = ""

    def add(self, name: str, sql: str, keep: bool = False) -> Chain:
        self.parts.setdefault(name, sql)
        if keep:
            self.kept.add(name)
        return self

    def rename(self, name: str, to: str) -> None:
        """Put a relation aside under another name, so that its own can be given anew."""
        self.parts[to] = self.parts.pop(name)
        if name in self.kept:
            self.kept.add(to)

    def values(self, name: str, columns: str, rows: Iterable[tuple]) -> Chain:
        """A small relation of constants."""

        def show(v) -> str:
            return f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

        body = ", ".join(f"({', '.join(map(show, r))})" for r in rows)
        return self.add(name, f"select * from (values {body}) as v({columns})")

    def reached(self, sql: str) -> dict[str, str]:
        """The relations that ``sql`` reads, directly or through others, in order."""
        found: set[str] = set()
        todo = [sql]
        while todo:
            words = set(re.findall(r"\w+", todo.pop()))
            fresh = (words & self.parts.keys()) - found
            found |= fresh
            todo += [self.parts[n] for n in fresh]
        return {n: sql for n, sql in self.parts.items() if n in found}

    def uses(self, name: str) -> int:
        """How often later relations and the result read ``name``."""
        read = re.compile(rf"(?:from|join|,)\s+{name}\b")
        return sum(len(read.findall(sql)) for sql in (*self.parts.values(), self.final))

    def select(self, sql: str) -> str:
        self.final = sql
        parts = self.reached(sql)
        if not parts:
            return sql
        return "with " + ",\n".join(f"{n} as ({s})" for n, s in parts.items()) + "\n" + sql


Text = Callable[[Chain], str]


def to_spark(text: Text, **given: DataFrame) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a DataFrame; relations that are ``given`` stand for the text's own of that name.

    Spark inlines named relations, so one that is read several times would be
    computed each time. Those that the chain keeps are written to the checkpoint
    folder once, and the rest of the plan starts from there.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, views = Chain(Dialect(sf_dir)), []
        for name, df in given.items():
            view = f"{name}_{uuid.uuid4().hex[:12]}"
            df.createOrReplaceTempView(view)
            views.append(view)
            c.add(name, f"select * from {view}")
        text(c)
        final = c.final
        c.parts = c.reached(final)
        parts = dict(c.parts)
        for name in [n for n in parts if n in c.kept and c.uses(n) > 1]:
            before = Chain(c.d)
            for n, sql in parts.items():
                before.add(n, sql)
                if n == name:
                    break
            view = f"{name}_{uuid.uuid4().hex[:12]}"
            cut(spark.sql(before.select(f"select * from {name}"))).createOrReplaceTempView(view)
            views.append(view)
            parts[name] = f"select * from {view}"
        c.parts = parts
        df = spark.sql(c.select(final))
        for view in views:
            spark.catalog.dropTempView(view)
        return df

    return run


def to_oracle(text: Text) -> str:
    return text(Chain(Duck()))


def rounded_each(*names: str, digits: int = 6) -> list[str]:
    """Output columns rounded alike in both engines.

    A small shift keeps exact ties (means of a few rounded values) off the
    rounding boundary, where the last bit of a sum would decide.
    """
    return [f"round({n} + 1.73e-{digits + 2}, {digits}) + 0e0 as {n}" for n in names]


def rounded(*names: str, digits: int = 6) -> str:
    """``rounded_each`` as one text."""
    return ", ".join(rounded_each(*names, digits=digits))
