"""Queries on whole populations: fitness, the null model, shifted scores, the honest walk-forward, survival by family."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.functions import series as S
from tessera.operators import evaluation as E
from tessera.operators import expression as X
from tessera.operators import population as N
from tessera.operators import slab_scores
from tessera.operators.features import FAMILIES, PRICE_FEATURES, family_of, price_features
from tessera.operators.genome import Breeder, Genome, sample
from tessera.operators.slabs import Slabs
from tessera.session import scratch
from tessera.sources import panel as P

from .sql import Chain, Dialect, Text, rounded, to_spark

TEXTS: dict[str, Text] = {}
#: Genomes of the population, of the null sample, and of each segment's search.
POPULATION, NULLS, SEARCHED = 30, 40, 8
#: Replicas of the shift test, the part of the calendar that a shift keeps away from none, and the names of their books.
SHIFTS, KEEP_OFF, BOOK = 24, 8, 25
#: Segments of the walk-forward, and of each search's folds their number and least length.
SEGMENTS, SEARCH_FOLDS, SEARCH_LEAST = 7, 3, 12
#: Number of the piece that no search may look at, and the part of all sessions held back.
TAIL, HELD = 99, 0.2


def query(name: str):
    def add(f: Text) -> Text:
        TEXTS[name] = f
        return f

    return add


def breeder() -> Breeder:
    return Breeder(X.Grammar(PRICE_FEATURES, max_depth=4, max_size=10))


def population() -> list[Genome]:
    return sample(breeder(), POPULATION, seed=5)


def yardstick() -> list[Genome]:
    return sample(breeder(), NULLS, seed=101)


@query("population_fitness")
def _fitness(c: Chain) -> str:
    """Thirty genomes of mixed parameters over folds: their figures, and fitness by every mode and parsimony."""
    price_features(c)
    N.evaluate(c, "feats", population())
    N.fitness(c)
    return c.select(f"select strategy, k, rb, by_score, size, folds, n_trades, {rounded(*N.FIGURES, 'novelty', *N.FITNESS, digits=5)} from fit")


@query("null_model")
def _null(c: Chain) -> str:
    """Random genomes as the yardstick: for each candidate the share of them below it, and the yardstick's own high marks."""
    nulls = yardstick()
    price_features(c)
    N.evaluate(c, "feats", nulls + [g for g in population() if g.id not in {n.id for n in nulls}])
    N.fitness(c)
    c.values("null_id", "strategy", ((g.id,) for g in nulls))
    c.add("marked", "select f.*, n.strategy is not null as is_null from fit f left join null_id n on n.strategy = f.strategy", keep=True)
    return c.select(null_share(c, {"fitness": "ir_linear", "ir": "mean_ir", "alpha": "alpha_t"}))


def null_share(c: Chain, figures: dict[str, str], least: int = 20) -> str:
    """Per row of ``marked`` that is no null: how many nulls there are and, from ``least`` of them on, the share below and the marks of 95 and 99 %."""
    for f, x in figures.items():
        c.add(f"null_{f}", f"select count(*) as n, {c.d.percentile(x, 0.95)} as p95, {c.d.percentile(x, 0.99)} as p99 from marked where is_null")
        c.add(f"below_{f}", f"select m.strategy, avg(case when round(q.{x}, 9) < round(m.{x}, 9) then 1e0 else 0e0 end) as share from marked m join marked q on q.is_null and not m.is_null group by m.strategy")
    c.add("null_o", f"select m.strategy, nf.n as nulls, {', '.join(f'case when nf.n >= {least} then b{i}.share end as {f}_share, case when nf.n >= {least} then n{i}.p95 end as {f}_p95, case when nf.n >= {least} then n{i}.p99 end as {f}_p99' for i, f in enumerate(figures))} from marked m cross join (select n from null_{next(iter(figures))}) nf {' '.join(f'join below_{f} b{i} on b{i}.strategy = m.strategy cross join null_{f} n{i}' for i, f in enumerate(figures))} where not m.is_null")
    return f"select strategy, nulls, {rounded(*(f'{f}_{x}' for f in figures for x in ('share', 'p95', 'p99')), digits=5)} from null_o"


@query("shuffle_folds")
def _shuffle(c: Chain) -> str:
    """The flagship against replicas with its score moved round the calendar, each through folds and costs: how many it beats.

    A replica keeps the score's cross-sections and loses their timing. Its score
    is read at its own rebalance rows only, so no panel is copied.
    """
    E.score_momentum(c)
    P.sessions(c)
    c.values("rep", "r", ((r,) for r in range(SHIFTS + 1)))
    c.add("rep_n", "select r, max(t_idx) + 1 as n from rep cross join sessions group by r")
    c.add("shifts", f"select 's' || cast(r as varchar(9)) as strategy, case when r = 0 then 0 else cast(floor(n / {KEEP_OFF}e0) + floor((r - 1) * (n - 2 * floor(n / {KEEP_OFF}e0)) / {SHIFTS}e0) as int) end as shift from rep_n")
    c.add("gene", f"select strategy, 'all' as win, {BOOK} as k, 5 as rb, 0 as by_score, 1 as size, shift from shifts")
    c.add("lng", "select g.strategy, s.symbol, s.t_idx as t_src, round(s.score, 9) as score from score s cross join gene g where s.score is not null")
    N.whole(c)
    N.pieces(c)
    N.candidates(c, "shift")
    N.books(c, BOOK)
    N.trade(c)
    N.summary(c)
    c.add("o", f"select count(*) as replicas, avg(case when round(s.mean_ir, 9) < round(f.mean_ir, 9) then 1e0 else 0e0 end) as share_beaten, max(f.mean_ir) as real_ir, avg(s.mean_ir) as null_ir, {c.d.percentile('s.mean_ir', 0.95)} as null_p95 from cvs s join cvs f on f.strategy = 's0' and s.strategy <> 's0'")
    enough = f"replicas >= {(2 * SHIFTS) // 3}"
    c.add("p", f"select replicas, {enough} as ok, case when {enough} then share_beaten end as share_beaten, case when {enough} then (1 + replicas * (1 - share_beaten)) / (1 + replicas) end as p_value, real_ir, null_ir, null_p95 from o")
    return c.select(f"select replicas, ok, {rounded('share_beaten', 'p_value', 'real_ir', 'null_ir', 'null_p95')} from p")


def searches(seed: int = 50) -> dict[int, list[Genome]]:
    """Every segment's own search: genomes drawn from a seed that knows no data."""
    return {s: sample(breeder(), SEARCHED, seed + s) for s in range(1, SEGMENTS)}


def walk(c: Chain, embargo: int = N.EMBARGO) -> str:
    """Relation ``won``: (win, strategy), the best of each segment's search on folds before the segment; ``day`` has its test piece as fold ``TAIL``.

    A segment's window ends where it begins; the test piece starts an embargo later.
    """
    price_features(c)
    found = searches()
    trees = {g.id: g.tree for gs in found.values() for g in gs}
    c.kept.add(X.compile_population(c, "feats", trees))
    N.long_scores(c, "scored", trees)
    rows = [(f"w{s}_{g.id}", g.id, f"w{s}", g) for s, gs in found.items() for g in gs]
    N.genes(c, [(name, win, g) for name, _, win, g in rows])
    c.values("named", "strategy, id", ((name, i) for name, i, _, _ in rows))
    c.rename("lng", "lng_one")
    c.add("lng", "select n.strategy, l.symbol, l.t_src, l.score from lng_one l join named n on n.id = l.strategy")
    P.sessions(c)
    c.values("seg", "s", ((s,) for s in range(1, SEGMENTS)))
    edge = "cast(floor({} * n / {}e0) as int)"
    c.add("seg_t", f"select s, 'w' || cast(s as varchar(9)) as win, {edge.format('s', SEGMENTS)} as b, {edge.format('(s + 1)', SEGMENTS)} as e from seg cross join (select max(t_idx) + 1 as n from sessions) q")
    c.add("span_w", "select win, 0 as a, b from seg_t")
    N.pieces(c, SEARCH_FOLDS, embargo, SEARCH_LEAST)
    c.rename("piece", "piece_in")
    c.add("piece", f"select win, f, lo, hi from piece_in union all select win, {TAIL}, b + {embargo}, e from seg_t")
    N.candidates(c)
    N.books(c, max(g.positions for gs in found.values() for g in gs))
    N.trade(c)
    c.add("day_in", f"select * from day where f <> {TAIL}")
    N.summary(c, "day_in")
    N.fitness(c)
    c.add("won", "select win, strategy, ir_linear from (select win, strategy, ir_linear, row_number() over (partition by win order by round(ir_linear, 8) desc, strategy) as rn from fit) q where rn = 1", keep=True)
    return "won"


@query("honest_walk_forward")
def _honest(c: Chain) -> str:
    """Segment by segment a search on the past alone, and what its pick then made; the last row chains the segments."""
    walk(c)
    c.add("test_d", f"select w.win, w.strategy, w.ir_linear, d.t_idx, d.ret, d.bench from won w join day d on d.strategy = w.strategy and d.f = {TAIL}", keep=True)
    year = "pow({}, {}e0 / count(*)) - 1"
    figures = f"count(*) as n, {year.format(S.growth('ret'), S.YEAR)} as ret_ann, {year.format(S.growth('bench'), S.YEAR)} as bench_ann"
    c.add("seg_o", f"select win, max(strategy) as pick, max(ir_linear) as fitness, {figures} from test_d group by win")
    c.add("chain_x", "select t_idx, ret - bench as x from test_d")
    E.newey_west(c, "chain_x", "x", "chain_t")
    c.add("chain_o", f"select 'chained' as win, cast(null as varchar(40)) as pick, cast(null as double) as fitness, {figures} from test_d")
    c.add("o", "select win, pick, fitness, n, ret_ann, bench_ann, ret_ann - bench_ann as excess, cast(null as double) as t from seg_o union all select o.win, o.pick, o.fitness, o.n, ret_ann, bench_ann, ret_ann - bench_ann, t.t from chain_o o cross join chain_t t")
    return c.select(f"select win, pick, n, {rounded('fitness', 'ret_ann', 'bench_ann', 'excess', 't', digits=5)} from o")


@query("family_survival")
def _survival(c: Chain) -> str:
    """By family of features: how many genomes read it, and how many of those made an alpha in the tail that no fitness looks at."""
    genomes = population()
    price_features(c)
    c.kept.add(X.compile_population(c, "feats", {g.id: g.tree for g in genomes}))
    N.long_scores(c, "scored", [g.id for g in genomes])
    N.genes(c, [(g.id, "all", g) for g in genomes])
    P.sessions(c)
    cut = f"cast(floor(n * {1 - HELD}e0) as int)"
    c.add("split", f"select n, {cut} as edge from (select max(t_idx) + 1 as n from sessions) q")
    c.add("span_w", "select 'all' as win, 0 as a, edge as b from split")
    c.add("piece", f"select 'all' as win, {TAIL} as f, edge as lo, n as hi from split")
    N.candidates(c)
    N.books(c, max(g.positions for g in genomes))
    N.trade(c)
    N.summary(c)
    c.values("reads", "strategy, family", ((g.id, f) for g in genomes for f in sorted({family_of(x) for x in g.tree.features()})))
    c.values("fams", "family", ((f,) for f in FAMILIES))
    c.add("fam_s", "select r.family, count(*) as seen, sum(case when s.mean_alpha > 1e-9 then 1 else 0 end) as survived from reads r join cvs s on s.strategy = r.strategy group by r.family")
    c.add("o", "select f.family, coalesce(s.seen, 0) as seen, cast(coalesce(s.survived, 0) as bigint) as survived, (1e0 + coalesce(s.survived, 0)) / (2e0 + coalesce(s.seen, 0)) as belief from fams f left join fam_s s on s.family = f.family")
    return c.select(f"select family, seen, survived, {rounded('belief')} from o")


# ---- from slabs -------------------------------------------------------------------


def from_sessions(spark: SparkSession, sf_dir: str, text: Text, sessions: DataFrame, select: Callable[[Chain], str]) -> list[Row]:
    """The rows that ``select`` takes from relations of a text that read sessions alone."""
    c, view = Chain(Dialect(sf_dir)), f"sessions_{uuid.uuid4().hex[:12]}"
    sessions.createOrReplaceTempView(view)
    c.add("sessions", f"select * from {view}")
    text(c)
    rows = spark.sql(c.select(select(c))).collect()
    spark.catalog.dropTempView(view)
    return rows


def rebalances(spark: SparkSession, sf_dir: str, text: Text, sessions: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    """For every tree of a text, session -> (names, sessions until the next rebalance row) at most; from the text's own ``reb``."""

    def select(c: Chain) -> str:
        tree, named = ("n.id", "join named n on n.strategy = r.strategy") if "named" in c.parts else ("r.strategy", "")
        return f"select {tree} as id, r.t_src, max(r.k) as k, max(r.rb) as rb from reb r {named} group by 1, 2"

    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in from_sessions(spark, sf_dir, text, sessions, select):
        out.setdefault(r["id"], {})[r["t_src"]] = r["k"], r["rb"]
    return out


def from_slabs(text: Text, genomes: Callable[[], list[Genome]]) -> Callable[[SparkSession, str], DataFrame]:
    """A text on a population whose scores come from slabs: no dense panel is written, the names that books can hold are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark, "slabs") as at:
            s = Slabs(spark, sf_dir, f"{at}/bars")
            wanted = rebalances(spark, sf_dir, text, s.sessions)
            trees = {g.id: g.tree for g in genomes() if g.id in wanted}
            return to_spark(text, **slab_scores.books(s, at, trees, wanted, f"{at}/bars"))(spark, sf_dir)

    return run


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shuffle_folds`` from slabs: the names that replicas can hold are all that leaves them."""
    with scratch(spark, "slabs") as at:
        s = Slabs(spark, sf_dir, at)
        rows = from_sessions(spark, sf_dir, _shuffle, s.sessions, lambda c: "select strategy, t_src, t_idx, rb from reb")
        given = s.shifted_books(BOOK, [tuple(r) for r in rows])
        # A column has the name of the relation ``score``, which would else be formed.
        return to_spark(_shuffle, score=given["lng"], **given)(spark, sf_dir)


GENOMES = {
    "population_fitness": population,
    "null_model": lambda: yardstick() + population(),
    "honest_walk_forward": lambda: [g for gs in searches().values() for g in gs],
    "family_survival": population,
}
QUERIES = {name: from_slabs(TEXTS[name], genomes) for name, genomes in GENOMES.items()} | {"shuffle_folds": shuffled}
