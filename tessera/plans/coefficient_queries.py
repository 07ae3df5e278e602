"""Information coefficients of all features: those of prices, filings, peers, macro series and moving averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import series as S
from tessera.operators import evaluation as E
from tessera.operators.features import FAMILIES, PRICE_FEATURES, family_of
from tessera.operators.slabs import Slabs
from tessera.session import cut, scratch, tidy

from . import evaluation_queries as V
from . import feature_queries as X
from . import series_queries
from .sql import Chain, Text, rounded, to_spark

TEXTS: dict[str, Text] = {}
#: Features that read another table than bars, or fold over a whole history.
OTHERS = ("macd_hist", *X.FUNDAMENTALS, "f_days_since_filing", *X.PEER_FEATURES, *(f"m_{n}" for n in X.MACRO_FEATURES))
FEATURES = (*PRICE_FEATURES, *OTHERS)
#: A feature is constant where its names hardly differ in more than this share of its sessions.
FLAT, FLAT_SHARE = "1e-6", 0.9


def others(c: Chain) -> str:
    """Relation ``ofw``: the panel with every feature of ``OTHERS``."""
    X._fundamental(c)
    X._peer(c)
    X.macro_features(c)
    series_queries.TEXTS["ema_macd"](c)
    names = ", ".join(("o.macd_hist", *(f"f.{n}" for n in (*X.FUNDAMENTALS, "f_days_since_filing")), *(f"q.{n}" for n in X.PEER_FEATURES), *(f"m.m_{n}" for n in X.MACRO_FEATURES)))
    c.add("ofw", f"""select p.symbol, p.t_idx, p.tradable, {names} from panel p left join o on o.symbol = p.symbol and o.t_idx = p.t_idx
        left join fc f on f.symbol = p.symbol and f.t_idx = p.t_idx left join po q on q.symbol = p.symbol and q.t_idx = p.t_idx left join mf m on m.t_idx = p.t_idx""", keep=True)
    return "ofw"


def all_coefficients(c: Chain) -> str:
    """Relation ``ica``: every feature's mean coefficient and t, or why it has none: constant across names, or too few sessions."""
    V.feature_ic(c)
    if "oic" not in c.parts:  # given with ``ospread`` from slabs, they read no panel, which must not be written then
        others(c)
        V.long_features(c, "ofw", OTHERS, "symbol, t_idx, tradable", "feature", "ol")
        E.ic_series(c, "ol", "x", "oic", h=V.IC_HORIZON, key="feature")
    c.add("oic_m", f"select g as feature, avg(ic) as mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*) / {V.IC_HORIZON}e0) as t_stat, count(*) as n from oic group by g")
    c.add("ospread", f"select feature, t_idx, case when stddev_pop(x) / ({S.at_least('avg(abs(x))')}) < {FLAT} then 1e0 else 0e0 end as flat from ol where tradable and x is not null group by feature, t_idx having count(*) >= 2")
    c.add("oflat", "select feature, avg(flat) as flat from ospread group by feature")
    c.values("oname", "feature", ((n,) for n in OTHERS))
    ok = f"m.n >= {V.LEAST_IC_DAYS}"
    c.add("oica", f"select v.feature, coalesce(m.n, 0) as n, case when {ok} then m.mean_ic end as mean_ic, case when {ok} then m.t_stat end as t_stat, case when f.flat > {FLAT_SHARE} then 'constant' when {ok} then 'ok' else 'too few sessions' end as reason from oname v left join oflat f on f.feature = v.feature left join oic_m m on m.feature = v.feature")
    cases = " ".join(f"when '{n}' then '{family_of(n)}'" for n in FEATURES)
    c.add("ica", f"select q.*, case feature {cases} end as family from (select feature, n, mean_ic, t_stat, reason from ficm union all select feature, n, mean_ic, t_stat, reason from oica) q")
    return "ica"


def _table(c: Chain) -> str:
    all_coefficients(c)
    return c.select(f"select feature, family, n, reason, {rounded('mean_ic', 't_stat')} from ica")


def _families(c: Chain) -> str:
    all_coefficients(c)
    c.values("fams", "family", ((f,) for f in FAMILIES))
    c.add("fam_i", "select family, avg(abs(mean_ic)) as avg_ic, max(abs(mean_ic)) as max_ic, count(*) as n, count(mean_ic) as scored from ica group by family")
    return c.select(f"select f.family, coalesce(i.n, 0) as n, coalesce(i.scored, 0) as scored, {rounded('avg_ic', 'max_ic')} from fams f left join fam_i i on i.family = f.family")


TEXTS |= {"feature_ic_all": _table, "family_ic_all": _families}


def macro_from(slabs: Slabs):
    """A text of the macro features' rows for ``ospread``; the raw series are the slabs' mean closes."""

    def text(c: Chain) -> str:
        c.add("mraw", f"select q.k, {c.d.add_days('s.date', '-(q.k % 3)')} as day, q.v from closes q join sessions s on s.t_idx = q.t_idx where (s.t_idx + q.k) % 5 <> 0")
        X.macro_features(c)
        pairs = ", ".join(f"'m_{n}', round(m_{n}, 8)" for n in X.MACRO_FEATURES)
        c.add("ml", f"select t_idx, feature, x from mf lateral view stack({len(X.MACRO_FEATURES)}, {pairs}) __s as feature, x")
        return c.select("select l.feature, l.t_idx, cast(null as double) as ic, cast(null as bigint) as n, 1e0 as flat from ml l join held h on h.t_idx = l.t_idx where l.x is not null and h.kn >= 2")

    return to_spark(text, closes=cut(slabs.mean_closes(len(X.MACRO_SERIES))), sessions=slabs.sessions, held=slabs.sums)


#: Features of filings and moving averages that travel to their sessions in one pass.
OF_NAMES = ("macd_hist", *X.FUNDAMENTALS, "f_days_since_filing")
AT_ONCE = 8


def _run(text: Text):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All from slabs: filings travel to them as steps, peers' coefficients are formed in their pieces, macro series are sums over slabs."""
        rules = (V.IC_HORIZON, V.LEAST_IC_NAMES)
        with scratch(spark, "slabs") as at:
            slabs = Slabs(spark, sf_dir, at)
            got = slabs.coefficients(*rules)
            parts = [cut(X.peer_blocks(slabs).judged(*rules, float(FLAT)))]
            tidy(spark)
            filed = X.filings(slabs, sf_dir)
            for i in range(0, len(OF_NAMES), AT_ONCE):
                parts.append(cut(filed.judged(OF_NAMES[i : i + AT_ONCE], *rules, float(FLAT))))
                tidy(spark)
            parts.append(cut(macro_from(slabs)(spark, sf_dir)))
        others = reduce(DataFrame.unionByName, parts)
        fic = got.filter("t_idx >= 0").selectExpr("feature as g", "t_idx", "ic", "n")
        fvar = got.filter("t_idx < 0").selectExpr("feature", "n as seen", "hi > lo as varies")
        oic = others.filter("ic is not null").selectExpr("feature as g", "t_idx", "ic", "n")
        return to_spark(text, fic=fic, fvar=fvar, oic=oic, ospread=others.select("feature", "t_idx", "flat"))(spark, sf_dir)

    return run


QUERIES = {name: _run(text) for name, text in TEXTS.items()}
