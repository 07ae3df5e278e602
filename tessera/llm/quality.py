"""Quality rules on DataFrame functions alone: base counts and distribution divergence.

The histogram of a document's character classes and the histogram of its
common words are compared with those of its language by the Jensen-Shannon
distance (square root of the divergence, base 2, in 0..1). The references are
the sums over all documents of the language. Short documents, whose
histograms are noise, are not judged by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

from .common import table, whole_row

# Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that for was on are with as be by at from or an it".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
}
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "space", "upper", "letter", "digit", "symbol", "mark", "rest")

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Largest distances that are kept, and the fewest characters or words judged.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.30
MIN_CLASS_CHARS = 400
MIN_HISTOGRAM_WORDS = 80


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """How many words lie in a window of five that occurs twice or more.

    Windows are compared by a 64-bit hash of their five words.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                before = (k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])
                after = (k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])
                return before | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        found = _let(_let(ranked, starts), covered)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(found)

    def run(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        grams = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
        return F.when(F.size(w) > WINDOW, _let(grams, repeats)).otherwise(F.lit(0))

    return _let(words, run)


def _one_of(words: list[str]):
    return lambda w: w.isin(*words)


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One slim row per document: base counts, class counts, common-word counts; ``carry`` adds the row itself."""
    row = [whole_row(docs)] if carry else []
    carried = ["__row"] if carry else []
    kept = docs.select(
        *row,
        F.col("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("")).alias("lang"),
    )
    trimmed = F.btrim(F.col("text"), F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    step = kept.select(
        *carried,
        "doc_id",
        "lang",
        words.alias("words"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        F.length("text").alias("n_chars"),
        F.regexp_replace("text", "[a-z]+", "").alias("r1"),
    )
    listed = F.lit(None).cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, common))).otherwise(listed)
    left, sizes = step.withColumn("listed", listed), []
    for i, pattern in enumerate([SPACE, "[A-Z]+", r"\p{L}+", r"\p{N}+", SYMBOLS, r"\p{P}+"], 1):
        left = left.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, ""))
        sizes.append(F.length(f"r{i}") - F.length(f"r{i + 1}"))
    classes = F.array(F.col("n_chars") - F.length("r1"), *sizes, F.length("r7")).cast("array<long>")
    lower = F.transform("words", F.lower)
    found = F.array().cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        found = F.when(F.col("lang") == lang, F.filter(lower, _one_of(common))).otherwise(found)
    spaced = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    out = left.select(
        *carried,
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        sizes[4].cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        "listed",
        spaced.alias("spaced"),
    )

    def hits(w: Column) -> Column:
        without = F.replace(F.col("spaced"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))
        return ((F.octet_length("spaced") - F.octet_length(without)) / (F.octet_length(w) + 2)).cast("long")

    return out.withColumn("common", F.transform("listed", hits)).drop("spaced", "listed")


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """language -> class shares and common-word shares over all its documents.

    At most one row per listed language and one for the others comes back.
    """
    n = len(CLASSES)
    k = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(k)] + [F.sum("n_words").alias("words")]
    out = {}
    for r in measured.groupBy("lang").agg(*sums).collect():
        total = sum(r[f"c{i}"] or 0 for i in range(n))
        shares = [(r[f"c{i}"] or 0) / total if total else 0.0 for i in range(n)]
        common: list[float] = []
        if r["lang"] in COMMON_WORDS and r["words"]:
            common = [(r[f"w{i}"] or 0) / r["words"] for i in range(len(COMMON_WORDS[r["lang"]]))]
            common.append(max(0.0, 1.0 - sum(common)))
        out[r["lang"]] = (shares, common)
    return out


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a row's array of shares from a fixed reference."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
        other = F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))
        return own + other

    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_class_chars: int = MIN_CLASS_CHARS,
    min_histogram_words: int = MIN_HISTOGRAM_WORDS,
) -> DataFrame:
    """Base counts, base verdict, distances and the final ``kept`` of every document.

    Null text counts as empty and fails the base rule. A null or unlisted
    language shares one reference of its own and is judged by character
    classes only. Repeated rows are judged each; empty input gives no rows;
    extra columns are dropped. ``class_distance`` and ``word_distance`` are
    null where the length guards leave a document unjudged.
    """
    measured = cut(measures(docs))
    known = references(measured)
    limits = (max_class_distance, max_word_distance, min_class_chars, min_histogram_words)
    return _verdicts(measured, known, *limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The references are gathered first; the verdict is then found again row by
    row, so texts are read twice but never shuffled.
    """
    known = references(measures(docs))
    # The row number keeps the filter above the measures: pushed below, it would
    # find every one of them anew inside its lambdas.
    measured = measures(docs, carry=True).withColumn("__nth", F.monotonically_increasing_id())
    judged = _verdicts(measured, known, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CLASS_CHARS, MIN_HISTOGRAM_WORDS)
    return judged.filter(F.col("kept") & (F.col("__nth") >= 0)).select("__row.*")


def _verdicts(measured: DataFrame, known: dict, max_class_distance: float, max_word_distance: float, min_class_chars: int, min_histogram_words: int) -> DataFrame:
    """Add the distances, ``base_failed`` and ``kept``."""
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = F.lit(None).cast("double")
    by_word = F.lit(None).cast("double")
    for lang, (shares, common) in sorted(known.items()):
        here = F.col("lang") == lang
        own = F.transform("classes", lambda c: c / F.col("chars"))
        by_class = F.when(here & (F.col("chars") >= min_class_chars), js_distance(own, shares)).otherwise(by_class)
        if common:
            share = F.transform("common", lambda c: c / F.col("n_words"))
            rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(share, F.lit(0.0), lambda a, x: a + x))
            by_word = F.when(here & (F.col("n_words") >= min_histogram_words), js_distance(F.concat(share, F.array(rest)), common)).otherwise(by_word)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured.withColumn("chars", n_chars)
        .withColumn("class_distance", by_class)
        .withColumn("word_distance", by_word)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False)) & ~F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)))
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _oracle() -> str:
    """The same rules in DuckDB SQL, from the same constants."""
    word = r"[^\x20\x09-\x0D]+"
    removed, chain = "regexp_replace(text, '[a-z]+', '', 'g')", []
    for i, p in enumerate([r"[\x20\x09-\x0D]+", "[A-Z]+", r"\p{L}+", r"\p{N}+", SYMBOLS, r"\p{P}+"], 1):
        chain.append(f"x{i} as (select *, regexp_replace(r{i}, '{p}', '', 'g') as r{i + 1} from {'w' if i == 1 else f'x{i - 1}'})")
    parts = ["length(text) - length(r1)", *(f"length(r{i}) - length(r{i + 1})" for i in range(1, 7)), "length(r7)"]
    lists = " ".join(f"when '{lang}' then {words!r}" for lang, words in COMMON_WORDS.items())
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as text,
         case when lang in ({", ".join(map(repr, COMMON_WORDS))}) then lang else '' end as lang
  from documents),
w as (
  select row_number() over () as id, *, regexp_extract_all(text, '{word}') as ws, {removed} as r1,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) as ls
  from d),
{", ".join(chain)},
m as (
  select id, doc_id, lang, len(ws)::bigint as n_words,
         list_sum(list_transform(ws, lambda x: length(x)))::bigint as wc,
         (length(r5) - length(r6))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         [{", ".join(parts)}]::bigint[] as classes,
         list_transform(case lang {lists} else null end,
           lambda c: len(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: x = c)))::bigint[] as common
  from x6),
g as (
  select id, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) > 5),
h as (select id, i, count(*) over (partition by id, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) as n from g),
k as (select id, sum(least(5, i - before))::bigint as n_repeat_words
      from (select id, i, lag(i, 1, i - 5) over (partition by id order by i) as before from h where n > 1) group by id),
rc as (select lang, j, sum(c)::double / sum(sum(c)) over (partition by lang) as q
       from (select lang, unnest(classes) as c, unnest(range(1, 9)) as j from m) group by lang, j),
rw as (select a.lang, a.j, a.s::double / b.n as q
       from (select lang, j, sum(c) as s from (select lang, unnest(common) as c, unnest(range(1, len(common) + 1)) as j from m where common is not null) group by lang, j) a
       join (select lang, sum(n_words) as n from m group by lang) b using (lang)),
rws as (select lang, j, q from rw union all select lang, max(j) + 1, greatest(0, 1 - sum(q)) from rw group by lang),
dc as (select m.id, rc.q, m.classes[rc.j]::double / nullif(list_sum(m.classes), 0) as p from m join rc using (lang) where list_sum(m.classes) >= {MIN_CLASS_CHARS}),
dw as (select m.id, r.q, case when r.j <= len(m.common) then m.common[r.j]::double / m.n_words
         else greatest(0, 1 - list_sum(m.common)::double / m.n_words) end as p
       from m join rws r using (lang) where m.n_words >= {MIN_HISTOGRAM_WORDS}),
js as (select id, t, sqrt(greatest(0, sum((case when p > 0 then p * log2(2 * p / (p + q)) else 0 end)
         + (case when q > 0 then q * log2(2 * q / (p + q)) else 0 end)) / 2)) as dist
       from (select id, 'c' as t, p, q from dc union all select id, 'w', p, q from dw) group by id, t),
f as (
  select m.*, coalesce(k.n_repeat_words, 0) as n_repeat_words,
         coalesce((select dist from js where js.id = m.id and t = 'c') > {MAX_CLASS_DISTANCE}, false)
         or coalesce((select dist from js where js.id = m.id and t = 'w') > {MAX_WORD_DISTANCE}, false) as far
  from m left join k using (id))
select doc_id, n_words, coalesce(wc, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and not far as kept
from f
"""


ORACLE_OP2 = _oracle()
