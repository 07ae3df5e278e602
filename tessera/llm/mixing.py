"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut

from .common import WORD, row_key, running_total, table, whole_row

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
#: Hex digits of the shuffle key that split one source's queue over tasks.
SPLIT_DIGITS = 3


def source_targets(sources: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``src_rank``, ``weight`` and ``target`` to rows (src, src_null, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all sizes. A target stops at ``epochs`` times its source's size; what is
    cut off is shared again by weight until no target is above its cap.
    """
    ranked = running_total(sources, [F.col("src_null"), F.col("src")], F.lit(1), "src_rank")
    nth = F.pmod(F.col("src_rank") - 1, F.lit(len(weights)))
    weight = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        weight = F.when(nth == i, F.lit(w)).otherwise(weight)
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs))
    level: float | None = None
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        got = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("cap"))).alias("capped"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
        ).first()
        if not got["free"]:
            break
        now = float((got["total"] or 0) - (got["capped"] or 0)) / float(got["free"])
        if level is not None and now <= level:
            break
        level = now
    share = F.lit(level or 0.0) * F.col("weight")
    capped = F.col("cap").cast("double")
    return ranked.withColumn("target", F.when(capped < share, capped).otherwise(share)).drop("cap")


def mix(
    docs: DataFrame,
    size: Column | None = None,
    epochs: int = EPOCHS,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
) -> DataFrame:
    """Decide how many words of each document the mix takes.

    Every source is a queue of its documents in a shuffled order (MD5 of the
    id and a seed), run through up to ``epochs`` times. A copy's virtual finish
    time is the source's cumulative size up to and with it, divided by the
    source's target. All copies are range-sorted by finish time and taken
    until the total budget, the size of all documents, is used up.

    Null text has size 0; documents of size 0 take 0. A null source is a
    source of its own. Repeated ids stay separate rows. Empty input gives no
    rows. Extra columns are dropped. Returns doc_id, size, source_size,
    target, taken, and the integer ``copies``; ``key`` is the row's key. Rows
    equal in id and text are put in order by their other columns, rows equal in
    all columns may be swapped freely.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)) if size is None else size
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    slim = docs.select(
        "doc_id",
        row_key(docs).alias("key"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("src_null"),
        size.cast("long").alias("size"),
        key.alias("shuffle_key"),
        F.substring(key, 1, SPLIT_DIGITS).alias("part"),
    )
    slim = cut(slim)
    # Pre-aggregated by part of the queue, so a hot source is never one group.
    parts = slim.groupBy("src", "src_null", "part").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy("src", "src_null").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sources, epochs, weights)
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    earlier = W.partitionBy("src", "src_null").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    queue = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    queue = queue.join(targets, ["src", "src_null"]).drop("part_size", "weight")
    inside = W.partitionBy("src", "src_null", "part").orderBy("shuffle_key", "doc_id", "size", "key")
    inside = inside.rowsBetween(W.unboundedPreceding, 0)
    queued = slim.join(queue, ["src", "src_null", "part"]).withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
    queued = cut(queued.select("doc_id", "key", "size", "source_size", "target", "src_rank", "upto"))

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")

    live = (F.col("size") > 0) & (F.col("target") > 0)
    copies = queued.filter(live).select("size", "src_rank", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.select("size", "src_rank", finish(F.col("epoch").cast("long")).alias("finish"))
    ordered = running_total(copies, [F.col("finish"), F.col("src_rank")], F.col("size"), "used")
    last = ordered.filter(F.col("used") <= F.lit(total)).agg(F.max(F.struct("finish", "src_rank")).alias("m")).first()["m"]
    taken = F.lit(0)
    if last is not None:
        for e in range(epochs):
            f = finish(F.lit(e).cast("long"))
            hit = (f < F.lit(last["finish"])) | ((f == F.lit(last["finish"])) & (F.col("src_rank") <= F.lit(last["src_rank"])))
            taken = taken + F.when(hit, F.lit(1)).otherwise(F.lit(0))
    n = F.when(live, taken).otherwise(F.lit(0)).cast("int")
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("copies"), "key")


def repeat_taken(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all, or up to three times).

    Null and blank texts have no words and are left out. Rows equal in every
    column count together, any other difference keeps rows apart. An empty
    table stays empty; all columns are kept.
    """
    taken = mix(docs).groupBy("key").agg(F.sum("copies").alias("n")).filter("n > 0").withColumnRenamed("key", "__key")
    keyed = docs.select(whole_row(docs), row_key(docs).alias("__key")).dropDuplicates(["__key"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return keyed.join(taken, "__key").withColumn("__copy", copies).select("__row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies", "key")


ORACLE_OP5 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':17') as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by (source is null), encode(source)) as r
  from d group by source),
w as (select *, ((r - 1) % 3 + 1)::bigint as weight, 3 * source_size as cap from s),
c as (
  select *, sum(cap) over o - cap as capped, sum(weight) over () - (sum(weight) over o - weight) as free_w,
         sum(source_size) over () as total
  from w window o as (order by cap::double / weight, r rows unbounded preceding)),
t as (
  select c.source, c.r, c.source_size, c.total,
         case when c.cap::double < f.level * c.weight then c.cap::double else f.level * c.weight end as target
  from c, (select (total - capped)::double / free_w::double as level from c
           where cap::double / weight >= (total - capped)::double / free_w::double
           order by cap::double / weight, r limit 1) f),
q as (
  select d.doc_id, d.size, t.source_size, t.target, t.r, t.total,
         sum(d.size) over (partition by t.r order by d.k, d.doc_id, d.size rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source),
x as (
  select q.*, e.e, (e.e * source_size + upto)::double / target as fin
  from q, (select unnest([0, 1, 2])::bigint as e) e where size > 0 and target > 0),
y as (select *, sum(size) over (order by fin, r rows unbounded preceding) as used from x),
z as (select doc_id, r, upto, sum(size)::bigint as taken from y where used <= total group by all)
select q.doc_id, q.size::bigint as size, q.source_size::bigint as source_size, q.target,
       coalesce(z.taken, 0)::bigint as taken
from q left join z on q.doc_id is not distinct from z.doc_id and q.r = z.r and q.upto = z.upto and q.size > 0
"""
