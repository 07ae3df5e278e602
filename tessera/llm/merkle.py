"""Merkle manifest of a dataset: ordered blocks of digests collapsed by higher-order SQL functions.

Leaves are numbered by source and id over ranges of the order, so no task sees a whole source.
Fixed-size blocks of consecutive nodes become arrays, and ``sequence``, ``transform``, ``slice``
and ``aggregate`` collapse all levels of a block at once. The roots of blocks are the nodes of the
next round, until every source has one node; then the sources' subroots are collapsed alike.
Proofs come back down the same rounds: only the last of them has a row for every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut, scratch

from .common import shuffle_partitions, table

#: Nodes of a run that become one.
FANOUT = 3
#: Levels that one block collapses: a block holds FANOUT ** LEVELS nodes at most.
LEVELS = 7
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The one tree that holds the sources' subroots.
_TOP = "top"


def encoded(c: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, colon, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and tampered (the leaf over a text without line feeds, where the id's crc32 is even)."""
    cols = {c: F.col(c) for c in COLUMNS}
    odd = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2) != 0
    bare = cols | {"text": F.regexp_replace("text", "\n", "")}
    return docs.select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source"))).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(*map(encoded, cols.values())).alias("digest"),
        F.when(F.coalesce(odd, F.lit(True)), F.lit(None).cast("string")).otherwise(digest(*map(encoded, bare.values()))).alias("tampered"),
    )


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its tree by ``order``, from 0, and ``n``, the rows of its tree.

    Rows are dealt by ranges of the order; a tree's counts per range give each
    range its offset, so a tree of a third of all rows is many tasks' work.
    """
    spark = nodes.sparkSession
    ranged = cut(nodes.repartitionByRange(shuffle_partitions(spark), "tree", *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("c"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"), F.sum("c").over(W.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(W.partitionBy("tree", "part").orderBy(*order)) - 1
    return ranged.withColumn("pos", inside).join(offsets, ["tree", "part"]).withColumn("pos", F.col("pos") + F.col("off")).drop("part", "off")


def _depth(n: str, levels: int) -> str:
    """SQL: levels that a block of a tree of ``n`` nodes collapses: all to one node, or ``levels`` where the tree has more blocks."""
    steps = " ".join(f"when {n} <= {FANOUT**j} then {j}" for j in range(levels))
    return f"case {steps} else {levels} end"


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Rows (tree, pos, n, digest, ...) -> one row a block: tree, block, n, rows (ordered) and ``lv``, the digests of every level."""
    rest = [c for c in nodes.columns if c not in ("tree", "n")]
    each = F.struct("pos", *[c for c in rest if c != "pos"])
    held = nodes.groupBy("tree", F.expr(f"pos div {FANOUT**levels}").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(each)).alias("rows"))
    last = "element_at(acc, -1)"
    up = f"transform(sequence(0, cast((size({last}) - 1) div {FANOUT} as int)), r -> sha2(cast(array_join(slice({last}, {FANOUT} * r + 1, {FANOUT}), '') as binary), 256))"
    steps = "if(depth > 0, sequence(1, depth), cast(array() as array<int>))"
    return (
        held.withColumn("depth", F.expr(_depth("n", levels)))
        .withColumn("lv", F.expr(f"aggregate({steps}, array(transform(rows, x -> x.digest)), (acc, j) -> concat(acc, array({up})))"))
        .drop("depth")
    )


def siblings(i: str) -> str:
    """SQL: for the node at ``i`` of a block, the text left and right of it at every level of ``lv`` but the last."""
    at = f"({i} div cast(pow({FANOUT}, j) as bigint))"
    level = "element_at(lv, j + 1)"
    left = f"array_join(slice({level}, cast({at} - {at} % {FANOUT} + 1 as int), cast({at} % {FANOUT} as int)), '')"
    right = f"array_join(slice({level}, cast({at} + 2 as int), cast({FANOUT - 1} - {at} % {FANOUT} as int)), '')"
    return f"transform(if(size(lv) > 1, sequence(0, size(lv) - 2), cast(array() as array<int>)), j -> named_struct('l', {left}, 'r', {right}))"


def collapse(nodes: DataFrame, levels: int, at: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks, written below ``at``, and each tree's root (tree, digest)."""
    spark, rounds = nodes.sparkSession, []
    while True:
        path = f"{at}/{len(rounds)}"
        blocks(nodes, levels).write.parquet(path)
        rounds.append(spark.read.parquet(path))
        # A round has as many nodes as the one before had blocks; the tree's size shrinks by the same factor.
        n = F.expr(f"(n + {FANOUT**levels - 1}) div {FANOUT**levels}")
        nodes = rounds[-1].select("tree", F.col("block").alias("pos"), n.alias("n"), F.expr("element_at(element_at(lv, -1), 1)").alias("digest"))
        most = nodes.agg(F.max("n")).first()[0]
        if most is None or most <= 1:
            return rounds, nodes.select("tree", "digest")


def descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The lowest round's blocks with ``path``, the steps from the block's root upwards; ``paths`` (tree, block, path) has those of the highest."""
    for held in reversed(rounds[1:]):
        steps = F.expr(f"transform(rows, (x, i) -> named_struct('block', x.pos, 'path', concat({siblings('i')}, path)))")
        paths = held.join(paths, ["tree", "block"]).select("tree", F.explode(steps).alias("s")).select("tree", "s.block", "s.path")
    return rounds[0].join(paths, ["tree", "block"])


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    A null in any column is the leaf's ``-``; an empty text counts zero bytes.
    Null ids come first in their source, rows with equal ids are ordered by
    leaf, and rows equal in every column are leaves of their own with proofs
    of their own. A null id is never tampered with. Extra columns do not
    count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch(spark, "merkle") as at:
        leaves(docs).write.parquet(f"{at}/leaves")
        rounds, subroots = collapse(numbered(spark.read.parquet(f"{at}/leaves"), ["doc_id", "digest"]), levels, f"{at}/sources")
        tops = numbered(subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
        top_rounds, roots = collapse(tops, levels, f"{at}/top")
        # The way from the top down: a tree of one node has no steps at all.
        none = F.expr("cast(array() as array<struct<l: string, r: string>>)")
        start = roots.select("tree", F.lit(0).cast("long").alias("block"), none.alias("path"))
        highest = descend(top_rounds, start).join(roots.withColumnRenamed("digest", "root"), "tree")
        each = F.expr(f"transform(rows, (x, i) -> named_struct('tree', x.source, 'subroot', x.digest, 'path', concat({siblings('i')}, path)))")
        upper = cut(highest.select("root", F.explode(each).alias("s")).select("s.tree", F.lit(0).cast("long").alias("block"), "s.path", "s.subroot", "root"))
        held = descend(rounds, upper.select("tree", "block", "path")).join(upper.select("tree", "subroot", "root"), "tree")
        line = F.expr(f"transform(rows, (x, i) -> named_struct('doc_id', x.doc_id, 'leaf', x.digest, 'seen', coalesce(x.tampered, x.digest), 'path', concat({siblings('i')}, path)))")
        folded = "aggregate(s.path, s.seen, (acc, x) -> sha2(cast(concat(x.l, acc, x.r) as binary), 256))"
        proof = "sha2(cast(array_join(transform(s.path, x -> concat(x.l, x.r)), '') as binary), 256)"
        out = held.select("subroot", "root", F.explode(line).alias("s")).select(
            "s.doc_id", "s.leaf", "subroot", "root", F.expr(proof).alias("proof_sha256"), F.expr(folded).alias("folded_root")
        )
        return cut(out.withColumn("verified", F.col("folded_root") == F.col("root")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def crc32_sql(hex_text: str) -> str:
    """DuckDB SQL: crc32 of the bytes whose upper-case hex digits are ``hex_text``."""
    nibble = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        nibble.append(c)
    lut = f"[{', '.join(map(str, nibble))}]::ubigint[]"
    # Two digits a byte, the low one first.
    digit = f"(strpos('0123456789ABCDEF', substr({hex_text}, 2 * ((i - 1) // 2) + 2 - (i - 1) % 2, 1)) - 1)"
    digits = f"list_transform(range(1, length({hex_text}) + 1), lambda i: {digit}::ubigint)"
    return f"xor(list_reduce({digits}, lambda a, d: xor(a >> 4, ({lut})[((xor(a, d) & 15) + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint)"


def _oracle(source_levels: int = 14, top_levels: int = 8) -> str:
    """The same manifest in DuckDB SQL, one relation for each level."""

    def part(c: str) -> str:
        s = f"{c}::varchar"
        return f"(case when {c} is null then '-' else octet_length(encode({s})) || ':' || {s} end)"

    leaf = " || ".join(map(part, COLUMNS))
    bare = leaf.replace("text", "bare")
    out = [
        "d as materialized (select *, replace(text, chr(10), '') as bare from documents)",
        f"l as materialized (select row_number() over () as id, case when source is null then 'n' else 'v' || source end as tree, doc_id, sha256({leaf}) as leaf, case when {crc32_sql('hex(encode(doc_id::varchar))')} % 2 = 0 then sha256({bare}) end as tampered from d)",
        "s0 as materialized (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf, id) - 1 as pos, leaf as h, id from l)",
        "p0 as materialized (select l.id, s0.tree, s0.pos, coalesce(l.tampered, l.leaf) as f, '' as sib from l join s0 using (id))",
    ]

    def level(a: str, b: str, p: str, q: str) -> None:
        out.append(f"{a}w as materialized (select *, count(*) over (partition by tree) as n, coalesce(string_agg(h, '') over (partition by tree, pos // {FANOUT} order by pos rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (partition by tree, pos // {FANOUT} order by pos rows between 1 following and unbounded following), '') as r from {a})")
        out.append(f"{b} as materialized (select tree, pos // {FANOUT} as pos, case when max(n) = 1 then min(h) else sha256(string_agg(h, '' order by pos)) end as h from {a}w group by tree, pos // {FANOUT})")
        out.append(f"{q} as materialized (select p.id, p.tree, p.pos // {FANOUT} as pos, case when w.n = 1 then p.f else sha256(w.l || p.f || w.r) end as f, p.sib || w.l || w.r as sib from {p} p join {a}w w on w.tree = p.tree and w.pos = p.pos)")

    for j in range(source_levels):
        level(f"s{j}", f"s{j + 1}", f"p{j}", f"p{j + 1}")
    end, last = f"s{source_levels}", f"p{source_levels}"
    out.append(f"t0 as materialized (select '{_TOP}' as tree, row_number() over (order by tree) - 1 as pos, h, tree as source from {end})")
    out.append(f"q0 as materialized (select p.id, t.tree, t.pos, p.f, p.sib from {last} p join t0 t on t.source = p.tree)")
    for j in range(top_levels):
        level(f"t{j}", f"t{j + 1}", f"q{j}", f"q{j + 1}")
    return "with " + ",\n".join(out) + f"""
select l.doc_id, l.leaf, s.h as subroot, t.h as root, sha256(q.sib) as proof_sha256, q.f as folded_root, q.f = t.h as verified
from l join q{top_levels} q using (id) join {end} s on s.tree = l.tree cross join t{top_levels} t"""


ORACLE_OP11 = _oracle()
