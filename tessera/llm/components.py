"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def _hook(edges: DataFrame, keep: str) -> DataFrame:
    """Link every neighbour of u that ``keep`` selects to the smallest node around u.

    The smallest neighbour is pre-aggregated, then joined back; a hot u is a
    plain skewed join side, which AQE can split.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = edges.join(low, "u")
    if keep == "large":
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (u, root): each linked node with the smallest node it reaches.

    Roots themselves and unlinked nodes are not listed. Every round is written
    to the checkpoint folder, so no lineage grows and a lost executor costs
    one round at most. The loop ends when a round changes nothing.
    """
    edges = cut(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, "large").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = cut(_hook(large.distinct(), "small"))
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select("u", F.col("v").alias("root"))
