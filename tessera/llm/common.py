"""Shared pieces: tables, word pattern, and a distributed running total."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut

#: A word is a maximal run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over all rows up to this one in ``order``.

    ``order`` must be total up to rows that may be swapped freely. Rows are
    range-partitioned by it, each range is summed on its own, and the prefix
    sums of the ranges (one row per partition, so bounded by the partition
    count) are added. No task sees more than one range.
    """
    spark = df.sparkSession
    at, before, val = "__range", "__before", "__value"
    n = shuffle_partitions(spark)
    ranged = cut(df.withColumn(val, value).repartitionByRange(n, *order).withColumn(at, F.spark_partition_id()))
    sums = ranged.groupBy(at).agg(F.sum(val).alias("__s"))
    upto = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(at, F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias(before))
    inside = W.partitionBy(at).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(offsets), at)
        .withColumn(out, F.sum(val).over(inside) + F.col(before))
        .drop(at, before, val)
    )


def row_key(df: DataFrame) -> Column:
    """32 bytes that tell the rows of ``df`` apart by all their columns; only rows equal in every column share theirs."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]))
    text = F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n"))
    return F.unhex(F.sha2(F.concat(rest, text).cast("binary"), 256))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` packed in one, out of the way of any other name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python worker process, kept for its later tasks."""
    store = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
