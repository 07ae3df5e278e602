"""Windows of sessions by any function of numpy, for what no built-in aggregate says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of windows that are held as one matrix.
CELLS = 2_000_000


def roll_apply(df: DataFrame, x: Column, fn: Callable[..., np.ndarray], w: int, out: str, past: bool = False, by: str = "symbol", order: str = "t_idx") -> DataFrame:
    """Add ``out``: ``fn(window, axis=1)`` over the last ``w`` rows of each ``by``, this one included.

    With ``past`` over the ``w`` rows before this one, and missing until there
    are ``w``; without, the first windows are shorter. A missing value is NaN
    within a window, and a result that is no finite number is missing. Rows of
    equal ``order`` are taken in any order. Frames are gathered by the engine,
    after its only exchange; ``fn`` gets many of equal length at once.
    """
    frame = W.partitionBy(by).orderBy(order).rowsBetween(-w, -1) if past else W.partitionBy(by).orderBy(order).rowsBetween(1 - w, 0)
    names = df.columns
    framed = df.withColumn("__frame", F.collect_list(F.coalesce(x.cast("double"), F.lit(float("nan")))).over(frame))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // w)
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                windows = part.column(part.num_columns - 1)
                size = windows.value_lengths().to_numpy()
                flat, edge = windows.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
                got = np.full(len(size), np.nan)
                for n in np.unique(size):
                    if n == 0 or (past and n < w):
                        continue
                    at = np.flatnonzero(size == n)
                    with np.errstate(all="ignore"):
                        got[at] = fn(flat[edge[at][:, None] + np.arange(n)], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, mask=~np.isfinite(got))], names=[*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` double"])
    return framed.mapInArrow(run, schema)
