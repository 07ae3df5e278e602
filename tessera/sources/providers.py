"""Bar providers behind one interface, a Spark data source over them, and the incremental cache of what they gave."""

from __future__ import annotations

import datetime as dt
import os
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.session import cut

from .readers import keep_last

FIELDS = ("open", "high", "low", "close", "volume")
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


class Provider(ABC):
    """Where bars come from. A subclass names its symbols and fetches one of them."""

    def symbol(self, ticker: str) -> str:
        """The provider's own spelling of a ticker."""
        return ticker

    @abstractmethod
    def fetch(self, ticker: str, start: str, end: str) -> pd.DataFrame | None:
        """Columns date and FIELDS from ``start`` to before ``end``; None or empty for nothing."""


_REGISTRY: dict[str, Callable[..., Provider]] = {}


def register_provider(name: str):
    def add(make: Callable[..., Provider]) -> Callable[..., Provider]:
        _REGISTRY[name] = make
        return make

    return add


def get_provider(name: str, **options: str) -> Provider:
    if name not in _REGISTRY:
        raise ValueError(f"no provider {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


@register_provider("files")
class FileProvider(Provider):
    """One CSV a symbol in a folder, under the symbol's own name; dots are written as dashes."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def symbol(self, ticker: str) -> str:
        return ticker.replace(".", "-")

    def fetch(self, ticker: str, start: str, end: str) -> pd.DataFrame | None:
        at = os.path.join(self.folder, f"{self.symbol(ticker)}.csv")
        if not os.path.exists(at):
            return None
        got = pd.read_csv(at)
        got.columns = [c.strip().lower() for c in got.columns]
        got["date"] = pd.to_datetime(got["date"], utc=True).dt.tz_localize(None).dt.normalize()
        return got[(got["date"] >= pd.Timestamp(start)) & (got["date"] < pd.Timestamp(end))].sort_values("date")


def patiently(provider: Provider, ticker: str, start: str, end: str, tries: int = 3, pause: float = 0.5) -> pd.DataFrame | None:
    """Fetch with retries; the last error is raised."""
    for k in range(tries):
        try:
            return provider.fetch(ticker, start, end)
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    return None


def _rows(provider: Provider, ticker: str, start: str, end: str) -> Iterator[tuple]:
    got = patiently(provider, ticker, start, end)
    if got is not None:
        for r in got.itertuples(index=False):
            yield (ticker, r.date.date(), *(None if pd.isna(v) else float(v) for v in (getattr(r, f, None) for f in FIELDS)))


class _Part(InputPartition):
    def __init__(self, tickers: list[str]) -> None:
        super().__init__(",".join(tickers))
        self.tickers = tickers


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        tickers = [t for t in self.options["symbols"].split(",") if t]
        n = int(self.options.get("batch", "50"))
        return [_Part(tickers[i : i + n]) for i in range(0, len(tickers), n)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        own = {"provider", "symbols", "start", "end", "batch"}
        provider = get_provider(self.options["provider"], **{k: v for k, v in self.options.items() if k not in own})
        for t in partition.tickers:
            yield from _rows(provider, t, self.options["start"], self.options["end"])


class BarsSource(DataSource):
    """``spark.read.format("bars")`` with options provider, symbols, start, end, batch and the provider's own."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def bars(spark: SparkSession, provider: str, symbols: list[str], start: str, end: str, **options: str) -> DataFrame:
    """The bars of many symbols; batches of them are fetched by different tasks."""
    spark.dataSource.register(BarsSource)
    return spark.read.format("bars").options(provider=provider, symbols=",".join(symbols), start=start, end=end, **options).load()


def refresh(spark: SparkSession, path: str, wanted: DataFrame, provider: str, start: str, end: str, retry_days: int = 7, today: dt.date | None = None, **options: str) -> DataFrame:
    """Bring the cache at ``path`` up to ``end`` for the symbols ``wanted`` (column symbol) and return it.

    Only what follows a symbol's last bar is fetched, that bar again included;
    the newer row of a day stays. A symbol that gave nothing at all is noted and
    left alone for ``retry_days``. Only symbols with new rows are written anew.
    """
    today = today or dt.date.today()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())

    def stored(name: str, schema: str) -> DataFrame:
        at = f"{path}/{name}"
        return spark.read.schema(schema).parquet(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at)) else spark.createDataFrame([], schema)

    old, missing = stored("bars", BARS), stored("missing", "symbol string, day date")
    quiet = missing.filter(F.col("day") > F.lit(today - dt.timedelta(days=retry_days))).select("symbol").distinct()
    last = old.groupBy("symbol").agg(F.max("date").alias("last"))
    plan = wanted.select("symbol").distinct().join(quiet, "symbol", "left_anti").join(last, "symbol", "left")
    plan = plan.select("symbol", F.coalesce(F.col("last").cast("string"), F.lit(start)).alias("since"))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = get_provider(provider, **options)
        for f in frames:
            for s, since in zip(f["symbol"], f["since"], strict=True):
                rows = list(_rows(own, s, since, end))
                yield pd.DataFrame(rows or [(s, None, *[None] * 5)], columns=["symbol", "date", *FIELDS])

    got = cut(plan.mapInPandas(fetch, BARS))
    none = got.filter("date is null").select("symbol").join(last, "symbol", "left_anti")
    none.select("symbol", F.lit(today).alias("day")).write.mode("append").parquet(f"{path}/missing")
    tail = got.filter("date is not null")
    touched = old.join(tail.select("symbol").distinct(), "symbol", "left_semi")
    merged = cut(keep_last(touched, tail, ["symbol", "date"]))
    merged.select("date", *FIELDS, "symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(f"{path}/bars")
    return spark.read.schema(BARS).parquet(f"{path}/bars")
