"""Streaming forms of the incremental operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessera.session import cut
from tessera.sources.readers import keep_last

HALF_LIFE = 60.0


def latest_heartbeat(beats: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """worker -> its last heartbeat, late beats within ``delay`` included."""
    return beats.withWatermark("ts", delay).groupBy("worker").agg(F.max("ts").alias("seen"))


def liveness(seen: DataFrame, now, live_s: int = 180, stale_s: int = 900) -> DataFrame:
    age = F.unix_timestamp(now) - F.unix_timestamp("seen")
    return seen.select("worker", age.alias("age"), F.when(age <= live_s, "live").when(age <= stale_s, "stale").otherwise("dead").alias("state"))


def versions(facts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each filing once: a late restatement is a new version by its own filing day, never an edit."""
    return facts.withWatermark("filed", delay).dropDuplicatesWithinWatermark(["symbol", "end_date", "filed"])


def windowed(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def decayed_posterior(state: tuple, rewards, half_life: float = HALF_LIFE, mu0: float = 0.0, k0: float = 1.0) -> tuple:
    """Fold rewards into a normal-inverse-gamma posterior (mu, kappa, alpha, beta, n) that forgets."""
    mu, kappa, alpha, beta, n = state
    d = 0.5 ** (1 / half_life)
    for x in rewards:
        kappa, beta, alpha = kappa * d, beta * d, 2 + (alpha - 2) * d
        beta += 0.5 * kappa / (kappa + 1) * (x - mu) ** 2
        mu = (kappa * mu + x) / (kappa + 1)
        kappa, alpha, n = kappa + 1, alpha + 0.5, n + 1
    return mu, kappa, alpha, beta, n


def posteriors(rewards: DataFrame) -> DataFrame:
    """arm, x (streaming) -> the running posterior of every arm."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0.0, 1.0, 2.0, 1.0, 0)
        for f in frames:
            now = decayed_posterior(now, f.sort_values("ts")["x"])
        now = tuple(float(v) for v in now[:4]) + (int(now[4]),)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["arm", "mu", "kappa", "alpha", "beta", "n"])

    schema = "arm string, mu double, kappa double, alpha double, beta double, n long"
    return rewards.groupBy("arm").applyInPandasWithState(update, schema, "mu double, kappa double, alpha double, beta double, n long", "update", "NoTimeout")


def merge_tail(path: str, keys: list[str], part: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows added to the table at ``path`` or put in place of those with their keys.

    Only the partitions ``part`` that a batch touches are written anew. A batch
    that runs twice leaves what one run does.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        # Within a batch the last row of a key counts, by its own order of arrival.
        order = W.partitionBy(*keys).orderBy(F.col("arrived").desc()) if "arrived" in batch.columns else W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in batch.columns])
        rows = cut(batch.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k"))
        if there:
            old = spark.read.schema(batch.schema).parquet(path).join(rows.select(part).distinct(), part, "left_semi")
            rows = cut(keep_last(old.select(*batch.columns), rows, keys))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    return merge


def freshness(seen: DataFrame, now, limits: dict[str, int]) -> DataFrame:
    """(source, seen) -> its age in seconds and whether that is within the source's limit; one unknown source halts nothing."""
    limit = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in limits.items()], F.lit(None).cast("int"))
    age = F.unix_timestamp(now) - F.unix_timestamp("seen")
    return seen.select("source", age.alias("age_s"), limit.alias("limit_s"), F.coalesce(age <= limit, F.lit(True)).alias("fresh"))


def last_seen(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("source").agg(F.max("ts").alias("seen"))


def debounced(changes: DataFrame, hold_s: int = 20) -> DataFrame:
    """source, ts, value (streaming) -> each value once it has been the source's last for ``hold_s`` seconds of event time.

    A value that holds is given when a later event of its source shows that it
    did, or when the watermark passes the end of its hold.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, since, given = state.get if state.exists else (None, 0, None)
        out = []
        if state.hasTimedOut:
            if value is not None and value != given:
                out.append((key[0], since, value))
                given = value
        else:
            rows = pd.concat(list(frames)).sort_values("ts")
            for ts, v in zip(rows["ts"], rows["value"], strict=True):
                at = int(ts.timestamp() * 1000)
                if value is not None and value != given and at - since >= hold_s * 1000:
                    out.append((key[0], since, value))
                    given = value
                if v != value:
                    value, since = v, at
        state.update((value, since, given))
        if value is not None and value != given:
            state.setTimeoutTimestamp(max(since + hold_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source": [o[0] for o in out], "since": pd.to_datetime([o[1] for o in out], unit="ms"), "value": [o[2] for o in out]})

    return changes.groupBy("source").applyInPandasWithState(update, "source string, since timestamp, value string", "value string, since long, given string", "append", "EventTimeTimeout")


def resting_orders(lines: DataFrame) -> DataFrame:
    """Orders and opens of symbols (streaming) -> fills: an order rests until the first open of a later bar than its own.

    Columns symbol, bar, kind (order or open), side, amount (the notional of an
    order, the price of an open). An order's cost is five basis points.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = json.loads(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames))
        # An open of a bar comes before the orders placed in it.
        rows = rows.sort_values(["bar", "kind"], key=lambda c: c if c.name == "bar" else c.map({"open": 0, "order": 1}))
        for r in rows.itertuples(index=False):
            if r.kind == "order":
                pending.append([int(r.bar), r.side, float(r.amount)])
                continue
            for bar, side, notional in [p for p in pending if p[0] < r.bar]:
                price = r.amount * (1 + 5e-4 if side == "buy" else 1 - 5e-4)
                out.append((key[0], int(r.bar), side, notional / price, price))
            pending = [p for p in pending if p[0] >= r.bar]
        state.update((json.dumps(pending),))
        yield pd.DataFrame(out, columns=["symbol", "bar", "side", "qty", "price"])

    return lines.groupBy("symbol").applyInPandasWithState(update, "symbol string, bar long, side string, qty double, price double", "pending string", "append", "NoTimeout")


def append_series(existing: DataFrame, rows: DataFrame, cap: int = 2000) -> DataFrame:
    """An equity series (ts, value) with new rows behind it: a value equal to the one before is left out, the last ``cap`` stay."""
    order = W.orderBy("ts")
    both = existing.select("ts", "value").unionByName(rows.select("ts", "value"))
    changed = both.withColumn("was", F.lag("value").over(order)).filter("was is null or was <> value").select("ts", "value")
    return changed.orderBy(F.col("ts").desc()).limit(cap).orderBy("ts")


def equity_sink(spark: SparkSession, path: str, cap: int = 2000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the capped series at ``path``, a few thousand rows, rewritten as one file."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        at = own._jvm.org.apache.hadoop.fs.Path(path)
        old = own.read.parquet(path) if at.getFileSystem(own._jsc.hadoopConfiguration()).exists(at) else own.createDataFrame([], batch.select("ts", "value").schema)
        cut(append_series(old, batch, cap)).coalesce(1).write.mode("overwrite").parquet(path)

    return write


class PosteriorFold(StatefulProcessor):
    """Keeps an arm's posterior and its last reward's time; an arm that is silent for ``quiet_s`` of event time is forgotten.

    Rewards of a batch are folded in order of time. The posterior is a value
    state, totals by source are a map state, and the timer is moved to the end
    of the quiet period whenever the arm is heard of.
    """

    def __init__(self, half_life: float, quiet_s: int) -> None:
        self.half_life, self.quiet_ms = half_life, quiet_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("posterior", "mu double, kappa double, alpha double, beta double, n long")
        self.by_source = handle.getMapState("by_source", "source string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["ts", "x"], kind="stable")
        state = tuple(self.now.get()) if self.now.exists() else (0.0, 1.0, 2.0, 1.0, 0)
        state = decayed_posterior(state, f["x"], self.half_life)
        self.now.update((*map(float, state[:4]), int(state[4])))
        for source, n in f["source"].value_counts().items():
            seen = self.by_source.getValue((source,))[0] if self.by_source.containsKey((source,)) else 0
            self.by_source.updateValue((source,), (int(seen + n),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(f["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.quiet_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)
        self.now.clear()
        self.by_source.clear()

    def _row(self, key: tuple, gone: bool) -> pd.DataFrame:
        mu, kappa, alpha, beta, n = self.now.get()
        sources = sum(1 for _ in self.by_source.keys())
        return pd.DataFrame([(key[0], mu, kappa, alpha, beta, n, sources, gone)], columns=["arm", "mu", "kappa", "alpha", "beta", "n", "sources", "gone"])

    def close(self) -> None:
        pass


def forgetting_posteriors(rewards: DataFrame, half_life: float = HALF_LIFE, quiet_s: int = 86_400, delay: str = "0 seconds") -> DataFrame:
    """arm, source, ts, x (streaming) -> an arm's posterior after each batch that has it, and a last row (``gone``) once it has been silent.

    The session needs RocksDB as its state store. Rewards older than the
    watermark are dropped.
    """
    schema = "arm string, mu double, kappa double, alpha double, beta double, n long, sources long, gone boolean"
    rows = rewards.withWatermark("ts", delay).groupBy("arm")
    return rows.transformWithStateInPandas(PosteriorFold(half_life, quiet_s), schema, "Update", "EventTime")


def experience_sink(rows: DataFrame, path: str, checkpoint: str, day: str = "ts") -> DataStreamWriter:
    """Rows (streaming) appended to a table of daily partitions; a writer to be started with any trigger.

    The sink's log makes a batch that runs again after a crash count once.
    A later run may bring further columns; see ``experience``.
    """
    dated = rows.withColumn("day", F.to_date(day))
    return dated.writeStream.format("parquet").outputMode("append").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)


def experience(spark: SparkSession, path: str) -> DataFrame:
    """All rows of ``experience_sink`` in the columns that any of its files has; what a file lacks is missing in its rows."""
    return spark.read.option("mergeSchema", "true").parquet(path)
