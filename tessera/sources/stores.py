"""Small stores and the remaining raw formats: JSON state, documents, zipped and headered tables, cached tables."""

from __future__ import annotations

import copy
import html
import io
import json
import math
import os
import re
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import expression as X
from tessera.operators.trading import Order, PaperBroker

# ---- JSON ---------------------------------------------------------------------


def clean(value):
    """The value with every number that JSON has no form for as null."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(path: str, value) -> None:
    """Write the whole document beside ``path`` and move it there, so a reader never meets half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(clean(value), f, indent=1, sort_keys=True, default=str, allow_nan=False)
    os.replace(aside, path)


def read_json(path: str, default=None):
    """The document, or ``default`` where there is none or it is broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def outermost_object(text: str, required: tuple[str, ...] = ()) -> dict | None:
    """The JSON object from the first brace to the last in a text with prose around it, if it holds what is required."""
    m = re.search(r"\{.*\}", text, re.S)
    try:
        got = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return got if isinstance(got, dict) and all(k in got for k in required) else None


def override(config: dict, changes: dict[str, object]) -> dict:
    """A copy of a config tree with values at dotted paths replaced; an unknown path is an error."""
    out = copy.deepcopy(config)
    for path, value in changes.items():
        *parents, leaf = path.split(".")
        node = out
        for p in parents:
            node = node[p]
        if leaf not in node:
            raise KeyError(path)
        node[leaf] = value
    return out


def number(x: float | None, kind: str = "plain", digits: int = 2) -> str:
    """A number for a report: plain, percent, signed, or money; a dash for none."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return "-"
    return {"plain": f"{x:,.{digits}f}", "percent": f"{100 * x:.{digits}f}%", "signed": f"{x:+,.{digits}f}", "money": f"{'-' if x < 0 else ''}${abs(x):,.{digits}f}"}[kind]


def report(title: str, sections: dict[str, list[dict]]) -> str:
    """An HTML page with one table a section; everything is escaped."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if not rows:
            parts.append("<p>nothing</p>")
            continue
        head = "".join(f"<th>{html.escape(str(k))}</th>" for k in rows[0])
        body = "".join("<tr>" + "".join(f"<td>{html.escape(number(v) if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
        parts.append(f"<table><tr>{head}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"


# ---- state --------------------------------------------------------------------


def save_broker(path: str, b: PaperBroker) -> None:
    """Cash, shares, resting orders, and the last rows of the blotter."""
    write_json(path, {"cash": b.cash, "shares": b.shares, "pending": [vars(o) for o in b.pending], "blotter": b.blotter[-b.keep :]})


def load_broker(path: str) -> PaperBroker:
    s = read_json(path)
    if not s:
        return PaperBroker()
    return PaperBroker(cash=s["cash"], shares=s["shares"], pending=[Order(**o) for o in s["pending"]], blotter=s["blotter"])


def save_search(path: str, archive: dict, seen: dict[str, float], history: list[dict], arms: dict[str, tuple[dict, dict]]) -> None:
    """All that a search goes on from: elites by cell, what has been tried, its history, and the bandits."""
    cells = [{"cell": list(k), "fitness": f, "tree": n.to_dict()} for k, (f, n) in sorted(archive.items())]
    write_json(path, {"archive": cells, "seen": seen, "history": history, "arms": {k: {"good": g, "tried": t} for k, (g, t) in arms.items()}})


def load_search(path: str) -> tuple[dict, dict[str, float], list[dict], dict[str, tuple[dict, dict]]]:
    s = read_json(path, {"archive": [], "seen": {}, "history": [], "arms": {}})
    archive = {tuple(r["cell"]): (r["fitness"], X.from_dict(r["tree"])) for r in s["archive"]}
    return archive, s["seen"], s["history"], {k: (v["good"], v["tried"]) for k, v in s["arms"].items()}


def definitions(state: dict, limit: int = 5) -> list[tuple[str, X.Node]]:
    """(name, tree) of the strategies to trade: the promoted ones, or else the best of the archive; broken entries are passed over."""
    listed = state.get("promoted") or sorted(state.get("archive", []), key=lambda r: -(r.get("fitness") or 0.0))
    out = []
    for i, r in enumerate(listed):
        try:
            out.append((str(r.get("name", f"s{i}")), X.from_dict(r["tree"])))
        except (KeyError, ValueError, TypeError, AttributeError):
            continue
        if len(out) == limit:
            break
    return out


def upsert(existing: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows added or put in place of those with their key."""
    return existing.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


# ---- tables -------------------------------------------------------------------


def landed(path: str, fetch: Callable[[], bytes], ttl_s: float = math.inf, now: float | None = None) -> str:
    """A file fetched once and kept for ``ttl_s`` seconds; when a later fetch fails the stale file serves on."""
    now = time.time() if now is None else now
    have = os.path.exists(path)
    if have and now - os.path.getmtime(path) < ttl_s:
        return path
    try:
        body = fetch()
    except Exception:
        if have:
            return path
        raise
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(body)
    os.replace(f"{path}.part", path)
    return path


def join_factors(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Factor tables side by side on all days that any has; of columns with one name the first table's stays."""
    out = first
    for o in others:
        fresh = [c for c in o.columns if c != "date" and c not in out.columns]
        out = out.join(o.select("date", *fresh), "date", "full_outer")
    return out


def zipped_rates(spark: SparkSession, path: str) -> DataFrame:
    """A ZIP with one wide table of currency rates -> (date, symbol, rate) of what is a number."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for body in f["content"]:
                with zipfile.ZipFile(io.BytesIO(body)) as z, z.open(z.namelist()[0]) as inner:
                    for wide in pd.read_csv(inner, chunksize=5000):
                        wide = wide.loc[:, [c for c in wide.columns if not c.startswith("Unnamed")]]
                        long = wide.melt("Date", var_name="symbol", value_name="rate")
                        long["rate"] = pd.to_numeric(long["rate"], errors="coerce")
                        long["date"] = pd.to_datetime(long["Date"]).dt.date
                        yield long.dropna(subset=["rate"])[["date", "symbol", "rate"]].assign(symbol=lambda d: d["symbol"].str.strip())

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "date date, symbol string, rate double")


def rebase(rates: DataFrame, base: str = "USD") -> DataFrame:
    """Rates against one anchor -> closes against ``base``, the base itself left out."""
    anchor = rates.filter(F.col("symbol") == base).select("date", F.col("rate").alias("anchor"))
    return rates.filter(F.col("symbol") != base).join(anchor, "date").select("date", "symbol", F.try_divide("anchor", "rate").alias("close")).filter("close is not null")


def sniffed_series(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A CSV whose header may stand below other lines: its date and close columns, found by name."""
    lines = [r["value"] for r in spark.read.text(path).limit(50).collect()]
    at = next((i for i, v in enumerate(lines) if "date" in v.lower() and "," in v), None)
    if at is None:
        raise ValueError(f"no header with a date in {path}")
    names = [c.strip().strip('"').lower() for c in lines[at].split(",")]
    day = next(i for i, c in enumerate(names) if "date" in c)
    close = next((i for want in ("close", symbol.lower(), "value") for i, c in enumerate(names) if want in c), len(names) - 1)
    parts = F.split("value", ",")
    get = lambda i: F.trim(F.regexp_replace(F.get(parts, F.lit(i)), '"', ""))
    date = F.coalesce(*[F.try_to_timestamp(get(day), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy")])
    return spark.read.text(path).select(date.alias("date"), F.lit(symbol).alias("symbol"), get(close).try_cast("double").alias("close")).filter("date is not null and close is not null")


def company_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of numbered entries -> (ticker, cik), ciks padded to ten digits; the first entry of a ticker counts."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.posexplode(F.map_values(F.from_json("value", "map<string,struct<cik_str:long,ticker:string,title:string>>"))).alias("n", "e"))
    rows = entries.select(F.upper(F.trim("e.ticker")).alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), "n")
    return rows.filter("ticker is not null and cik is not null").groupBy("ticker").agg(F.min_by("cik", "n").alias("cik"))


def cached_facts(spark: SparkSession, path: str, tickers: DataFrame) -> DataFrame:
    """Filings on disk of the wanted tickers only; nothing is fetched."""
    return spark.read.parquet(path).join(tickers.select("symbol").distinct(), "symbol", "left_semi")


def save_transactions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_market(bars: DataFrame, path: str, market: str, about: dict) -> None:
    """A market's bars as its partition of the store, and what is known about it as plain JSON beside."""
    bars.withColumn("market", F.lit(market)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market").parquet(f"{path}/bars")
    spark = bars.sparkSession
    note = spark.createDataFrame([(market, json.dumps(clean(about), sort_keys=True))], "market string, about string")
    note.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market").parquet(f"{path}/about")


def load_market(spark: SparkSession, path: str, market: str) -> tuple[DataFrame, dict]:
    bars = spark.read.parquet(f"{path}/bars").filter(F.col("market") == market)
    note = spark.read.parquet(f"{path}/about").filter(F.col("market") == market).first()
    return bars, json.loads(note["about"]) if note else {}
