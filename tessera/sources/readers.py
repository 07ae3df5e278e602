"""Readers and writers of the raw formats, all as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed amount bands of disclosures and their midpoints.
BANDS = {
    "$1,001 - $15,000": 8000.0,
    "$15,001 - $50,000": 32500.0,
    "$50,001 - $100,000": 75000.0,
    "$100,001 - $250,000": 175000.0,
    "$250,001 - $500,000": 375000.0,
    "$500,001 - $1,000,000": 750000.0,
}
UNKNOWN_BAND = 8000.0
MISSING = (-99.99, -999.0, -9999.0)


def membership_log(spark: SparkSession, path: str) -> DataFrame:
    """A change log (date, comma list of tickers) -> intervals (symbol, valid_from, valid_to)."""
    raw = spark.read.csv(path, header=True).toDF("date", "tickers")
    steps = raw.select(F.to_date("date").alias("d"), "tickers").withColumn("until", F.lead("d").over(W.orderBy("d")))
    rows = steps.select("d", "until", F.explode(F.split("tickers", ",")).alias("s")).select("d", "until", F.trim("s").alias("symbol")).filter("symbol <> ''")
    # Neighbouring changes that both list a symbol are one interval.
    by = W.partitionBy("symbol").orderBy("d")
    fresh = rows.withColumn("new", F.when(F.lag("until").over(by) == F.col("d"), 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("new").over(by))
    open_end = F.max(F.col("until").isNull())
    return runs.groupBy("symbol", "run").agg(F.min("d").alias("valid_from"), F.when(open_end, F.lit(None)).otherwise(F.max("until")).alias("valid_to")).drop("run")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-delimited listing without funds, test issues, units, rights and warrants."""
    raw = spark.read.csv(path, sep="|", header=True, mode="DROPMALFORMED")
    ok = raw.filter((F.col("ETF") == "N") & (F.col("Test Issue") == "N") & F.col("Symbol").isNotNull())
    ok = ok.filter(~F.col("Symbol").rlike(r"[^A-Z]") & ~F.lower("Security Name").rlike(r"warrant|right|unit|preferred|depositary"))
    return ok.select(F.col("Symbol").alias("symbol"), F.col("Security Name").alias("name")).dropDuplicates(["symbol"]).orderBy("symbol")


def wide_rates(spark: SparkSession, path: str, base: str = "USD") -> DataFrame:
    """Wide currency rates against one anchor -> long rates against ``base``."""
    raw = spark.read.csv(path, header=True)
    names = [c for c in raw.columns if c != "Date"]
    long = raw.select(F.to_date("Date").alias("date"), *[F.col(n).try_cast("double").alias(n) for n in names]).unpivot(["date"], names, "symbol", "rate")
    anchor = long.filter(F.col("symbol") == base).select("date", F.col("rate").alias("anchor"))
    return long.join(anchor, "date").select("date", "symbol", F.try_divide("anchor", "rate").alias("close")).filter((F.col("symbol") != base) & F.col("close").isNotNull())


def economic_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A two-column series with gaps, carried forward."""
    raw = spark.read.csv(path, header=True).toDF("date", "value")
    s = raw.select(F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value"))
    named = s.withColumn("symbol", F.lit(name))
    filled = F.last("value", ignorenulls=True).over(W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return named.select("date", "symbol", filled.alias("close"))


def factor_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A factor file with prose around one block of daily rows; percent and sentinels converted."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "value"))
    row = F.trim("value").rlike(r"^\d{8}\s*,")
    order = W.partitionBy("file").orderBy("n")
    blocks = whole.withColumn("row", row).withColumn("run", F.sum(F.when(row, 0).otherwise(1)).over(order)).filter("row")
    parts = F.split("value", r"\s*,\s*")
    cols = [F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(c) for i, c in enumerate(names, 1)]
    first = blocks.withColumn("first", F.min("run").over(W.partitionBy("file"))).filter("run = first")
    out = first.select(F.to_date(F.trim(F.get(parts, F.lit(0))), "yyyyMMdd").alias("date"), *cols)
    return out.select("date", *[F.when(~F.col(c).isin(*MISSING), F.col(c) / 100).alias(c) for c in names])


def company_facts(spark: SparkSession, path: str, concepts: dict[str, list[str]], units: tuple[str, ...] = ("USD",)) -> DataFrame:
    """Nested filing JSON -> (symbol, concept, tag, start, end, filed, val, form); of a concept's tags the first present counts."""
    point = "struct<start:string,end:string,filed:string,val:double,form:string>"
    schema = f"symbol string, facts map<string, map<string, struct<units:map<string,array<{point}>>>>>"
    raw = spark.read.schema(schema).json(path)
    tags = raw.select("symbol", F.explode("facts").alias("taxonomy", "tags")).select("symbol", F.explode("tags").alias("tag", "body"))
    points = tags.select("symbol", "tag", F.explode("body.units").alias("unit", "points")).filter(F.col("unit").isin(*units)).select("symbol", "tag", F.explode("points").alias("p"))
    order = [(tag, concept, i) for concept, names in concepts.items() for i, tag in enumerate(names)]
    known = spark.createDataFrame(order, "tag string, concept string, priority int")
    ranked = points.join(F.broadcast(known), "tag").withColumn("best", F.min("priority").over(W.partitionBy("symbol", "concept")))
    dates = [F.to_date(f"p.{c}").alias(c) for c in ("start", "end", "filed")]
    return ranked.filter("priority = best").select("symbol", "concept", "tag", *dates, "p.val", "p.form")


def disclosures(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated disclosure index with amount bands turned into midpoints."""
    raw = spark.read.csv(path, sep="\t", header=True)
    mid = F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])
    day = lambda c: F.to_date(F.col(c), "M/d/yyyy")
    return raw.select(
        F.concat_ws(" ", "First", "Last").alias("member"),
        F.upper(F.trim("Ticker")).alias("ticker"),
        F.when(F.col("Type") == "P", "buy").otherwise("sell").alias("side"),
        day("Traded").alias("transaction_date"),
        day("Filed").alias("filing_date"),
        F.coalesce(F.try_element_at(mid, F.col("Amount")), F.lit(UNKNOWN_BAND)).alias("amount_mid"),
    ).withColumn("lag_days", F.datediff("filing_date", "transaction_date"))


def keep_last(existing: DataFrame, tail: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with newer rows of the same keys put in their place."""
    both = existing.withColumn("__batch", F.lit(0)).unionByName(tail.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.col("__batch").desc())
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__batch", "__n")


def append_daily(rows: DataFrame, path: str, day: str = "ds") -> None:
    """Append records to a table with one partition a day."""
    rows.write.mode("append").partitionBy(day).parquet(path)


def replace_market(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write the markets of ``rows`` anew and leave all others as they are; a repeat changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market").parquet(path)


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def theses(spark: SparkSession, path: str) -> DataFrame:
    """A store of theses: thesis, claim, statement, tickers (an array, empty without a proxy) and since, a row for each claim.

    A thesis counts from the day it was captured, or else recorded; one without
    claims has no row, and of theses with one id the last counts.
    """
    claim = "struct<id: string, statement: string, proxy: struct<tickers: array<string>>>"
    doc = spark.read.schema(f"theses array<struct<id: string, captured: string, recorded: string, claims: array<{claim}>>>").json(path, multiLine=True)
    each = doc.select(F.posexplode("theses").alias("nth", "t"))
    last = each.groupBy("t.id").agg(F.max_by("t", "nth").alias("t"))
    since = F.to_date(F.substring(F.coalesce("t.captured", "t.recorded"), 1, 10))
    rows = last.select(F.col("id").alias("thesis"), since.alias("since"), F.explode("t.claims").alias("c"))
    return rows.select("thesis", F.col("c.id").alias("claim"), "c.statement", F.coalesce("c.proxy.tickers", F.array().cast("array<string>")).alias("tickers"), "since")
