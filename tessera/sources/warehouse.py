"""The warehouse: tables of record in the session's catalog, loads that can be repeated, an audit trail, and SQL over all."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables and their columns; those of PARTITIONS are partition columns.
TABLES = {
    "markets": "symbols bigint, sessions bigint, first_date date, last_date date, source string, caveat string, market string",
    "prices": "symbol string, date date, open double, high double, low double, close double, volume double, market string",
    "strategies": "id string, title string, market string, caveat string, sharpe double, t_stat double, total double",
    "curves": "id string, n bigint, date date, value double",
    "transactions": "member string, ticker string, side string, transaction_date date, filing_date date, amount_mid double",
    "factors": "date date, mkt_rf double, smb double, hml double, rmw double, cma double, mom double, rf double",
    "runs": "at timestamp, what string, detail string, n bigint",
}
PARTITIONS = {"markets": "market", "prices": "market"}


def fit_columns(df: DataFrame, schema: str, rename: dict[str, str] | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: renamed, cast, and null where they are missing."""
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


class Warehouse:
    """``name`` is the database, ``path`` the shared folder that holds its tables."""

    def __init__(self, spark: SparkSession, path: str, name: str = "warehouse") -> None:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a database name: {name!r}")
        self.spark, self.path, self.name = spark, path, name
        spark.sql(f"create database if not exists {name}")
        for t, columns in TABLES.items():
            part = f" partitioned by ({PARTITIONS[t]})" if t in PARTITIONS else ""
            spark.sql(f"create table if not exists {name}.{t} ({columns}) using parquet{part} location '{path}/{t}'")

    def _write(self, df: DataFrame, table: str, mode: str) -> int:
        fitted = fit_columns(df, TABLES[table])
        out = fitted.write.mode(mode)
        if table in PARTITIONS:
            out = out.option("partitionOverwriteMode", "dynamic").partitionBy(PARTITIONS[table])
        out.parquet(f"{self.path}/{table}")
        if table in PARTITIONS:
            self.spark.sql(f"alter table {self.name}.{table} recover partitions")
        self.spark.catalog.refreshTable(f"{self.name}.{table}")
        return fitted.count()

    def audit(self, what: str, detail: str, n: int) -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(what).alias("what"), F.lit(detail).alias("detail"), F.lit(n).cast("long").alias("n"))
        self._write(row, "runs", "append")

    def load_market(self, market: str, bars: DataFrame, source: str = "", caveat: str = "") -> int:
        """Put a market's bars in place of what it had; other markets stay. Rows without a close are left out."""
        rows = bars.filter("close is not null").withColumn("market", F.lit(market)).withColumn("symbol", F.col("symbol").cast("string"))
        n = self._write(rows, "prices", "overwrite")
        about = rows.agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("date").alias("sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        self._write(about.select("*", F.lit(source).alias("source"), F.lit(caveat).alias("caveat"), F.lit(market).alias("market")), "markets", "overwrite")
        self.audit("load_market", market, n)
        return n

    def load_strategies(self, path: str) -> int:
        """A JSON document of strategies, each with its statistics and a curve of (day, value) pairs -> two tables."""
        schema = "strategies array<struct<id:string,title:string,market:string,caveat:string,sharpe:double,t_stat:double,total:double,curve:array<array<string>>>>"
        each = self.spark.read.schema(schema).json(path, multiLine=True).select(F.explode("strategies").alias("s")).select("s.*")
        n = self._write(each, "strategies", "overwrite")
        points = each.select("id", F.posexplode("curve").alias("n", "p"))
        self._write(points.select("id", "n", F.to_date(F.get("p", F.lit(0))).alias("date"), F.get("p", F.lit(1)).try_cast("double").alias("value")), "curves", "overwrite")
        self.audit("load_strategies", path, n)
        return n

    def load_transactions(self, rows: DataFrame) -> int:
        n = self._write(rows, "transactions", "overwrite")
        self.audit("load_transactions", "", n)
        return n

    def load_factors(self, rows: DataFrame, rename: dict[str, str] | None = None) -> int:
        """Factor rows under any of the usual names; missing columns are null, rows without a day are dropped."""
        usual = {"Mkt-RF": "mkt_rf", "SMB": "smb", "HML": "hml", "RMW": "rmw", "CMA": "cma", "Mom": "mom", "RF": "rf", "Date": "date"}
        fitted = fit_columns(rows, TABLES["factors"], {k: v for k, v in (usual | (rename or {})).items() if k in rows.columns})
        n = self._write(fitted.filter("date is not null"), "factors", "overwrite")
        self.audit("load_factors", "", n)
        return n

    def counts(self, names: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
        """(name, n) of tables; one that does not exist counts as empty."""
        parts = [self.spark.table(f"{self.name}.{t}").agg(F.lit(t).alias("name"), F.count("*").alias("n")) if self.spark.catalog.tableExists(f"{self.name}.{t}") else self.spark.createDataFrame([(t, 0)], "name string, n long") for t in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def query(self, sql: str, **args) -> DataFrame:
        """Any one reading statement over the tables (by their bare names), with named parameters like ``:limit``."""
        if not re.match(r"\s*(select|with|show|describe)\b", sql, re.I) or ";" in sql:
            raise ValueError("only one reading statement")
        before = self.spark.catalog.currentDatabase()
        self.spark.catalog.setCurrentDatabase(self.name)
        try:
            return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)
        finally:
            self.spark.catalog.setCurrentDatabase(before)

    def drop(self) -> None:
        """Forget the database; the folder's files stay."""
        self.spark.sql(f"drop database if exists {self.name} cascade")
