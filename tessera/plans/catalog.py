"""The named queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import coefficient_queries, driver_queries, evaluation_queries, feature_queries, population_queries, relation_queries, series_queries, strategy_queries
from .sql import Text, to_oracle, to_spark


def texts() -> dict[str, Text]:
    out: dict[str, Text] = {}
    for module in (series_queries, relation_queries, feature_queries, evaluation_queries, coefficient_queries, population_queries, strategy_queries):
        clash = out.keys() & module.TEXTS.keys()
        if clash:
            raise ValueError(f"defined twice: {sorted(clash)}")
        out |= module.TEXTS
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["backtest_stats"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: to_spark(text) for name, text in texts().items()} | series_queries.QUERIES | relation_queries.QUERIES | feature_queries.QUERIES | evaluation_queries.QUERIES | coefficient_queries.QUERIES | population_queries.QUERIES | strategy_queries.QUERIES | driver_queries.QUERIES


def oracles() -> dict[str, str]:
    return {name: to_oracle(text) for name, text in texts().items()} | driver_queries.ORACLES
