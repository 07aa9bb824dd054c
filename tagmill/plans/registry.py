"""The registered queries, and how a query of one logical input is added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagmill.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def over(source: str, name: str, oracle: str | None = None):
    """Registers a query of one logical input; the oracle's {s} stands for it."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, d: f(fx.frame(spark, d, source))
        if oracle:
            ORACLES[name] = oracle.replace("{s}", f"({fx.LINES_DUCK if source is fx.LINES_SPARK else source})")
        return f

    return add


def of_many(sources: dict[str, str], name: str, oracle: str | None = None):
    """Registers a query of several logical inputs, given to the function by name; {name} in the oracle stands for each."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, d: f(**{k: fx.frame(spark, d, sql) for k, sql in sources.items()})
        if oracle:
            text = oracle
            for k, sql in sources.items():
                text = text.replace("{" + k + "}", f"({sql})")
            ORACLES[name] = text
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
