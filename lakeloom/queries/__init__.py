"""Registered queries: each a function of (spark, sf_dir) and, where SQL can say it, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """A Spark SQL query over tables named in braces."""
        import re

        found = set(re.findall(r"\{(\w+)\}", text)) | set(names)
        return self.spark.sql(text, **{n: getattr(self, n) for n in found})


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with DuckDB's text of the same query."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def sql(key: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query that is Spark SQL over tables in braces; the oracle is the same text without braces unless given."""
    query(oracle or spark_sql.replace("{", "").replace("}", ""), name=key)(lambda t: t.sql(spark_sql))


def load() -> None:
    from . import aggregates, dialect, functions, joins, relational, shapes, windows  # noqa: F401
