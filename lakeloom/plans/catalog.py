"""Catalog views, sequences, enumerations, prepared statements and settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import with_row_number


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables, of the current database and the temporary views."""
    rows = [(t.catalog, ".".join(t.namespace or []), t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE", t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string, temporary boolean")


def columns(spark: SparkSession) -> DataFrame:
    """information_schema.columns."""
    rows = [(t.name, f.name, k, "YES" if f.nullable else "NO", f.dataType.simpleString()) for t in spark.catalog.listTables() for k, f in enumerate(spark.table(t.name).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET -v").select(F.col("key").alias("name"), "value", F.col("meaning").alias("description"))


def functions(spark: SparkSession) -> DataFrame:
    from ..functions.registry import names

    return spark.createDataFrame([(n,) for n in sorted({*names(), *(f.name for f in spark.catalog.listFunctions())})], "function_name string")


def databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.locationUri) for d in spark.catalog.listDatabases()], "database_name string, path string")


#: Sequences that were given a name.
SEQUENCES: dict[str, Sequence_] = {}


class Sequence_:
    """NEXTVAL and CURRVAL on the driver, and numbering whole tables without gaps."""

    def __init__(self, start: int = 1, increment: int = 1, name: str | None = None):
        self._next, self._increment, self._last = start, increment, None
        if name:
            SEQUENCES[name] = self

    def nextval(self) -> int:
        self._last, self._next = self._next, self._next + self._increment
        return self._last

    def currval(self) -> int:
        if self._last is None:
            raise ValueError("nextval was not called yet")
        return self._last

    def number(self, df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        """df with the sequence's next values in order; the sequence moves past them."""
        out = with_row_number(df, order, name)
        start = self._next
        self._next += self._increment * out.count()
        return out.withColumn(name, (F.col(name) - 1) * self._increment + start)


class Enumeration:
    """An ENUM type: strings ordered by their place."""

    def __init__(self, *values: str):
        self.values = list(values)

    def order(self, c: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, self.values)), c)

    def check(self, c: Column) -> Column:
        return c.isin(self.values) | c.isNull()

    def first(self) -> str:
        return self.values[0]

    def last(self) -> str:
        return self.values[-1]

    def range(self) -> list[str]:
        return list(self.values)


class Prepared:
    """PREPARE, EXECUTE and DEALLOCATE over spark.sql() with parameters ? or :name."""

    def __init__(self, spark: SparkSession):
        self._spark, self._texts = spark, {}

    def prepare(self, name: str, text: str) -> None:
        self._texts[name] = text

    def execute(self, name: str, *args, **named) -> DataFrame:
        return self._spark.sql(self._texts[name], args=named or list(args))

    def deallocate(self, name: str) -> None:
        del self._texts[name]


def alter(df: DataFrame, add: dict[str, Column] | None = None, drop: Sequence[str] = (), rename: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """ALTER TABLE as a projection."""
    out = df.drop(*drop)
    out = out.withColumnsRenamed(rename or {})
    out = out.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})
    return out.withColumns(add or {})


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
