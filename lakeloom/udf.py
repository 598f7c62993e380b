"""User functions: scalar, aggregate with mergeable state, table functions, replacement scans and macros."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Functions:
    """A registry of overloads by argument count or types."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._scalar: dict[str, list[tuple[tuple[str, ...] | None, Callable]]] = {}
        self._scans: list[Callable[[str], DataFrame | None]] = []

    def scalar(self, name: str, f: Callable, returns: str, parameters: Sequence[str] | None = None, volatile: bool = False, nulls: bool = False) -> Callable[..., Column]:
        """f takes one pandas Series per argument if marked by `vectorised`, else values; null arguments give null unless nulls."""
        if getattr(f, "vectorised", False):
            made = F.pandas_udf(f, returns)
        else:

            def over(*columns: pd.Series) -> pd.Series:
                return pd.Series([None if not nulls and any(x is None or x is pd.NA for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype="object")

            # a variadic pandas function needs no type hints if its evaluation type is named
            from pyspark.sql.pandas.functions import PandasUDFType

            made = F.pandas_udf(over, returns, PandasUDFType.SCALAR)
        if volatile:
            made = made.asNondeterministic()
        self._scalar.setdefault(name.lower(), []).append((tuple(parameters) if parameters is not None else None, made))
        self._spark.udf.register(name, made)
        return made

    def call(self, name: str, df: DataFrame, *columns: str) -> Column:
        """The overload that fits the types of the columns, exactly or else by count."""
        kinds = tuple(df.schema[c].dataType.simpleString() for c in columns)
        found = self._scalar.get(name.lower(), [])
        fits = [f for p, f in found if p == kinds] or [f for p, f in found if p is None or len(p) == len(columns)]
        if not fits:
            raise KeyError(f"no overload of {name} takes {', '.join(kinds)}")
        return fits[0](*(F.col(c) for c in columns))

    def replacement_scan(self, callback: Callable[[str], DataFrame | None]) -> None:
        """callback gets the name of a table that the catalog doesn't have."""
        self._scans.append(callback)

    def table(self, name: str) -> DataFrame:
        if self._spark.catalog.tableExists(name):
            return self._spark.table(name)
        for scan in self._scans:
            if (found := scan(name)) is not None:
                return found
        from .sources.readers import scan_path

        return scan_path(self._spark, name)


def vectorised(f: Callable) -> Callable:
    f.vectorised = True
    return f


#: Tasks whose states of a key are merged in one place before those of all tasks are.
FAN_IN = 64


def mergeable_aggregate(df: DataFrame, keys: Sequence[str], column: str, init: Callable[[], object], update: Callable, combine: Callable, finish: Callable, state: str, returns: str, name: str = "value") -> DataFrame:
    """An aggregate of init, update, combine and finish: a state per key and task, then states merged per key.

    update(state, value) takes a value, or, marked by `vectorised`, all values of a key in a batch as a pandas Series.
    `state` is the SQL type of a state, so only states are shuffled. Merging reads states in order of their keys, so it
    holds one state at a time and costs a call per state, not per group. A key may be in any number of tasks: the states
    of FAN_IN tasks meet first, so no task gets one state per input task for a frequent key unless there are few.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    narrow = df.select(*(_one_zero(df, k) for k in keys), F.col(column).alias("_x"))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, object] = {}
        for frame in frames:
            if getattr(update, "vectorised", False):
                parts = frame.groupby(list(keys), dropna=False, sort=False)["_x"] if keys else [((), frame["_x"])]
                rows = ((key if isinstance(key, tuple) else (key,), values) for key, values in parts)
            else:
                rows = ((row[:-1], row[-1]) for row in frame.itertuples(index=False, name=None))
            for key, value in rows:
                states[key] = update(states[key] if key in states else init(), value)
            if len(states) > 100_000:
                yield _frame(states)
                states = {}
        yield _frame(states)

    def _frame(states: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, v) for k, v in states.items()], columns=[*keys, "_state"])

    def merge(last: bool):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made, current, total = [], None, None
            names = [*keys, name if last else "_state"]
            for frame in frames:
                for *key, s in zip(*(frame[k] for k in keys), frame["_state"], strict=True):
                    key = [None if k is pd.NaT or k != k else k for k in key]  # a null may come as NaN, which equals nothing
                    if key == current:
                        total = combine(total, s)
                        continue
                    if current is not None:
                        made.append((*current, finish(total) if last else total))
                    current, total = key, s
                if len(made) > 100_000:
                    yield pd.DataFrame(made, columns=names)
                    made = []
            if current is not None:
                made.append((*current, finish(total) if last else total))
            yield pd.DataFrame(made, columns=names)

        return work

    def by(states: DataFrame, columns: Sequence[str]) -> DataFrame:
        return states.repartition(*columns).sortWithinPartitions(*columns) if columns else states.repartition(1)

    states = narrow.mapInPandas(partial, f"{kinds}, _state {state}" if keys else f"_state {state}")
    dealt = states.withColumn("_deal", F.floor(F.spark_partition_id() / FAN_IN))
    half = by(dealt, [*keys, "_deal"]).drop("_deal").mapInPandas(merge(False), states.schema)
    return by(half, keys).mapInPandas(merge(True), f"{kinds}, `{name}` {returns}" if keys else f"`{name}` {returns}")


def _one_zero(df: DataFrame, key: str) -> Column:
    """A key of which -0.0 and 0.0 are one value, as they are in groups."""
    kind = df.schema[key].dataType
    return (F.col(key) + F.lit(0.0)).cast(kind).alias(key) if isinstance(kind, T.FloatType | T.DoubleType) else F.col(key)


def table_function(spark: SparkSession, name: str, rows: Callable[..., Iterator[tuple]], schema: str) -> Callable[..., DataFrame]:
    """A function of literals that yields rows, usable in SQL's FROM."""

    class Rows:
        def eval(self, *args):
            yield from rows(*args)

    made = F.udtf(Rows, returnType=schema)
    spark.udtf.register(name, made)
    return lambda *args: made(*(a if isinstance(a, Column) else F.lit(a) for a in args))


def parallel_table_function(spark: SparkSession, parts: int, rows: Callable[[int], Iterator[tuple]], schema: str | T.StructType) -> DataFrame:
    """A table of which rows(k) makes the k-th part on an executor."""
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"]:
                yield pd.DataFrame(list(rows(int(k))), columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(work, schema)


def scalar_macro(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL expression with parameters (name type [DEFAULT value], ...); Catalyst inlines it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def table_macro(spark: SparkSession, name: str, parameters: str, columns: str, query: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
