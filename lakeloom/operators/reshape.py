"""Pivot, unpivot, series, unnesting and table summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivot(df: DataFrame, keys: Sequence[str], column: str, aggregates: dict[str, Column], values: Sequence | None = None) -> DataFrame:
    """One column per value (found in the data if not given) and aggregate, named value or value_alias."""
    if values is None:
        values = [x[0] for x in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(10_001).collect()]
        if len(values) > 10_000:
            raise ValueError("more than 10,000 values to pivot; name those wanted")
    columns = []
    for v in values:
        for alias, how in aggregates.items():
            name = str(v) if len(aggregates) == 1 else f"{v}_{alias}"
            columns.append(F.expr(_filtered(how, column, v)).alias(name) if isinstance(how, str) else how(F.col(column) == F.lit(v)).alias(name))
    return df.groupBy(*keys).agg(*columns)


def _filtered(how: str, column: str, value) -> str:
    text = str(value).replace("'", "\\'")
    return f"{how} FILTER (WHERE `{column}` = '{text}')"


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> DataFrame:
    out = df.unpivot(list(keys), list(columns), name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def series(spark: SparkSession, start, stop, step=1, inclusive: bool = True, name: str = "generate_series") -> DataFrame:
    """generate_series (inclusive) or range: whole numbers from spark.range, dates and timestamps through a day or second count."""
    if isinstance(start, int):
        if step == 0:
            raise ValueError("step is zero")
        end = stop + (1 if step > 0 else -1) * inclusive
        return spark.range(start, end, step).select(F.col("id").alias(name))
    import datetime

    timed = isinstance(start, datetime.datetime)
    step = step if isinstance(step, datetime.timedelta) else datetime.timedelta(days=step)
    n = (stop - start) // step
    n = n + 1 if inclusive or (stop - start) % step else n
    micros = step // datetime.timedelta(microseconds=1)
    rows = spark.range(max(0, n))
    at = F.lit(start.isoformat(" ") if timed else start.isoformat()).cast("timestamp_ntz" if timed else "timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * F.lit(micros) / 1_000_000).cast("decimal(18,6)"))
    return rows.select(at.cast("timestamp_ntz" if timed else "date").alias(name))


def unnest(df: DataFrame, column: str, name: str = "unnest", ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """A row per element; null and empty lists give none, unless outer."""
    if ordinality:
        f = F.posexplode_outer if outer else F.posexplode
        return df.select(*(c for c in df.columns if c != column), f(column).alias(ordinality, name)).withColumn(ordinality, F.col(ordinality) + 1)
    return df.select(*(c for c in df.columns if c != column), (F.explode_outer if outer else F.explode)(column).alias(name))


def subscripts(df: DataFrame, column: str, name: str = "generate_subscripts") -> DataFrame:
    """1 to the length of each list."""
    return df.select("*", F.explode(F.when(F.size(column) > 0, F.sequence(F.lit(1), F.size(column)))).alias(name))


def json_each(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row per member of a JSON object, or element of a JSON array with its place from 0; values as JSON text."""
    parsed = F.try_parse_json(F.col(column))
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    members = F.map_entries(F.try_variant_get(F.when(~is_list, parsed), "$", "map<string, variant>"))
    items = F.try_variant_get(F.when(is_list, parsed), "$", "array<variant>")
    named = F.transform(items, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    text = F.transform(F.coalesce(named, members), lambda m: F.struct(m["key"].alias(key), F.to_json(m["value"]).alias(value)))
    return df.select("*", F.inline(text))


def summarize(df: DataFrame) -> DataFrame:
    """Per column: type, min, max, approximate distinct count, mean, deviation, quartiles (approximate), rows and null share; one pass over df."""
    parts = []
    for f in df.schema.fields:
        c, numeric = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        text = lambda x: x.cast("string")
        ordered = not isinstance(f.dataType, (T.MapType, T.VariantType))
        parts.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                (text(F.min(c)) if ordered else F.lit(None).cast("string")).alias("min"),
                (text(F.max(c)) if ordered else F.lit(None).cast("string")).alias("max"),
                (F.approx_count_distinct(c) if ordered else F.lit(None).cast("long")).alias("approx_unique"),
                (F.avg(c) if numeric else F.lit(None).cast("double")).cast("double").alias("avg"),
                (F.stddev_samp(c) if numeric else F.lit(None).cast("double")).cast("double").alias("std"),
                *((F.percentile_approx(c, q).cast("string") if numeric else F.lit(None).cast("string")).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)),
                F.count(F.lit(1)).alias("count"),
                F.when(F.count(F.lit(1)) > 0, 100.0 * (F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1))).alias("null_percentage"),
            )
        )
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def describe(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, `null` string")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
