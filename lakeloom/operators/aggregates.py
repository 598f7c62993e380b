"""Aggregates with the dialect's semantics. All but those named _table are plain Column expressions for agg()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skewness(x: str) -> Column:
    """Bias-corrected; null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: str) -> Column:
    """Bias-corrected excess; null below four values."""
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def geometric_mean(x: str) -> Column:
    """Null if any value isn't positive."""
    c = F.col(x)
    return F.when(F.min(c) > 0, F.exp(F.avg(F.when(c > 0, F.ln(c)))))


def weighted_avg(x: str, w: str) -> Column:
    """Over pairs without nulls."""
    both = F.col(x).isNotNull() & F.col(w).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(x) * F.col(w))), F.sum(F.when(both, F.col(w))))


def sum_if(x: str, condition: Column) -> Column:
    return F.sum(F.when(condition, F.col(x)))


def avg_if(x: str, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(x)))


def min_if(x: str, condition: Column) -> Column:
    return F.min(F.when(condition, F.col(x)))


def max_if(x: str, condition: Column) -> Column:
    return F.max(F.when(condition, F.col(x)))


def arg_min(value: str, by: str, order: str | None = None) -> Column:
    """Of the rows without a null in either argument; of several with the least `by` the first in `order`, or without it any.

    `order` is a number. The dialect keeps the first row it reads.
    """
    return F.min_by(F.col(value), _known(value, by, F.col(order) if order else None))


def arg_max(value: str, by: str, order: str | None = None) -> Column:
    return F.max_by(F.col(value), _known(value, by, -F.col(order) if order else None))


def _known(value: str, by: str, rank: Column | None) -> Column:
    return F.when(F.col(value).isNotNull() & F.col(by).isNotNull(), F.col(by) if rank is None else F.struct(F.col(by), rank))


def first_value_by(x: str, order: str) -> Column:
    """FIRST made repeatable by an order; may be null."""
    return F.min_by(F.struct(F.col(x)), F.col(order)).getField(x)


def any_value(x: str, order: str) -> Column:
    """The first value that isn't null, in an order."""
    return F.min_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(order)))


def last_value_by(x: str, order: str) -> Column:
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(order)))


def list_agg(x: str, order: Sequence[str] = (), keep_nulls: bool = True) -> Column:
    """The values as an array, nulls included, in order; null for no rows."""
    keys = [F.col(c) for c in order] or [F.col(x)]
    rows = F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col(x).alias("v"))))
    values = F.transform(rows, lambda r: r["v"])
    return F.when(F.count(F.lit(1)) > 0, values if keep_nulls else F.filter(values, lambda v: v.isNotNull()))


def list_distinct_agg(x: str) -> Column:
    return F.sort_array(F.collect_set(x))


def string_agg(x: str, separator: str = ",", order: str | None = None) -> Column:
    """The strings joined in order; nulls are skipped."""
    key = order or x
    rows = F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(F.col(key).alias("k"), F.col(x).cast("string").alias("v")))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(rows, lambda r: r["v"]), separator))


def json_group_array(x: str, order: Sequence[str]) -> Column:
    """A JSON array of the values, nulls included."""
    values = F.transform(list_agg(x, order), lambda v: F.coalesce(F.expr("null").cast("string"), F.when(v.isNull(), F.lit("null")).otherwise(_json(v))))
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def json_group_object(key: str, x: str) -> Column:
    """A JSON object of all keys and values, in order of the keys; a repeated key is written again, as the dialect does."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(x).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda r: F.concat(_json(r["k"]), F.lit(":"), F.when(r["v"].isNull(), F.lit("null")).otherwise(_json(r["v"])))), ","), F.lit("}"))


def _json(v: Column) -> Column:
    text = F.to_json(F.struct(v.alias("v")))
    return F.substring(text, 6, 2**30).substr(F.lit(1), F.length(text) - 6)


def bitstring_agg(x: str, low: int, high: int) -> Column:
    """A string of 0 and 1: position i tells if low + i occurs."""
    found = F.collect_set(x)
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.when(F.array_contains(found, i.cast("int")), "1").otherwise("0")), "")


def quantile(x: str, q: float | Sequence[float]) -> Column:
    """Interpolated; a list of places gives a list."""
    return F.percentile(x, list(q) if isinstance(q, Sequence) else q)


def percentile_cont(q: float, x: str, descending: bool = False) -> Column:
    return F.percentile(x, 1 - q if descending else q)


def percentile_disc(q: float, x: str) -> Column:
    """The first value whose share of values up to it reaches q."""
    return F.expr(f"percentile_disc({float(q)}D) WITHIN GROUP (ORDER BY `{x}`)")


def approx_median(x: str) -> Column:
    return F.percentile_approx(x, 0.5)


def exact_sum_table(df: DataFrame, keys: Sequence[str], x: str, name: str = "sum", mean: bool = False) -> DataFrame:
    """Sums (or means) of doubles without rounding errors of their order: partial sums travel as a double and its error."""
    import math

    from ..udf import mergeable_aggregate, vectorised

    def folded(values: list[float], n: float) -> list[float]:
        high = math.fsum(values)
        return [high, math.fsum([*values, -high]) if math.isfinite(high) else 0.0, n]

    update = vectorised(lambda s, v: folded([s[0], s[1], *v.dropna()], s[2] + float(v.count())))
    combine = lambda a, b: folded([a[0], a[1], b[0], b[1]], a[2] + b[2])
    finish = lambda s: None if not s[2] else (s[0] + s[1]) / s[2] if mean else s[0] + s[1]
    return mergeable_aggregate(df, keys, x, lambda: [0.0, 0.0, 0.0], update, combine, finish, "array<double>", "double", name)


def grouping_bits(*columns: str) -> Column:
    """GROUPING(a, b, ...): a bit per column, the first the highest."""
    return sum((F.grouping(c).cast("long") * 2 ** (len(columns) - 1 - k) for k, c in enumerate(columns)), F.lit(0).cast("long"))


def entropy_table(df: DataFrame, keys: Sequence[str], x: str, name: str = "entropy") -> DataFrame:
    """Base-2 entropy of a column's values: counted per value, then per group, so a frequent value is one row early."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(name))


def histogram_table(df: DataFrame, keys: Sequence[str], x: str, name: str = "histogram") -> DataFrame:
    """A map from value to count, in order of the values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(x), F.col("_n"))))).alias(name))


def mode_table(df: DataFrame, keys: Sequence[str], x: str, name: str = "mode") -> DataFrame:
    """The most frequent value; of equals the smallest."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(x, F.struct(-F.col("_n"), F.col(x))).alias(name))


def _by_value(df: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """How often each value occurs in each group: what exact percentiles need of a group, in one row for each value."""
    return df.select(*keys, x.alias("_x")).where("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))


def median_table(df: DataFrame, keys: Sequence[str], x: Column, name: str = "median") -> DataFrame:
    """Exact medians from the numbers of each value, so a frequent value is one row before any group is put together."""
    return _by_value(df, keys, x).groupBy(*keys).agg(F.percentile("_x", 0.5, F.col("_n")).alias(name))


def mad_table(df: DataFrame, keys: Sequence[str], x: str, name: str = "mad") -> DataFrame:
    """Median absolute deviation: medians by group joined back to the numbers of each value, which are all it needs."""
    counted = _by_value(df, keys, F.col(x))
    medians = counted.groupBy(*keys).agg(F.percentile("_x", 0.5, F.col("_n")).alias("_m"))
    joined = counted.join(medians, list(keys)) if keys else counted.crossJoin(F.broadcast(medians))  # one row
    return joined.groupBy(*keys).agg(F.percentile(F.abs(F.col("_x") - F.col("_m")), 0.5, F.col("_n")).alias(name))


def salted_agg(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], salts: int = 16) -> DataFrame:
    """Sums in two steps, first by key and salt, a hash of the row, so that a task that runs again deals alike; for
    aggregates whose partial step Spark can't run before the shuffle."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).groupBy(*keys, "_salt").agg(*(v.alias(k) for k, v in sums.items()))
    return salted.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in sums))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(x).over(w))
