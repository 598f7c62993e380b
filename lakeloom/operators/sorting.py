"""Order, limits and distinctness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls_last(*columns: str, descending: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]


#: Rows whose keys are sent to every executor at most.
BROADCAST_ROWS = 100_000


def with_ties(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows in order and all that tie with the last: the rows that have the keys of the first n, which a
    top-k finds, so nothing is ranked globally."""
    keys = [c.alias(f"_k{i}") for i, c in enumerate(_plain(order))]
    first = df.orderBy(*order).limit(n).select(*keys).distinct()
    joined = df.select("*", *keys).alias("l")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"l._k{i}").eqNullSafe(F.col(f"r._k{i}"))
    first = F.broadcast(first) if n <= BROADCAST_ROWS else first
    return joined.join(first.alias("r"), on, "left_semi").drop(*(f"_k{i}" for i in range(len(keys))))


def _plain(order: Sequence[Column | str]) -> list[Column]:
    """The expressions under sort directions."""
    out = []
    for c in order:
        if isinstance(c, str):
            out.append(F.col(c))
            continue
        node = c._jc.node()
        if node.getClass().getSimpleName() != "SortOrder":
            out.append(c)
            continue
        out.append(type(c)(SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node.child())))
    return out


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    """Sort and limit in one: each task keeps k rows."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first k rows of each key in order; Spark drops rows beyond k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def reservoir(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn at random; a top-k over random numbers, so each task keeps n rows."""
    return df.withColumn("_draw", F.rand(seed)).orderBy("_draw").limit(n).drop("_draw")


def bernoulli(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)
