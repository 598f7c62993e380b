"""Set operations, by position and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame, all_: bool = False, by_name: bool = False) -> DataFrame:
    """UNION [ALL] [BY NAME]; by name, columns that one side lacks are null there."""
    both = a.unionByName(b, allowMissingColumns=True) if by_name else a.union(b)
    return both if all_ else both.distinct()


def intersect(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_ else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_ else a.subtract(b)
