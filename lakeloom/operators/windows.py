"""Window features that Spark has no syntax for, as plain window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition over window functions holds."""
    return df.withColumn("_qualified", condition).where("_qualified").drop("_qualified")


def groups_between(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], start: int, end: int, **columns) -> DataFrame:
    """Columns over a GROUPS frame: start to end peer groups around the current one.

    columns maps names to functions from a window to a column, such as lambda w: F.sum("x").over(w).
    """
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    return ranked.withColumns({k: f(w) for k, f in columns.items()}).drop("_group")


_FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _in_list(found: Column, function: str) -> Column:
    """sum, count, min or max of a list of values, as aggregates have it: without nulls, null (count: 0) of nothing."""
    found = F.filter(found, lambda x: x.isNotNull())
    if function == "sum":
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x))
    return {"count": F.size, "min": F.array_min, "max": F.array_max}[function](found)


def excluding(df: DataFrame, partition: Sequence[str], order: str, what: str, frame: tuple[str, int, int] = ("range", Window.unboundedPreceding, 0), **columns: tuple[str, str]) -> DataFrame:
    """Aggregates over a frame without the current row, its group (the rows with its order value), or its ties.

    frame is ("rows", "range" or "groups", start, end); columns maps names to (function, column), where function is
    sum, count, avg, min or max. What stays is taken from the frame before the excluded rows, the frame after them, and
    what is left of the group; nothing is subtracted, so no precision is lost and NaN stays where it is. The sides are
    window frames where Spark can state them: up to the group, if the frame is unbounded there, counts groups, or has
    whole numbers as order; otherwise the rows of the side, as far as the frame reaches, are listed and told by group.
    """
    kind, start, end = frame
    whole = dict(df.dtypes)[order] in _WHOLE
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    by_order, by_group = Window.partitionBy(*partition).orderBy(order), Window.partitionBy(*partition).orderBy("_group")
    peers = Window.partitionBy(*partition, "_group").orderBy(F.lit(0))
    inside = start <= 0 <= end
    first, last = Window.unboundedPreceding, Window.unboundedFollowing

    def plain(window):
        return lambda x, function: _FOLDS[function](x).over(window)

    def listed(window, keep):
        def part(x: Column, function: str) -> Column:
            rows = F.collect_list(F.struct(F.col("_group").alias("g"), x.alias("x"))).over(window)
            return _in_list(F.transform(F.filter(rows, lambda r: keep(r["g"])), lambda r: r["x"]), function)

        return part

    def side(low: int, high: int, before: bool):
        """The rows of the frame on one side of what is excluded."""
        open_ = low <= first and end >= 0 if before else high >= last and start <= 0
        keep = (lambda g: g < F.col("_group")) if before else (lambda g: g > F.col("_group"))
        if kind == "groups" or open_ and not (kind == "rows" and what == "current row"):
            return plain(by_group.rangeBetween(low, high))
        if kind == "rows":
            return plain(by_order.rowsBetween(low, high)) if what == "current row" else listed(by_order.rowsBetween(low, high), keep)
        if whole:
            return plain(by_order.rangeBetween(low, high))
        return listed(by_order.rangeBetween(start, min(end, 0)) if before else by_order.rangeBetween(max(start, 0), end), keep)

    if what == "no others":
        parts = [plain({"rows": by_order.rowsBetween, "range": by_order.rangeBetween, "groups": by_group.rangeBetween}[kind](start, end))]
    else:
        parts = [side(start, min(end, -1), True)] if start < 0 else []
        parts += [side(max(start, 1), end, False)] if end > 0 else []
        if inside and what == "ties":
            parts.append(lambda x, function: F.when(x.isNotNull(), 1).otherwise(0) if function == "count" else x)
        elif inside and what == "current row" and kind != "rows":
            parts += [plain(peers.rowsBetween(first, -1)), plain(peers.rowsBetween(1, last))]

    def combined(function: str, x: Column) -> Column:
        found = [part(x, function) for part in parts]
        if function in ("min", "max"):
            return (F.least if function == "min" else F.greatest)(*found) if len(found) > 1 else found[0] if found else F.lit(None)
        total = F.lit(0).cast("long") if function == "count" else F.lit(None).cast("double")
        for y in found:
            total = total + y if function == "count" else F.coalesce(total + y, total, y.cast("double"))
        return total

    def one(function: str, column: str) -> Column:
        x = F.col(column)
        if function == "avg":
            return F.try_divide(combined("sum", x), combined("count", x))
        return combined(function, x).cast("long") if function == "count" else combined(function, x)

    return ranked.withColumns({name: one(*of) for name, of in columns.items()}).drop("_group")


def distinct_over(function: str, value: Column, window) -> Column:
    """count, sum or avg of the distinct values in a frame, which lists them: for frames of a bounded number of rows."""
    found = F.collect_set(value).over(window)
    if function == "count":
        return F.size(found).cast("long")
    total = F.aggregate(found, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.when(F.size(found) > 0, total if function == "sum" else total / F.size(found))


def distinct_running(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str] = (), **columns: tuple[str, Column]) -> DataFrame:
    """count, sum or avg of the distinct values from the partition's start to the current row and its peers (without
    order: of the whole partition): the first row of each value is marked and the marked ones are added up."""
    marked = df
    for k, (_, value) in enumerate(columns.values()):
        marked = marked.withColumn(f"_value{k}", value)
    frame = Window.partitionBy(*partition)
    frame = frame.orderBy(*order).rangeBetween(Window.unboundedPreceding, 0) if order else frame
    for k in range(len(columns)):
        first = Window.partitionBy(*partition, f"_value{k}").orderBy(*(order or [F.lit(0)]))
        marked = marked.withColumn(f"_value{k}", F.when(F.row_number().over(first) == 1, F.col(f"_value{k}")))
    fold = {"count": F.count, "sum": lambda x: F.sum(F.col(x).cast("double")), "avg": lambda x: F.avg(F.col(x).cast("double"))}
    done = marked.withColumns({name: fold[function](f"_value{k}").over(frame) for k, (name, (function, _)) in enumerate(columns.items())})
    return done.drop(*(f"_value{k}" for k in range(len(columns))))
