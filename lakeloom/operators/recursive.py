"""Recursive queries with UNION semantics, which Spark SQL lacks (UNION ALL is native: WITH RECURSIVE)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """base and everything that step derives from new rows, without repeats; cycles end.

    Each round joins only the rows that the last one added. Rows are told from those seen before by an anti-join on
    all columns, whose seen side is written once a round, merged as its runs grow, so plans stay small and rounds
    survive lost executors. Raises RecursionError after limit rounds.
    """
    columns = base.columns
    new = written(base.distinct(), "recursion")
    runs: list[tuple[DataFrame, int]] = [(new, 1)]  # written runs of rows, each with the rounds it holds
    for _ in range(limit):
        found = step(new).select(*columns).distinct()
        for seen, _ in runs:
            on = F.lit(True)
            for c in columns:
                on = on & F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
            found = found.alias("n").join(seen.alias("s"), on, "left_anti")
        new = written(found, "recursion")
        if not new.head(1):
            out = runs[0][0]
            for seen, _ in runs[1:]:
                out = out.unionAll(seen)
            return out
        runs.append((new, 1))
        while len(runs) > 1 and runs[-2][1] <= runs[-1][1] * 2 and len(runs) > 3:  # few runs, each rewritten seldom
            (a, m), (b, n) = runs[-2:]
            runs[-2:] = [(written(a.unionAll(b), "recursion"), m + n)]
    raise RecursionError(f"no fixpoint after {limit} rounds")


def fixpoint_by_key(base: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], better: str, limit: int = 1000) -> DataFrame:
    """USING KEY: one row per key, the one with the smallest value of `better`; only improved rows go into the next round."""
    pick = lambda df: df.groupBy(*keys).agg(*(F.min_by(c, better).alias(c) for c in df.columns if c not in keys))
    best = written(pick(base), "recursion")
    new = best
    for _ in range(limit):
        found = pick(step(new)).select(*best.columns)
        old = best.select(*keys, F.col(better).alias("_old"))
        new = written(found.join(old, list(keys), "left").where(F.col("_old").isNull() | (F.col(better) < F.col("_old"))).drop("_old"), "recursion")
        if not new.head(1):
            return best
        best = written(pick(best.unionAll(new)).select(*best.columns), "recursion")
    raise RecursionError(f"no fixpoint after {limit} rounds")
