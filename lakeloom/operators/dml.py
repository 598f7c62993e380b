"""Changes to tables as new DataFrames: each takes the target and returns what it would become."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return insert(target, rows.join(target.select(*keys), list(keys), "left_anti"))


def insert_or_replace(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return insert(target.join(rows.select(*keys), list(keys), "left_anti"), rows)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: dict[str, Column], where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE SET: update maps columns to expressions over `target.x` and `excluded.x`."""
    clause = [When(matched=True, then="update", set=update, condition=where), When(matched=False, then="insert")]
    return merge(target, rows, keys, clause, source_alias="excluded")


def update(target: DataFrame, set_: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """UPDATE SET [FROM source] WHERE: expressions over target's columns, or over `t.x` and `s.x` with a source.

    A source row per target row at most; with several the result has one of them.
    """
    if source is None:
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        return target.select(*(F.when(hit, set_[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in set_ else F.col(c) for c in target.columns))
    joined = target.alias("t").join(source.withColumn("_hit", F.lit(True)).alias("s"), on if where is None else on & where, "left")
    hit = F.coalesce(F.col("s._hit"), F.lit(False))
    return joined.select(*(F.when(hit, set_[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in set_ else F.col(f"t.{c}").alias(c) for c in target.columns))


def delete(target: DataFrame, where: Column | None = None, using: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """DELETE [USING] WHERE; rows for which the condition is null stay."""
    if using is not None:
        return target.alias("t").join(using.alias("s"), on if where is None else on & where, "left_anti")
    return target.where(~F.coalesce(where, F.lit(False))) if where is not None else target.limit(0)


def insert_returning(target: DataFrame, rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """INSERT ... RETURNING *: the rows that the insert adds, in target's columns; with keys those that don't conflict."""
    fresh = rows.join(target.select(*keys), list(keys), "left_anti") if keys else rows
    return target.limit(0).unionByName(fresh, allowMissingColumns=True).select(*target.columns)


def update_returning(target: DataFrame, set_: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """UPDATE ... RETURNING *: the changed rows, as update() makes them."""
    new = lambda old: [(set_[c] if c in set_ else old(c)).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    if source is None:
        return (target.where(where) if where is not None else target).select(*new(F.col))
    joined = target.alias("t").join(source.alias("s"), on if where is None else on & where)
    return joined.select(*new(lambda c: F.col(f"t.{c}")))


def delete_returning(target: DataFrame, where: Column | None = None, using: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """DELETE ... RETURNING *: the rows that go."""
    if using is not None:
        return target.alias("t").join(using.alias("s"), on if where is None else on & where, "left_semi")
    return target.where(where) if where is not None else target


def with_defaults(rows: DataFrame, schema: str, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None) -> DataFrame:
    """rows as a table of a schema: columns they lack take their default, or null; generated columns are computed of the others, and can't be given."""
    given = [c for c in generated or {} if c in rows.columns]
    if given:
        raise ValueError(f"generated columns can't be given: {given}")
    fields = StructType.fromDDL(schema).fields
    made = rows
    for f in fields:
        if f.name not in made.columns and f.name not in (generated or {}):
            made = made.withColumn(f.name, (defaults or {}).get(f.name, F.lit(None)))
    for name, value in (generated or {}).items():
        made = made.withColumn(name, value)
    return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


@dataclass
class When:
    """A clause of merge(): matched True, False (only in the source) or "source" (only in the target); then update, delete, insert or nothing."""

    matched: bool | str
    then: str
    condition: Column | None = None
    set: dict[str, Column] = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[When], source_alias: str = "s") -> DataFrame:
    """MERGE INTO on equal keys: one full outer join; for each row the first clause that applies decides.

    Expressions use `target.x` and, for the source, `source_alias.x`.
    """
    t = target.withColumn("_in_target", F.lit(True)).alias("target")
    s = source.withColumn("_in_source", F.lit(True)).alias(source_alias)
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"target.{k}") == F.col(f"{source_alias}.{k}"))
    both = t.join(s, on, "full")
    here, there = F.coalesce(F.col("target._in_target"), F.lit(False)), F.coalesce(F.col(f"{source_alias}._in_source"), F.lit(False))
    state = {True: here & there, False: ~here & there, "source": here & ~there}
    choice = None
    for n, c in enumerate(clauses):
        applies = state[c.matched] & (F.coalesce(c.condition, F.lit(False)) if c.condition is not None else F.lit(True))
        choice = F.when(applies, n) if choice is None else choice.when(applies, n)
    both = both.withColumn("_choice", F.coalesce(choice if choice is not None else F.lit(None), F.lit(-1)))
    gone = [n for n, c in enumerate(clauses) if c.then == "delete"]
    fresh = [n for n, c in enumerate(clauses) if c.then == "insert"]
    kept = both.where((here & ~F.col("_choice").isin(gone)) | (~here & F.col("_choice").isin(fresh)))
    columns = []
    for name in target.columns:
        value = F.col(f"target.{name}")
        for n, c in enumerate(clauses):
            if c.then == "update" and name in c.set:
                value = F.when(F.col("_choice") == n, c.set[name]).otherwise(value)
            elif c.then == "insert":
                new = c.set.get(name, F.col(f"{source_alias}.{name}") if not c.set and name in source.columns else F.lit(None))
                value = F.when(F.col("_choice") == n, new).otherwise(value)
        columns.append(value.cast(target.schema[name].dataType).alias(name))
    return kept.select(*columns)


def violations(df: DataFrame, primary_key: Sequence[str] = (), checks: dict[str, Column] | None = None, not_null: Sequence[str] = (), foreign: Sequence[tuple[Sequence[str], DataFrame, Sequence[str]]] = ()) -> DataFrame:
    """Rows that break constraints, as (constraint, n): keys that repeat, checks that are false, nulls, missing references."""
    found = []
    if primary_key:
        found.append(df.groupBy(*primary_key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("primary key").alias("constraint"), "n"))
    tests = {**{f"not null {c}": F.col(c).isNull() for c in not_null}, **{f"check {k}": ~v for k, v in (checks or {}).items()}}
    if tests:
        found.append(df.agg(*(F.count_if(v).alias(k) for k, v in tests.items())).unpivot([], list(tests), "constraint", "n"))
    for columns, other, refs in foreign:
        on = F.lit(True)
        for a, b in zip(columns, refs, strict=True):
            on = on & (F.col(f"l.{a}") == F.col(f"r.{b}"))
        lost = df.alias("l").where(F.expr(" and ".join(f"l.{c} is not null" for c in columns))).join(other.alias("r"), on, "left_anti")
        found.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"foreign key {', '.join(columns)}").alias("constraint"), "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.where("n > 0")
