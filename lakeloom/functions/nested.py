"""List, struct, map, union and JSON functions with the dialect's semantics."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def list_element(x: Column, i: int) -> Column:
    """From 1, negative from the end; null at 0 and outside."""
    return F.try_element_at(x, F.lit(i)) if i else F.lit(None)


def list_position(x: Column, value: Column) -> Column:
    """Null if absent."""
    return F.nullif(F.array_position(x, value), F.lit(0)).cast("int")


def list_distinct(x: Column) -> Column:
    """Without nulls, in order."""
    return F.sort_array(F.array_compact(F.array_distinct(x)))


def list_sort(x: Column, descending: bool = False) -> Column:
    """Nulls last."""
    return F.sort_array(x, asc=False) if descending else F.array_sort(x)


def list_reverse_sort(x: Column) -> Column:
    return list_sort(x, descending=True)


def list_prepend(value: Column, x: Column) -> Column:
    return F.array_prepend(x, value)


def struct_pack(**members: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in members.items()))


def struct_extract(x: Column, member: str) -> Column:
    return x.getField(member)


def struct_keys(x: Column) -> Column:
    return F.json_object_keys(F.to_json(x, {"ignoreNullFields": "false"}))


def struct_insert(x: Column, **members: Column) -> Column:
    for name, value in members.items():
        x = x.withField(name, value)
    return x


def map_(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def map_extract(m: Column, key: Column) -> Column:
    """A list of the key's value, empty if the key is absent."""
    return F.map_values(F.map_filter(m, lambda k, _: k == key))


def enum_range(kind) -> Column:
    """All values of an Enumeration, in order."""
    return F.array(*map(F.lit, kind.values))


def enum_first(kind) -> Column:
    return F.lit(kind.values[0])


def enum_last(kind) -> Column:
    return F.lit(kind.values[-1])


def list_reduce(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), F.get(x, F.lit(0)), f)


def list_aggregate(x: Column, name: str) -> Column:
    known = F.array_compact(x)
    total = lambda: F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    return {
        "sum": lambda: F.when(F.size(known) > 0, total()),
        "avg": lambda: F.when(F.size(known) > 0, total() / F.size(known)),
        "min": lambda: F.array_min(known),
        "max": lambda: F.array_max(known),
        "count": lambda: F.size(known).cast("long"),
        "first": lambda: F.get(x, F.lit(0)),
        "last": lambda: F.try_element_at(x, F.lit(-1)),
        "string_agg": lambda: F.array_join(known, ","),
        "median": lambda: F.when(F.size(known) > 0, (F.get(F.sort_array(known), F.floor((F.size(known) - 1) / 2).cast("int")) + F.get(F.sort_array(known), F.floor(F.size(known) / 2).cast("int"))) / 2),
    }[name]()


def list_resize(x: Column, n: int, fill: Column | None = None) -> Column:
    filler = F.array_repeat(fill if fill is not None else F.lit(None), n)
    return F.slice(F.concat(x, filler), 1, n)


def list_zip(*lists: Column) -> Column:
    return F.arrays_zip(*lists)


def union_value(tag: str, value: Column, members: dict[str, str]) -> Column:
    """A union as a struct of its tag and a field for each member."""
    return F.struct(F.lit(tag).alias("tag"), *((value if m == tag else F.lit(None)).cast(t).alias(m) for m, t in members.items()))


def union_tag(x: Column) -> Column:
    return x.getField("tag")


def union_extract(x: Column, member: str) -> Column:
    return x.getField(member)


def json_extract(x: Column, path: str) -> Column:
    """As JSON text: strings keep their quotes."""
    return F.to_json(F.try_variant_get(F.try_parse_json(x), path, "variant"))


def json_extract_string(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def json_valid(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull() & x.isNotNull()


def json_keys(x: Column) -> Column:
    return F.json_object_keys(x)


def json_type(x: Column) -> Column:
    """The dialect's name of the type of a JSON value."""
    kind = F.schema_of_variant(F.try_parse_json(x))
    return (
        F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "VARCHAR").when(kind == "BOOLEAN", "BOOLEAN").when(kind == "VOID", "NULL").when(kind == "BIGINT", F.when(F.trim(x).startswith("-"), "BIGINT").otherwise("UBIGINT")).otherwise("DOUBLE")
    )


def json_object(**members: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def json_array(*items: Column) -> Column:
    parts = [F.when(v.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)) for v in items]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_quote(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _holds(a, b) -> bool:
    """Whether a JSON value holds another: equal scalars, arrays and objects as subsets."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_holds(y, v) for y in a) for v in b)
    return (any(_holds(y, b) for y in a) if isinstance(a, list) else a == b) if not isinstance(a, dict) else False


def json_contains(x: Column, part: Column | str) -> Column:
    """Whether a JSON text holds another; a part given as a string is parsed once."""
    if isinstance(part, str):
        wanted = json.loads(part)

        @F.pandas_udf("boolean")
        def one(a: pd.Series) -> pd.Series:
            known = {p: _holds(json.loads(p), wanted) for p in a.dropna().unique()}
            return a.map(known).astype(object).where(a.notna(), None)

        return one(x)

    @F.pandas_udf("boolean")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _holds(json.loads(p), json.loads(q)) for p, q in zip(a, b, strict=True)])

    return f(x, part)
