"""Every dialect name and alias with its builder, and SQL functions for a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from . import geo, nested, numeric, strings, temporal

#: Names whose builder is Spark's function of another name.
_ALIASES = {
    "ceiling": "ceil", "round_even": "bround", "power": "pow", "ucase": "upper", "lcase": "lower", "char_length": "length", "character_length": "length",
    "len": "length", "strip": "trim", "lstrip": "ltrim", "rstrip": "rtrim", "prefix": "startswith", "starts_with": "startswith", "suffix": "endswith", "ends_with": "endswith",
    "strpos": "instr", "ord": "ascii", "unicode": "ascii", "mean": "avg", "variance": "var_samp", "stddev": "stddev_samp", "every": "bool_and",
    "list_value": "array", "list_pack": "array", "list_append": "array_append", "array_push_back": "array_append",
    "list_contains": "array_contains", "list_has": "array_contains", "list_reverse": "reverse", "list_concat": "concat", "array_cat": "concat", "array_length": "size",
    "list_transform": "transform", "array_apply": "transform", "apply": "transform", "list_filter": "filter", "array_filter": "filter", "array_to_string": "array_join", "list_to_string": "array_join",
    "to_base64": "base64", "base64_encode": "base64", "from_base64": "unbase64", "base64_decode": "unbase64", "json_extract_text": "get_json_object",
    "regexp_matches": "rlike", "string_split_regex": "split", "regexp_split_to_array": "split", "gen_random_uuid": "uuid", "ifnull": "coalesce", "nvl": "coalesce",
    "approx_quantile": "percentile_approx", "datepart": "date_part", "make_timestamptz": "make_timestamp_ltz", "timezone": "convert_timezone",
}

#: Functions whose builder is the library's own.
_OWN = {
    **{n: getattr(numeric, n) for n in ("trunc", "even", "log", "ln", "divide", "gcd", "lcm", "gamma", "lgamma", "beta", "isinf", "isfinite", "signbit", "sign", "get_bit", "set_bit")},
    **{n: getattr(strings, n) for n in ("concat", "left", "right", "substring", "string_split", "regexp_replace", "regexp_full_match", "similar_to", "url_encode", "hamming", "jaccard", "damerau_levenshtein", "jaro_similarity", "jaro_winkler_similarity", "strip_accents")},
    **{n: getattr(temporal, n) for n in ("epoch", "epoch_ms", "epoch_ns", "date_part", "date_trunc", "date_diff", "date_sub", "date_add", "age", "time_bucket", "strftime", "strptime", "dayname", "monthname")},
    **{n: getattr(nested, n) for n in ("list_element", "list_position", "list_distinct", "list_sort", "list_reduce", "list_aggregate", "list_resize", "list_zip", "union_value", "union_tag", "union_extract", "json_extract", "json_extract_string", "json_valid", "json_keys", "json_type", "json_object", "json_array", "json_quote", "json_contains")},
    **{n: getattr(geo, n) for n in dir(geo) if n.startswith("st_")},
}
_OWN |= {
    **{n: getattr(numeric, n) for n in ("bit_length", "setseed", "random", "hash")}, "rand": numeric.random,
    **{n: getattr(strings, n) for n in ("position", "like_escape", "sha256", "sha512", "encode", "decode", "typeof", "pg_typeof")},
    **{n: temporal.part(n) for n in ("year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond", "dayofweek", "dow", "isodow", "dayofyear", "doy", "week", "weekofyear", "isoyear", "yearweek", "quarter", "decade", "century")},
    **{f"to_{n}": temporal.to_unit(n) for n in temporal.INTERVAL_UNITS}, **{f"total_{n}": temporal.total(n) for n in ("years", "months", "days", "hours", "minutes", "seconds")}, "today": temporal.today, "to_char": temporal.strftime,
    **{n: getattr(nested, n) for n in ("list_reverse_sort", "list_prepend", "struct_pack", "struct_extract", "struct_keys", "struct_insert", "map_extract", "enum_range", "enum_first", "enum_last")}, "map": nested.map_, "element_at": nested.map_extract,
    "array_reverse_sort": nested.list_reverse_sort, "array_prepend": nested.list_prepend, "array_push_front": nested.list_prepend,
    **{n: getattr(aggregates, n) for n in ("quantile", "percentile_cont", "percentile_disc", "approx_median", "skewness", "kurtosis", "weighted_avg", "sum_if", "avg_if", "min_if", "max_if", "arg_min", "arg_max", "any_value", "string_agg", "json_group_array", "json_group_object", "bitstring_agg")},
    "quantile_cont": aggregates.quantile, "list": aggregates.list_agg, "array_agg": aggregates.list_agg, "group_concat": aggregates.string_agg, "listagg": aggregates.string_agg, "geometric_mean": aggregates.geometric_mean, "geomean": aggregates.geometric_mean,
    "argmin": aggregates.arg_min, "min_by": aggregates.arg_min, "argmax": aggregates.arg_max, "max_by": aggregates.arg_max, "arbitrary": aggregates.any_value, "first": aggregates.first_value_by, "last": aggregates.last_value_by,
    "histogram": aggregates.histogram_table, "mode": aggregates.mode_table, "entropy": aggregates.entropy_table, "mad": aggregates.mad_table, "favg": lambda *a, **k: aggregates.exact_sum_table(*a, mean=True, **k), "fsum": aggregates.exact_sum_table, "product": F.product,
    "if": lambda condition, yes, no=None: F.when(condition, yes).otherwise(no), "inf": lambda: F.lit(float("inf")), "infinity": lambda: F.lit(float("inf")), "nan": lambda: F.lit(float("nan")), "mod": lambda a, b: a % b, "e": F.e, "pi": F.pi,
    "approx_count_distinct": F.approx_count_distinct, "format": F.format_string, "unnest": F.explode, "generate_series": F.sequence, "strlen": F.octet_length, "make_time": getattr(F, "make_time", None), "current_time": getattr(F, "current_time", None),
    "truncate": _OWN["trunc"], "substr": _OWN["substring"], "string_to_array": _OWN["string_split"], "epoch_us": temporal.micros, "datetrunc": _OWN["date_trunc"], "dateadd": _OWN["date_add"],
    "array_extract": _OWN["list_element"], "array_position": _OWN["list_position"], "array_distinct": _OWN["list_distinct"], "array_sort": _OWN["list_sort"], "array_aggregate": _OWN["list_aggregate"], "array_resize": _OWN["list_resize"],
}
_OWN["iff"] = _OWN["if"]


def function(name: str) -> Callable:
    """The builder behind a dialect name: the library's own, an alias, or Spark's function of that name."""
    name = name.lower()
    if _OWN.get(name):
        return _OWN[name]
    found = getattr(F, _ALIASES.get(name, name), None)
    if found is None:
        raise KeyError(f"unknown function {name}")
    return found


def names() -> list[str]:
    return sorted({*_OWN, *_ALIASES, *(n for n in dir(F) if n.islower() and not n.startswith("_"))})


#: SQL functions that Catalyst inlines: parameters and body.
SQL_FUNCTIONS = {
    "even": ("x DOUBLE", "DOUBLE", "signum(x) * ceil(abs(x) / 2) * 2"),
    "signbit": ("x DOUBLE", "BOOLEAN", "x < 0 OR (x = 0 AND startswith(cast(x AS STRING), '-'))"),
    "trunc_toward_zero": ("x DOUBLE", "DOUBLE", "cast(CASE WHEN x < 0 THEN ceil(x) ELSE floor(x) END AS DOUBLE)"),
    "strip": ("s STRING", "STRING", "trim(s)"),
    "lstrip": ("s STRING", "STRING", "ltrim(s)"),
    "rstrip": ("s STRING", "STRING", "rtrim(s)"),
    "strlen": ("s STRING", "BIGINT", "cast(octet_length(s) AS BIGINT)"),
    "ord": ("s STRING", "INT", "ascii(s)"),
    "unicode": ("s STRING", "INT", "ascii(s)"),
    "starts_with": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
    "ends_with": ("s STRING, p STRING", "BOOLEAN", "endswith(s, p)"),
    "strpos": ("s STRING, p STRING", "BIGINT", "cast(instr(s, p) AS BIGINT)"),
    "jaccard": ("a STRING, b STRING", "DOUBLE", "size(array_intersect(filter(split(a, ''), c -> c <> ''), filter(split(b, ''), c -> c <> ''))) / size(array_union(filter(split(a, ''), c -> c <> ''), filter(split(b, ''), c -> c <> '')))"),
    "hamming": ("a STRING, b STRING", "BIGINT", "CASE WHEN length(a) = length(b) THEN cast(size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), d -> d)) AS BIGINT) END"),
    "isinf": ("x DOUBLE", "BOOLEAN", "abs(x) = double('Infinity')"),
    "isfinite": ("x DOUBLE", "BOOLEAN", "NOT isnan(x) AND abs(x) <> double('Infinity')"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 92), struct(abs(a) AS a, abs(b) AS b), (s, k) -> CASE WHEN s.b = 0 THEN s ELSE struct(s.b AS a, try_mod(s.a, s.b) AS b) END, s -> s.a)"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a = 0 OR b = 0 THEN 0L ELSE abs(a div aggregate(sequence(1, 92), struct(abs(a) AS a, abs(b) AS b), (s, k) -> CASE WHEN s.b = 0 THEN s ELSE struct(s.b AS a, try_mod(s.a, s.b) AS b) END, s -> s.a) * b) END"),
    "today": ("", "DATE", "current_date()"),
    "isoyear": ("t TIMESTAMP_NTZ", "INT", "extract(YEAROFWEEK FROM t)"),
    "millisecond": ("t TIMESTAMP_NTZ", "BIGINT", "pmod(unix_micros(cast(t AS TIMESTAMP)) div 1000, 60000)"),
    "microsecond": ("t TIMESTAMP_NTZ", "BIGINT", "pmod(unix_micros(cast(t AS TIMESTAMP)), 60000000)"),
    "epoch": ("t TIMESTAMP_NTZ", "DOUBLE", "unix_micros(cast(t AS TIMESTAMP)) / 1000000D"),
    "epoch_ns": ("t TIMESTAMP_NTZ", "BIGINT", "unix_micros(cast(t AS TIMESTAMP)) * 1000"),
    "gen_random_uuid": ("", "STRING", "uuid()"),
    "prefix": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
    "suffix": ("s STRING, p STRING", "BOOLEAN", "endswith(s, p)"),
    "epoch_ms": ("t TIMESTAMP_NTZ", "BIGINT", "cast(round(unix_micros(cast(t AS TIMESTAMP)) / 1000) AS BIGINT)"),
    "epoch_us": ("t TIMESTAMP_NTZ", "BIGINT", "unix_micros(cast(t AS TIMESTAMP))"),
    "isodow": ("t TIMESTAMP_NTZ", "INT", "weekday(t) + 1"),
    "yearweek": ("t TIMESTAMP_NTZ", "INT", "extract(YEAROFWEEK FROM t) * 100 + weekofyear(t)"),
    "string_to_array": ("s STRING, sep STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', sep, '\\\\E'))"),
    "regexp_matches": ("s STRING, p STRING", "BOOLEAN", "rlike(s, p)"),
    "regexp_full_match": ("s STRING, p STRING", "BOOLEAN", "rlike(s, concat('^(?:', p, ')$'))"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "sha512": ("s STRING", "STRING", "sha2(s, 512)"),
    "json_extract_string": ("j STRING, p STRING", "STRING", "get_json_object(j, p)"),
    "json_valid": ("j STRING", "BOOLEAN", "try_parse_json(j) IS NOT NULL AND j IS NOT NULL"),
    "st_point": ("x DOUBLE, y DOUBLE", "STRING", "concat('POINT (', regexp_replace(cast(x AS STRING), '[.]0$', ''), ' ', regexp_replace(cast(y AS STRING), '[.]0$', ''), ')')"),
}


def register(spark: SparkSession) -> None:
    """Make the dialect's names usable in spark.sql()."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name in ("gamma", "lgamma", "damerau_levenshtein", "jaro_similarity", "jaro_winkler_similarity", "strip_accents"):
        spark.udf.register(name, _OWN[name])
    for name in [n for n in dir(geo) if n.startswith("st_") and hasattr(getattr(geo, n), "returnType")]:
        spark.udf.register(name, getattr(geo, name))
