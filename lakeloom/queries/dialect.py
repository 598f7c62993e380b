"""The dialect's functions by name, as the registry builds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registry import function as f
from ..functions.registry import register
from ..plans.catalog import Enumeration
from . import query

c = F.col


@query("SELECT s_suppkey, round(log(abs(s_acctbal) + 1), 8) AS l10, round(log(2, s_suppkey + 1), 8) AS l2, mod(s_suppkey, 7) AS m, lcm(9007199254740993, s_suppkey % 2 + 1) AS big, if(s_suppkey % 2 = 0, 'even', 'odd') AS i, round(exp(1), 10) AS e, isnan('nan'::DOUBLE) AS n, 'inf'::DOUBLE AS inf, gamma(0 - s_suppkey % 3) AS g, gamma(200.0 + s_suppkey) AS over, lgamma(0 - s_suppkey % 2) AS lg, gcd(s_suppkey, 12) AS gcd, bit_length('abc') AS bits FROM supplier")
def fn_names_numbers(t):
    k = c("s_suppkey")
    return t.supplier.select(
        "s_suppkey", F.round(f("log")(F.abs("s_acctbal") + 1), 8).alias("l10"), F.round(f("log")(F.lit(2), k + 1), 8).alias("l2"), f("mod")(k, F.lit(7)).alias("m"), f("lcm")(F.lit(9007199254740993), k % 2 + 1).alias("big"),
        f("if")(k % 2 == 0, F.lit("even"), F.lit("odd")).alias("i"), F.round(f("e")(), 10).alias("e"), F.isnan(f("nan")()).alias("n"), f("inf")().alias("inf"), f("gamma")((0 - k % 3).cast("double")).alias("g"), f("gamma")(200.0 + k).alias("over"),
        f("lgamma")((0 - k % 2).cast("double")).alias("lg"), f("gcd")(k, F.lit(12)).alias("gcd"), f("bit_length")(F.lit("abc")).cast("long").alias("bits"),
    )


@query(r"SELECT n_nationkey, position('A' IN n_name) AS p, strpos(n_name, 'N') AS s, instr(n_name, 'R') AS i, sha256(n_name) AS h, like_escape(n_name || '%', '%A$%', '$') AS le, decode(encode(n_name)) AS d, prefix(n_name, 'N') AS pre, suffix(n_name, 'A') AS suf, ord(n_name) AS o, ucase(lcase(n_name)) AS u, starts_with(n_name, 'I') AS sw, array_to_string(string_split(n_name, 'A'), '+') AS sp, regexp_matches(n_name, '^[A-I]') AS rm, strlen(n_name) AS l FROM nation")
def fn_names_strings(t):
    n = c("n_name")
    return t.nation.select(
        "n_nationkey", f("position")(F.lit("A"), n).alias("p"), f("strpos")(n, F.lit("N")).cast("long").alias("s"), f("instr")(n, F.lit("R")).cast("long").alias("i"), f("sha256")(n).alias("h"), f("like_escape")(F.concat(n, F.lit("%")), F.lit("%A$%"), "$").alias("le"),
        f("decode")(f("encode")(n)).alias("d"), f("prefix")(n, F.lit("N")).alias("pre"), f("suffix")(n, F.lit("A")).alias("suf"), f("ord")(n).alias("o"), f("ucase")(f("lcase")(n)).alias("u"), f("starts_with")(n, F.lit("I")).alias("sw"),
        f("array_to_string")(f("string_split")(n, "A"), "+").alias("sp"), f("regexp_matches")(n, F.lit("^[A-I]")).alias("rm"), f("strlen")(n).cast("long").alias("l"),
    )


@query("SELECT n_nationkey, typeof(n_nationkey) AS a, typeof(n_name) AS b, typeof([n_nationkey]) AS c, typeof(DATE '2020-01-01') AS d, typeof(1.25::DECIMAL(5,2)) AS e, pg_typeof(1::DOUBLE) AS f, typeof(true) AS g, typeof([[1::BIGINT]]) AS h FROM nation")
def fn_names_types(t):
    k = c("n_nationkey")
    return t.nation.select(
        k, f("typeof")(k).alias("a"), f("typeof")(c("n_name")).alias("b"), f("typeof")(F.array(k)).alias("c"), f("typeof")(F.lit("2020-01-01").cast("date")).alias("d"), f("typeof")(F.lit("1.25").cast("decimal(5,2)")).alias("e"),
        f("pg_typeof")(F.lit(1.0)).alias("f"), f("typeof")(F.lit(True)).alias("g"), f("typeof")(F.array(F.array(F.lit(1).cast("bigint")))).alias("h"),
    )


_PARTS = "year month day hour minute second millisecond microsecond dayofweek isodow dayofyear week isoyear yearweek quarter decade century".split()


@query("SELECT event_id, " + ", ".join(f"{p}(ts) AS {p}_" for p in _PARTS) + ", strftime(ts, '%Y/%m/%d') AS s FROM events")
def fn_names_dates(t):
    return t.events.select("event_id", *(f(p)(c("ts")).alias(f"{p}_") for p in _PARTS), f("to_char")(c("ts"), "%Y/%m/%d").alias("s"))


_UNITS = "decades years months weeks days hours minutes seconds milliseconds".split()


@query("SELECT event_id, " + ", ".join(f"ts + to_{u}((event_id % 5)::INTEGER) AS {u}_" for u in _UNITS) + " FROM events")
def fn_interval_builders(t):
    k = (c("event_id") % 5).cast("int")
    return t.events.select("event_id", *((c("ts") + f(f"to_{u}")(k)).alias(f"{u}_") for u in _UNITS))


@query("SELECT event_id, round((k * 30.4375 + k * 2 + k * 3 / 24.0) / 365.25, 8) AS y, round(k + (k * 2 + k * 3 / 24.0) / 30.4375, 8) AS mo, round(k * 30.4375 + k * 2 + k * 3 / 24.0, 8) AS d, round(24 * (k * 30.4375 + k * 2) + k * 3, 6) AS h, round(60 * (24 * (k * 30.4375 + k * 2) + k * 3), 4) AS mi, round(3600 * (24 * (k * 30.4375 + k * 2) + k * 3), 2) AS s FROM (SELECT event_id, (event_id % 5)::DOUBLE AS k FROM events)")
def fn_interval_totals(t):
    k = c("event_id") % 5
    d = t.events.select("event_id", F.make_interval(F.lit(0), k, F.lit(0), k * 2, k * 3).alias("i"))
    total = lambda unit, digits: F.round(f(f"total_{unit}")(c("i")), digits)
    return d.select("event_id", total("years", 8).alias("y"), total("months", 8).alias("mo"), total("days", 8).alias("d"), total("hours", 6).alias("h"), total("minutes", 4).alias("mi"), total("seconds", 2).alias("s"))


@query("SELECT n_nationkey, list_prepend(7, x) AS a, list_reverse_sort(x) AS b, list_sort(x) AS c, map_extract(m, 'x') AS d, map_extract(m, 'z') AS e, element_at(m, 'y') AS f, struct_extract(s, 'a') AS g, struct_keys(s) AS h, struct_insert(s, d := 5).d AS i, list_has(x, 2) AS j, list_concat(x, [9]) AS k, array_length(x)::INT AS l, list_distinct([1, 1]) AS o FROM (SELECT n_nationkey, [n_nationkey, NULL, 2] AS x, map(['x', 'y'], [n_nationkey, n_regionkey]) AS m, {'a': n_nationkey, 'b': NULL::INTEGER} AS s FROM nation)")
def fn_names_nested(t):
    k = c("n_nationkey")
    d = t.nation.select(k, F.array(k, F.lit(None), F.lit(2)).alias("x"), f("map")(F.array(F.lit("x"), F.lit("y")), F.array(k, c("n_regionkey"))).alias("m"), f("struct_pack")(a=k, b=F.lit(None).cast("int")).alias("s"))
    x, m, s = c("x"), c("m"), c("s")
    return d.select(
        k, f("list_prepend")(F.lit(7), x).alias("a"), f("list_reverse_sort")(x).alias("b"), f("list_sort")(x).alias("c"), f("map_extract")(m, F.lit("x")).alias("d"), f("map_extract")(m, F.lit("z")).alias("e"), f("element_at")(m, F.lit("y")).alias("f"), f("struct_extract")(s, "a").alias("g"),
        f("struct_keys")(s).alias("h"), f("struct_insert")(s, d=F.lit(5)).getField("d").alias("i"), f("list_has")(x, F.lit(2)).alias("j"), f("list_concat")(x, F.array(F.lit(9))).alias("k"), f("array_length")(x).alias("l"), f("list_distinct")(F.array(F.lit(1), F.lit(1))).alias("o"),
    )


@query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.25), 4) AS q, list_transform(quantile_cont(o_totalprice, [0.25, 0.75]), lambda x: round(x, 4)) AS qs, quantile_disc(o_totalprice, 0.5) AS d, arg_min(o_orderkey, o_totalprice) AS lo, max_by(o_orderkey, o_totalprice) AS hi, list(o_orderkey ORDER BY o_orderkey) AS l, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS s, group_concat(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS g FROM orders GROUP BY o_custkey")
def agg_names(t):
    by_status = t.orders.select("o_custkey", "o_orderstatus").distinct().groupBy("o_custkey").agg(f("group_concat")("o_orderstatus").alias("g"))
    price = "o_totalprice"
    made = t.orders.groupBy("o_custkey").agg(
        F.round(f("quantile_cont")(price, 0.25), 4).alias("q"), F.transform(f("quantile")(price, [0.25, 0.75]), lambda x: F.round(x, 4)).alias("qs"), f("percentile_disc")(0.5, price).alias("d"), f("arg_min")("o_orderkey", price, "o_orderkey").alias("lo"), f("max_by")("o_orderkey", price, "o_orderkey").alias("hi"),
        f("list")("o_orderkey").alias("l"), F.round(f("sum_if")(price, c("o_orderstatus") == "F"), 2).alias("s"),
    )
    return made.join(by_status, "o_custkey")


@query("SELECT n_nationkey, ['low', 'mid', 'high'] AS r, 'low' AS a, 'high' AS b FROM nation")
def fn_enums(t):
    kind = Enumeration("low", "mid", "high")
    return t.nation.select("n_nationkey", f("enum_range")(kind).alias("r"), f("enum_first")(kind).alias("a"), f("enum_last")(kind).alias("b"))


@query("SELECT n_nationkey, sha256(n_name) AS h, even(n_nationkey::DOUBLE) AS e, gcd(n_nationkey, 12) AS g, lcm(n_nationkey, 4) AS l, strlen(n_name) AS n, jaccard(n_name, 'FRANCE') AS j, suffix(n_name, 'A') AS s, isfinite(n_nationkey::DOUBLE) AS i FROM nation")
def sql_names(t):
    """The dialect's names in SQL text."""
    register(t.spark)
    t.nation.createOrReplaceTempView("dialect_nation")
    return t.spark.sql("SELECT n_nationkey, sha256(n_name) AS h, even(n_nationkey) AS e, gcd(n_nationkey, 12) AS g, lcm(n_nationkey, 4) AS l, strlen(n_name) AS n, jaccard(n_name, 'FRANCE') AS j, suffix(n_name, 'A') AS s, isfinite(n_nationkey) AS i FROM dialect_nation")


@query("SELECT n_nationkey, x * 16 + 16 - 4 * x AS u, 4 * x AS i, 16 * x - 4 * x AS d, 'POINT (1 2)' AS a, 4326 AS s, CASE WHEN n_nationkey % 2 = 0 THEN 3.0 END AS z, 'LINESTRING (0 0, ' || n_nationkey || ' 1)' AS l, 'POLYGON ((0 0, 4 0, 4 4, 0 0))' AS p, true AS t, true AS o, true AS e, true AS w FROM (SELECT n_nationkey, 1.0::DOUBLE AS x FROM nation)")
def fn_geo_overlays(t):
    """Two squares of side 4 that share a square of side 2, and constructors and predicates around them."""
    a, b, k = F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), F.lit("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"), c("n_nationkey")
    point = F.when(k % 2 == 0, F.lit("POINT Z (1 2 3)")).otherwise(F.lit("POINT (1 2)"))
    line = f("st_makeline")(F.lit("POINT (0 0)"), f("st_point")(k, F.lit(1)))
    return t.nation.select(
        k, f("st_area")(f("st_union")(a, b)).alias("u"), f("st_area")(f("st_intersection")(a, b)).alias("i"), f("st_area")(f("st_difference")(a, b)).alias("d"), f("st_astext")(f("st_setsrid")(F.lit("POINT (1 2)"), 4326)).alias("a"),
        f("st_srid")(f("st_setsrid")(F.lit("POINT (1 2)"), 4326)).alias("s"), f("st_z")(point).alias("z"), line.alias("l"), f("st_makepolygon")(F.lit("LINESTRING (0 0, 4 0, 4 4, 0 0)")).alias("p"),
        f("st_touches")(a, F.lit("POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))")).alias("t"), f("st_overlaps")(a, b).alias("o"), f("st_equals")(a, f("st_geomfromtext")(F.lit("polygon((4 0,4 4,0 4,0 0,4 0))"))).alias("e"), f("st_equals")(a, f("st_fromwkb")(f("st_aswkb")(a))).alias("w"),
    )
