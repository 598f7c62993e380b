"""Scalar functions by family: numbers, strings, dates, lists, maps, JSON, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, nested, numeric, strings, temporal
from . import query, sql

c = F.col
sql("fn_rounding", "SELECT s_suppkey, round(s_acctbal, 1) AS r, bround(CAST(s_acctbal AS DECIMAL(12,2)), 1) AS b, CAST(ceil(s_acctbal) AS DOUBLE) AS ce, CAST(floor(s_acctbal) AS DOUBLE) AS fl, abs(s_acctbal) AS a FROM {supplier}",
    "SELECT s_suppkey, round(s_acctbal, 1) AS r, CAST(round_even(CAST(s_acctbal AS DECIMAL(12,2)), 1) AS DECIMAL(12,1)) AS b, ceil(s_acctbal) AS ce, floor(s_acctbal) AS fl, abs(s_acctbal) AS a FROM supplier")
sql("fn_logs_and_powers", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS a, round(cbrt(s_acctbal), 6) AS b, round(pow(s_suppkey, 1.5), 4) AS c, round(exp(s_nationkey / 10.0), 6) AS d, round(log10(s_suppkey + 1), 8) AS e, round(log2(s_suppkey + 1), 8) AS f, factorial(CAST(s_nationkey % 10 AS INT)) AS g FROM {supplier}",
    "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS a, round(cbrt(s_acctbal), 6) AS b, round(pow(s_suppkey, 1.5), 4) AS c, round(exp(s_nationkey / 10.0), 6) AS d, round(log10(s_suppkey + 1), 8) AS e, round(log2(s_suppkey + 1), 8) AS f, CAST(factorial(CAST(s_nationkey % 10 AS INT)) AS BIGINT) AS g FROM supplier")
sql("fn_trigonometry", "SELECT s_suppkey, " + ", ".join(f"round({f}(x), 8) AS {f}_" for f in ("sin", "cos", "tan", "cot", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians")) + ", round(atan2(x, 2), 8) AS at2, round(acosh(x + 1), 8) AS ach, round(pi(), 10) AS p FROM (SELECT s_suppkey, (s_suppkey % 90 + 1) / 100.0D AS x FROM {supplier}) s",
    "SELECT s_suppkey, " + ", ".join(f"round({f}(x), 8) AS {f}_" for f in ("sin", "cos", "tan", "cot", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians")) + ", round(atan2(x, 2), 8) AS at2, round(acosh(x + 1), 8) AS ach, round(pi(), 10) AS p FROM (SELECT s_suppkey, CAST((s_suppkey % 90 + 1) AS DOUBLE) / 100.0 AS x FROM supplier) s")
sql("fn_nulls_and_choice", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, ifnull(nullif(o_orderkey % 4, 0), -1) AS b, greatest(o_orderkey % 7, o_custkey % 5, 2) AS g, least(o_orderkey % 7, o_custkey % 5, 2) AS l, if(o_totalprice > 100000, 'y', 'n') AS i FROM {orders}")
sql("fn_bit_count", "SELECT n_nationkey, CAST(bit_count(n_nationkey) AS INT) AS b FROM {nation}")
sql("fn_width_bucket", "SELECT o_orderkey, width_bucket(o_totalprice, 0, 200000, 10) AS w FROM {orders}", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 200000 THEN 11 ELSE floor(o_totalprice / 20000) + 1 END AS BIGINT) AS w FROM orders")
sql("fn_case_and_trim", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, CAST(octet_length(c_name) AS BIGINT) AS o, trim('  ' || c_name || ' ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt FROM {customer}",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INT) AS n, CAST(strlen(c_name) AS BIGINT) AS o, trim('  ' || c_name || ' ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt FROM customer")
sql("fn_pad_repeat_replace", "SELECT n_nationkey, lpad(n_name, 12, '*') AS a, rpad(n_name, 5, '-') AS b, reverse(n_name) AS c, repeat(left(n_name, 1), 3) AS d, replace(n_name, 'A', 'aa') AS e, translate(n_name, 'AEI', '123') AS f, substring(n_name, 2, 3) AS g, right(n_name, 3) AS h FROM {nation}")
sql("fn_search", "SELECT n_nationkey, CAST(instr(n_name, 'A') AS BIGINT) AS i, contains(n_name, 'AN') AS c, startswith(n_name, 'F') AS s, endswith(n_name, 'A') AS e, ascii(n_name) AS a, chr(65 + n_nationkey) AS ch, split_part(n_name, 'A', 2) AS sp, concat_ws('-', n_name, nullif(n_name, n_name), 'x') AS cw FROM {nation}",
    "SELECT n_nationkey, instr(n_name, 'A') AS i, contains(n_name, 'AN') AS c, starts_with(n_name, 'F') AS s, ends_with(n_name, 'A') AS e, ascii(n_name) AS a, chr(65 + n_nationkey) AS ch, split_part(n_name, 'A', 2) AS sp, concat_ws('-', n_name, nullif(n_name, n_name), 'x') AS cw FROM nation")
sql("fn_hashes", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha2(n_name, 256) AS s2 FROM {nation}", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
sql("fn_base64", "SELECT n_nationkey, base64(encode(n_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS d FROM {nation}", "SELECT n_nationkey, base64(encode(n_name)) AS b, decode(from_base64(base64(encode(n_name)))) AS d FROM nation")
sql("fn_regexp", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS e, c_name RLIKE '1$' AS m, regexp_extract_all(c_name, '[0-9]', 0) AS al FROM {customer}", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS e, regexp_matches(c_name, '1$') AS m, regexp_extract_all(c_name, '[0-9]', 0) AS al FROM customer")
sql("fn_levenshtein", "SELECT n_nationkey, CAST(levenshtein(n_name, 'FRANCE') AS BIGINT) AS l FROM {nation}", "SELECT n_nationkey, levenshtein(n_name, 'FRANCE') AS l FROM nation")
sql("fn_format", "SELECT n_nationkey, format_string('%05d|%s|%.2f', n_nationkey, n_name, 1.5D) AS f FROM {nation}", "SELECT n_nationkey, printf('%05d|%s|%.2f', n_nationkey, n_name, 1.5) AS f FROM nation")


@query("SELECT s_suppkey, trunc(s_acctbal) AS t, even(s_acctbal) AS e, CAST(sign(s_acctbal) AS INT) AS s, signbit(s_acctbal) AS sb, gcd(s_suppkey, 12) AS g, lcm(s_suppkey, 4) AS l, round(log(2, s_suppkey + 1), 8) AS lg, s_acctbal / nullif(0, 1) AS inf FROM supplier")
def fn_numeric_dialect(t):
    x, k = c("s_acctbal"), c("s_suppkey")
    return t.supplier.select("s_suppkey", numeric.trunc(x).alias("t"), numeric.even(x).alias("e"), numeric.sign(x).alias("s"), numeric.signbit(x).alias("sb"), numeric.gcd(k, F.lit(12)).alias("g"), numeric.lcm(k, F.lit(4)).alias("l"), F.round(numeric.log(F.lit(2), k + 1), 8).alias("lg"), numeric.divide(x, F.lit(0)).alias("inf"))


@query("SELECT s_suppkey, round(gamma(x), 6) AS g, round(lgamma(x), 8) AS l FROM (SELECT s_suppkey, s_suppkey % 9 + 0.5::DOUBLE AS x FROM supplier)")
def fn_gamma(t):
    d = t.supplier.select("s_suppkey", (c("s_suppkey") % 9 + F.lit(0.5)).alias("x"))
    return d.select("s_suppkey", F.round(numeric.gamma("x"), 6).alias("g"), F.round(numeric.lgamma("x"), 8).alias("l"))


@query("SELECT o_orderkey, isnan(x) AS n, isinf(x) AS i, isfinite(x) AS f FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE 1 END AS x FROM orders)")
def fn_float_classes(t):
    d = t.orders.select("o_orderkey", F.when(c("o_orderkey") % 3 == 0, float("nan")).when(c("o_orderkey") % 3 == 1, float("inf")).otherwise(1.0).alias("x"))
    return d.select("o_orderkey", F.isnan("x").alias("n"), numeric.isinf(c("x")).alias("i"), numeric.isfinite(c("x")).alias("f"))


@query("SELECT n_nationkey, concat(n_name, nullif(n_name, n_name), 'x') AS c, left(n_name, -2) AS l, right(n_name, -2) AS r, substring(n_name, 0, 3) AS s, string_split(n_name, 'A') AS sp, strip_accents('é' || n_name) AS sa, url_encode(n_name || ' &') AS u FROM nation")
def fn_string_dialect(t):
    n = c("n_name")
    return t.nation.select("n_nationkey", strings.concat(n, F.nullif(n, n), F.lit("x")).alias("c"), strings.left(n, -2).alias("l"), strings.right(n, -2).alias("r"), strings.substring(n, 0, 3).alias("s"), strings.string_split(n, "A").alias("sp"), strings.strip_accents(F.concat(F.lit("é"), n)).alias("sa"), strings.url_encode(F.concat(n, F.lit(" &"))).alias("u"))


@query(r"SELECT c_custkey, regexp_replace(c_name, '0', '_') AS a, regexp_replace(c_name, '0', '_', 'g') AS b, regexp_replace(c_name, '([0-9])([0-9])', '\2\1') AS c, regexp_full_match(c_name, 'Customer.*') AS f FROM customer")
def fn_regexp_replace(t):
    n = c("c_name")
    return t.customer.select("c_custkey", strings.regexp_replace(n, "0", "_").alias("a"), strings.regexp_replace(n, "0", "_", "g").alias("b"), strings.regexp_replace(n, "([0-9])([0-9])", r"\2\1").alias("c"), strings.regexp_full_match(n, "Customer.*").alias("f"))


@query("SELECT n_nationkey, CASE WHEN length(n_name) = 6 THEN hamming(n_name, 'FRANCE') END AS h, round(jaccard(n_name, 'GERMANY'), 8) AS j, round(jaro_similarity(n_name, 'GERMANY'), 8) AS js, round(jaro_winkler_similarity(n_name, 'GERMANY'), 8) AS jw, damerau_levenshtein(n_name, 'GERAMNY') AS d FROM nation")
def fn_distances(t):
    n, g = c("n_name"), F.lit("GERMANY")
    return t.nation.select("n_nationkey", strings.hamming(n, F.lit("FRANCE")).alias("h"), F.round(strings.jaccard(n, g), 8).alias("j"), F.round(strings.jaro_similarity(n, g), 8).alias("js"), F.round(strings.jaro_winkler_similarity(n, g), 8).alias("jw"), strings.damerau_levenshtein(n, F.lit("GERAMNY")).alias("d"))


_PARTS = ("year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond", "dow", "isodow", "doy", "week", "isoyear", "quarter", "decade", "century")


@query("SELECT event_id, " + ", ".join(f"CAST(date_part('{p}', ts) AS BIGINT) AS {p}_" for p in _PARTS) + " FROM events")
def fn_date_parts(t):
    return t.events.select("event_id", *(temporal.date_part(p, c("ts")).alias(f"{p}_") for p in _PARTS))


_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@query("SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u}_" for u in _UNITS) + " FROM events")
def fn_date_trunc(t):
    return t.events.select("event_id", *(temporal.date_trunc(u, c("ts")).alias(f"{u}_") for u in _UNITS))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"date_diff('{u}', o_orderdate, l_shipdate + INTERVAL 5 HOUR) AS {u}_" for u in _UNITS) + ", date_sub('month', o_orderdate, l_shipdate) AS sub_month, date_sub('day', o_orderdate, l_shipdate) AS sub_day FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def fn_date_diff(t):
    d = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).withColumn("e", F.expr("l_shipdate + INTERVAL 5 HOUR"))
    return d.select("l_orderkey", "l_linenumber", *(temporal.date_diff(u, c("o_orderdate"), c("e")).alias(f"{u}_") for u in _UNITS), temporal.date_sub("month", c("o_orderdate"), c("l_shipdate")).alias("sub_month"), temporal.date_sub("day", c("o_orderdate"), c("l_shipdate")).alias("sub_day"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 13 MONTH + INTERVAL 2 DAY AS a, last_day(o_orderdate) AS l, make_date(year(o_orderdate), 2, 28) AS m, make_timestamp(2024, 2, 3, 4, 5, 6.5) AS mt, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn FROM orders")
def fn_date_building(t):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", temporal.date_add(d, 13, 2).alias("a"), F.last_day(d).alias("l"), F.make_date(F.year(d), F.lit(2), F.lit(28)).alias("m"), F.make_timestamp_ntz(F.lit(2024), F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit(6.5)).alias("mt"), temporal.dayname(d).alias("dn"), temporal.monthname(d).alias("mn"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, strptime(strftime(ts, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS p, epoch_ms(ts) AS ms, epoch_us(ts) AS us, epoch_ns(ts) AS ns, round(epoch(ts), 3) AS s FROM events")
def fn_date_formats(t):
    ts = c("ts")
    return t.events.select("event_id", temporal.strftime(ts, "%Y-%m-%d %H:%M:%S").alias("f"), temporal.strptime(temporal.strftime(ts, "%d/%m/%Y %H:%M"), "%d/%m/%Y %H:%M").alias("p"), temporal.epoch_ms(ts).alias("ms"), temporal.micros(ts).alias("us"), temporal.epoch_ns(ts).alias("ns"), F.round(temporal.epoch(ts), 3).alias("s"))


@query("SELECT event_id, time_bucket(INTERVAL '7 days', ts) AS w, time_bucket(INTERVAL '15 minutes', ts) AS q, time_bucket(INTERVAL '3 months', ts) AS m FROM events")
def fn_time_bucket(t):
    ts = c("ts")
    return t.events.select("event_id", temporal.time_bucket(ts, 7 * temporal.MICROS["day"]).alias("w"), temporal.time_bucket(ts, 15 * temporal.MICROS["minute"]).alias("q"), temporal.time_bucket(ts, width_months=3).alias("m"))


@query("SELECT l_orderkey, l_linenumber, CAST(datepart('year', a) * 12 + datepart('month', a) AS BIGINT) AS months, CAST(datepart('day', a) AS BIGINT) AS days FROM (SELECT l_orderkey, l_linenumber, age(l_shipdate, o_orderdate) AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey)")
def fn_age(t):
    d = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).withColumn("a", temporal.age(c("l_shipdate"), c("o_orderdate")))
    return d.select("l_orderkey", "l_linenumber", "a.months", "a.days")


_LISTS = "(SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x, list(nullif(o_orderkey % 4, 3) ORDER BY o_orderkey) AS y FROM orders GROUP BY o_custkey)"


def _lists(t):
    d = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    return d.withColumn("y", F.transform("x", lambda v: F.nullif(v % 4, F.lit(3))))


@query(f"SELECT o_custkey, list_element(x, 2) AS a, list_element(x, -1) AS b, list_element(x, 0) AS c, list_append(x, 7) AS d, list_prepend(7, x) AS e, list_contains(x, 7) AS f, list_position(x, 7) AS g, list_reverse(x) AS h, list_sort(list_distinct(y)) AS i, list_concat(x, [1, 2]::BIGINT[]) AS j, CAST(len(x) AS INT) AS k, x[2:3] AS l FROM {_LISTS}")
def fn_lists(t):
    d, x, y, s = _lists(t), c("x"), c("y"), F.lit(7).cast("long")
    return d.select(
        "o_custkey", nested.list_element(x, 2).alias("a"), nested.list_element(x, -1).alias("b"), nested.list_element(x, 0).cast("long").alias("c"), F.array_append(x, s).alias("d"), F.array_prepend(x, s).alias("e"), F.array_contains(x, s).alias("f"), nested.list_position(x, s).alias("g"),
        F.reverse(x).alias("h"), nested.list_distinct(y).alias("i"), F.concat(x, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("j"), F.size(x).alias("k"), F.slice(x, 2, 2).alias("l"),
    )


@query(f"SELECT o_custkey, list_transform(x, lambda v: v * 2) AS a, list_filter(x, lambda v: v % 2 = 0) AS b, list_reduce(x, lambda p, q: p + q) AS c, round(CAST(list_aggregate(x, 'sum') AS DOUBLE), 2) AS s, round(list_aggregate(x, 'avg'), 6) AS av, list_aggregate(y, 'min') AS mi, list_aggregate(y, 'max') AS ma, CAST(list_aggregate(y, 'count') AS BIGINT) AS n, array_to_string(x, '-') AS st, list_resize(x, 3) AS rs FROM {_LISTS}")
def fn_list_lambdas(t):
    d, x, y = _lists(t), c("x"), c("y")
    return d.select(
        "o_custkey", F.transform(x, lambda v: v * 2).alias("a"), F.filter(x, lambda v: v % 2 == 0).alias("b"), nested.list_reduce(x, lambda p, q: p + q).alias("c"), F.round(nested.list_aggregate(x, "sum"), 2).alias("s"), F.round(nested.list_aggregate(x, "avg"), 6).alias("av"),
        nested.list_aggregate(y, "min").alias("mi"), nested.list_aggregate(y, "max").alias("ma"), nested.list_aggregate(y, "count").alias("n"), F.array_join(x, "-").alias("st"), nested.list_resize(x, 3).alias("rs"),
    )


@query("SELECT n_nationkey, s.a AS a, s.b AS b, m['y'] AS y, list_sort(map_keys(m)) AS k, CAST(cardinality(m) AS INT) AS n, map_contains(m, 'x') AS h, flatten([[n_nationkey], [1, 2]]) AS f FROM (SELECT n_nationkey, {'a': n_name, 'b': n_regionkey} AS s, MAP {'x': n_nationkey, 'y': n_regionkey} AS m FROM nation)")
def fn_structs_maps(t):
    d = t.nation.select("n_nationkey", F.struct(c("n_name").alias("a"), c("n_regionkey").alias("b")).alias("s"), F.create_map(F.lit("x"), c("n_nationkey"), F.lit("y"), c("n_regionkey")).alias("m"))
    return d.select("n_nationkey", "s.a", "s.b", F.try_element_at("m", F.lit("y")).alias("y"), F.sort_array(F.map_keys("m")).alias("k"), F.size("m").alias("n"), F.map_contains_key("m", "x").alias("h"), F.flatten(F.array(F.array("n_nationkey"), F.array(F.lit(1), F.lit(2)))).alias("f"))


@query("SELECT n_nationkey, CAST(union_tag(u) AS VARCHAR) AS tag, u.num AS num, u.str AS str FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN union_value(num := n_nationkey)::UNION(num INT, str VARCHAR) ELSE union_value(str := n_name)::UNION(num INT, str VARCHAR) END AS u FROM nation)")
def fn_unions(t):
    kinds = {"num": "int", "str": "string"}
    d = t.nation.withColumn("u", F.when(c("n_nationkey") % 2 == 0, nested.union_value("num", c("n_nationkey"), kinds)).otherwise(nested.union_value("str", c("n_name"), kinds)))
    return d.select("n_nationkey", nested.union_tag(c("u")).alias("tag"), nested.union_extract(c("u"), "num").alias("num"), nested.union_extract(c("u"), "str").alias("str"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS j, json_valid(props) AS v, json_keys(props) AS ks, json_type(props) AS ty, CAST(json_array_length('[1,2,3]') AS INT) AS n, json_contains(props, '{}') AS co FROM events")
def fn_json(t):
    p = c("props")
    return t.events.select("event_id", nested.json_extract_string(p, "$.k").cast("long").alias("k"), nested.json_extract(p, "$.k").alias("j"), nested.json_valid(p).alias("v"), nested.json_keys(p).alias("ks"), nested.json_type(p).alias("ty"), F.json_array_length(F.lit("[1,2,3]")).alias("n"), nested.json_contains(p, F.lit("{}")).alias("co"))


@query("SELECT n_nationkey, CAST(json_object('n', n_name, 'k', n_nationkey) AS VARCHAR) AS o, CAST(json_array(n_name, n_nationkey) AS VARCHAR) AS a, CAST(json_quote(n_name) AS VARCHAR) AS q, CAST(to_json([n_nationkey, 1]) AS VARCHAR) AS l FROM nation")
def fn_json_building(t):
    return t.nation.select("n_nationkey", nested.json_object(n=c("n_name"), k=c("n_nationkey")).alias("o"), nested.json_array(c("n_name"), c("n_nationkey")).alias("a"), nested.json_quote(c("n_name")).alias("q"), F.to_json(F.array("n_nationkey", F.lit(1))).alias("l"))


@query("SELECT s_suppkey, round(sqrt(power(x - 1, 2) + power(y - 2, 2)), 8) AS d, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(52 - y) / 2), 2) + cos(radians(y)) * cos(radians(52)) * power(sin(radians(13 - x) / 2), 2))), 3) AS s, 'POINT (' || s_nationkey || ' ' || s_suppkey || ')' AS p FROM (SELECT *, s_nationkey::DOUBLE AS x, (s_suppkey % 60)::DOUBLE AS y FROM supplier)")
def fn_geo_points(t):
    x, y = c("s_nationkey").cast("double"), (c("s_suppkey") % 60).cast("double")
    return t.supplier.select("s_suppkey", F.round(geo.point_distance(x, y, F.lit(1.0), F.lit(2.0)), 8).alias("d"), F.round(geo.sphere_distance(x, y, F.lit(13.0), F.lit(52.0)), 3).alias("s"), geo.st_point(c("s_nationkey"), c("s_suppkey")).alias("p"))


@query("SELECT s_suppkey, x >= 3 AND x <= 15 AND y >= 2 AND y <= 40 AS hit, x > 3 AND x < 15 AND y > 2 AND y < 40 AS inside, 456.0::DOUBLE AS area, 100.0::DOUBLE AS perimeter, 'POINT (9 21)' AS centroid FROM (SELECT *, s_nationkey AS x, s_suppkey % 60 AS y FROM supplier)")
def fn_geo_shapes(t):
    box = F.lit("POLYGON ((3 2, 15 2, 15 40, 3 40, 3 2))")
    p = geo.st_point(c("s_nationkey"), c("s_suppkey") % 60)
    return t.supplier.select("s_suppkey", geo.st_intersects(box, p).alias("hit"), geo.st_contains(box, p).alias("inside"), geo.st_area(box).alias("area"), geo.st_perimeter(box).alias("perimeter"), geo.st_centroid(box).alias("centroid"))
