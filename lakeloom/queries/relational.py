"""Scans, filters, predicates, projections, subqueries, order, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import joins, reshape, setops, sorting
from . import query, sql


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1_pricing_summary(t):
    price = F.col("l_extendedprice")
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("count_order"))
    )


sql("q6_forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24")
sql("scan_projection", "SELECT o_orderkey, o_totalprice FROM {orders}")
sql("filter_point", "SELECT * FROM {orders} WHERE o_orderkey = 7")
sql("filter_range", "SELECT o_orderkey FROM {orders} WHERE o_orderkey BETWEEN 100 AND 200 AND o_totalprice > 1000")
sql("dummy_scan", "SELECT 1 AS one, 'x' AS x")
sql("values_table", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
sql("three_valued_logic", "SELECT o_orderkey, (nullif(o_orderstatus, 'F') = 'O' AND o_totalprice > 1000) AS both, (nullif(o_orderstatus, 'F') = 'O' OR o_totalprice > 1000) AS either, NOT (nullif(o_orderstatus, 'F') = 'O') AS negated FROM {orders}")
sql("is_null", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS missing, nullif(o_orderstatus, 'F') IS NOT NULL AS present FROM {orders}")
sql("is_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS differs, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderstatus, 'F') AS same FROM {orders}")
sql("between_and_in", "SELECT o_orderkey FROM {orders} WHERE o_totalprice NOT BETWEEN 1000 AND 100000 AND o_orderpriority IN (SELECT max(o_orderpriority) FROM {orders} UNION SELECT min(o_orderpriority) FROM {orders})")
sql("in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 150000)")
sql("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL)")
sql("not_in_with_null", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders})")
sql("exists_subquery", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
sql("not_exists_subquery", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
sql("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})")
sql("correlated_subquery", "SELECT o_orderkey FROM {orders} a WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} b WHERE b.o_custkey = a.o_custkey)")
sql("case_searched_and_simple", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM {orders}")
sql("like_ilike", "SELECT c_custkey, c_name LIKE 'Customer%1' AS a, c_name ILIKE 'CUSTOMER#%' AS b, c_mktsegment NOT LIKE '%U%' AS c FROM {customer}")
sql("like_escape", r"SELECT c_custkey, c_name || '_x' LIKE '%|_x' ESCAPE '|' AS a FROM {customer}")
sql("concat_operator", "SELECT n_name || '-' || nullif(n_name, 'FRANCE') AS x, n_nationkey FROM {nation}")
sql("bitwise_operators", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS b, ~n_nationkey AS c, shiftleft(n_nationkey, 2) AS d, shiftright(n_nationkey, 1) AS e, n_nationkey ^ 5 AS f FROM {nation}",
    "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS b, ~n_nationkey AS c, n_nationkey << 2 AS d, n_nationkey >> 1 AS e, xor(n_nationkey, 5) AS f FROM nation")
sql("cast_and_try_cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, try_cast(o_orderstatus AS INT) AS bad, CAST(o_totalprice AS DECIMAL(18,2)) AS d FROM {orders}",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, try_cast(o_orderstatus AS INT) AS bad, CAST(o_totalprice AS DECIMAL(18,2)) AS d FROM orders")
sql("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) AS a, round(l_quantity - l_discount, 4) AS b, round(l_extendedprice * l_discount, 4) AS c, l_extendedprice / l_quantity AS d, l_orderkey % 7 AS e FROM {lineitem} WHERE l_quantity <> 0")
sql("star_except", "SELECT * EXCEPT (c_acctbal, c_name) FROM {customer}", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
sql("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
sql("order_nulls", "SELECT o_orderkey, x, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, o_orderkey) AS BIGINT) AS last, CAST(row_number() OVER (ORDER BY x NULLS FIRST, o_orderkey DESC) AS BIGINT) AS first FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS x FROM {orders}) s")
sql("common_table_expressions", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey), b AS (SELECT avg(s) AS m FROM a) SELECT o_custkey, round(s, 2) AS total FROM a, b WHERE s > m")
sql("extract_parts", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q FROM {orders}")
sql("interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS next_month, o_orderdate - INTERVAL '3' DAY AS before FROM {orders}")


@query("SELECT o_orderkey, 'first' AS way FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'second' FROM orders WHERE o_totalprice BETWEEN 50000.0 AND 60000.0 AND o_orderstatus <> 'F'")
def parameters(t):
    """Bound by place and by name."""
    t.orders.createOrReplaceTempView("parameter_orders")
    first = t.spark.sql("SELECT o_orderkey, 'first' AS way FROM parameter_orders WHERE o_totalprice > ? AND o_orderstatus = ?", args=[100000.0, "O"])
    second = t.spark.sql("SELECT o_orderkey, 'second' AS way FROM parameter_orders WHERE o_totalprice BETWEEN :low AND :high AND o_orderstatus <> :status", args={"low": 50000.0, "high": 60000.0, "status": "F"})
    return first.unionAll(second)


@query("SELECT o_orderkey % 7 AS k, o_orderkey FROM orders QUALIFY rank() OVER (ORDER BY o_orderkey % 7 DESC) <= 5")
def with_ties_of_expressions(t):
    return sorting.with_ties(t.orders.select((F.col("o_orderkey") % 7).alias("k"), "o_orderkey"), 5, [(F.col("o_orderkey") % 7).desc()])


@query("SELECT c_custkey, c_name, round(c_acctbal * 2, 2) AS c_acctbal FROM customer")
def star_replace(t):
    return t.customer.withColumn("c_acctbal", F.round(F.col("c_acctbal") * 2, 2)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT COLUMNS('o_order.*') FROM orders")
def columns_regex(t):
    return t.orders.select(t.orders.colRegex("`o_order.*`"))


@query("SELECT c_custkey, c_name SIMILAR TO 'Customer#[0-9]+' AS a, c_mktsegment SIMILAR TO '(AUTO|BUILD).*' AS b FROM customer")
def similar_to(t):
    return t.customer.select("c_custkey", strings.similar_to(F.col("c_name"), "Customer#[0-9]+").alias("a"), strings.similar_to(F.col("c_mktsegment"), "(AUTO|BUILD)%").alias("b"))


@query("SELECT n_nationkey FROM nation WHERE n_name COLLATE NOCASE = 'france' OR lower(n_name) = 'nation_3'")
def collate_nocase(t):
    return t.nation.where(F.expr("n_name COLLATE UTF8_LCASE = 'france'") | (F.lower("n_name") == "nation_3")).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 30 FROM customer) AND o_totalprice > ALL (SELECT c_acctbal * 12 FROM customer)")
def quantified_comparison(t):
    other = t.customer.select((F.col("c_acctbal") * 30).alias("x"), (F.col("c_acctbal") * 12).alias("y"))
    value = F.col("o_totalprice")
    return t.orders.where(joins.compare_any(t.orders, value, ">", other, "x") & joins.compare_all(t.orders, value, ">", other, "y")).select("o_orderkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return sorting.distinct_on(t.orders, ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, rank() OVER (ORDER BY o_orderpriority) AS r FROM orders) WHERE r <= 10")
def limit_with_ties(t):
    return sorting.with_ties(t.orders, 10, ["o_orderpriority"]).select("o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return sorting.top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_group(t):
    return sorting.top_k_per_group(t.orders, ["o_custkey"], 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT 100 AS n")
def sample_reservoir(t):
    return sorting.reservoir(t.orders, 100, seed=3).agg(F.count("*").cast("int").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS of, true AS near, true AS repeats, true AS inside FROM orders")
def sample_bernoulli(t):
    """Whether ten percent is within five standard deviations, the same seed draws the same rows, and all are rows of the table."""
    rows = t.orders.select("o_orderkey")
    one, two = (sorting.bernoulli(rows, 10, seed=3) for _ in range(2))
    drawn = one.agg(F.count("*").alias("n")).crossJoin(one.exceptAll(two).unionAll(two.exceptAll(one)).agg(F.count("*").alias("differ")))  # one row each
    strange = one.exceptAll(rows).agg(F.count("*").alias("strange"))
    every = rows.agg(F.count("*").alias("of")).crossJoin(drawn).crossJoin(strange)
    near = F.abs(F.col("n") - F.col("of") * 0.1) <= 5 * F.sqrt(F.col("of") * 0.09)
    return every.select("of", near.alias("near"), (F.col("differ") == 0).alias("repeats"), (F.col("strange") == 0).alias("inside"))


def _halves(t):
    a = t.orders.where("o_orderkey % 3 < 2").select("o_custkey", "o_orderstatus")
    b = t.orders.where("o_orderkey % 3 > 0").select("o_custkey", "o_orderstatus")
    return a, b


_A, _B = "SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2", "SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 > 0"
for _name, _f, _all, _sql in (("union_all", setops.union, True, "UNION ALL"), ("union_distinct", setops.union, False, "UNION"), ("intersect_distinct", setops.intersect, False, "INTERSECT"), ("intersect_all", setops.intersect, True, "INTERSECT ALL"), ("except_distinct", setops.except_, False, "EXCEPT"), ("except_all", setops.except_, True, "EXCEPT ALL")):
    query(f"({_A}) {_sql} ({_B})", name=_name)(lambda t, f=_f, a=_all: f(*_halves(t), a))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS rk FROM region")
def union_by_name(t):
    return setops.union(t.nation.selectExpr("n_nationkey AS k", "n_name AS name"), t.region.selectExpr("r_name AS name", "r_regionkey AS rk"), all_=True, by_name=True)


@query("SELECT n_name AS name FROM nation UNION BY NAME SELECT r_name AS name FROM region")
def union_by_name_distinct(t):
    return setops.union(t.nation.selectExpr("n_name AS name"), t.region.selectExpr("r_name AS name"), by_name=True)


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS row_number FROM orders")
def global_row_number(t):
    return joins.with_row_number(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_number")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(generate_series) AS BIGINT) AS s FROM generate_series(5, 1000, 5)")
def series_numbers(t):
    return reshape.series(t.spark, 5, 1000, 5).agg(F.count("*").alias("n"), F.sum("generate_series").alias("s"))


@query("SELECT CAST(generate_series AS DATE) AS generate_series FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 7 DAY)")
def series_dates(t):
    import datetime

    return reshape.series(t.spark, datetime.date(2024, 1, 1), datetime.date(2024, 3, 1), datetime.timedelta(days=7))


@query("SELECT range FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 90 MINUTE)")
def series_timestamps(t):
    import datetime

    return reshape.series(t.spark, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), datetime.timedelta(minutes=90), inclusive=False, name="range")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 2")
def qualify(t):
    from ..operators.windows import qualify as q

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return q(t.orders, F.row_number().over(w) == 2).select("o_orderkey")
