"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from . import query, sql

sql("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sql("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_totalprice > 200000")
sql("join_full", "SELECT s_suppkey, n_nationkey FROM (SELECT * FROM {supplier} WHERE s_acctbal > 3000) s FULL JOIN {nation} ON s_nationkey = n_nationkey AND n_nationkey < 15")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
sql("join_residual", "SELECT o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice < o_totalprice / 3")
sql("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
sql("join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000")
sql("join_using", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM {nation}) JOIN (SELECT s_nationkey AS k, s_suppkey AS y FROM {supplier}) USING (k)", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) JOIN (SELECT s_nationkey AS k, s_suppkey AS y FROM supplier) USING (k)")
sql("join_composite_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
sql("lateral_join", "SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x")
sql("left_lateral_join", "SELECT c_custkey, x.best FROM {customer} LEFT JOIN LATERAL (SELECT max(o_totalprice) AS best FROM {orders} WHERE o_custkey = c_custkey) x ON true")
sql("q3_shipping_priority", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer}, {orders}, {lineitem} WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP_NTZ '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
sql("q5_local_supplier", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer}, {orders}, {lineitem}, {supplier}, {nation}, {region} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")
sql("q10_returned_items", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM {customer}, {orders}, {lineitem}, {nation} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
sql("q12_priority_counts", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS n FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY l_linestatus")
sql("q18_large_orders", "SELECT c_custkey, o_orderkey, round(sum(l_quantity), 2) AS qty FROM {customer}, {orders}, {lineitem} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 150) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_custkey, o_orderkey")


@query("SELECT * FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier)")
def join_natural(t):
    return joins.natural_join(t.nation.selectExpr("n_nationkey AS k", "n_name AS name"), t.supplier.selectExpr("s_nationkey AS k", "s_suppkey"))


@query("SELECT k, name, s_suppkey FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) NATURAL FULL JOIN (SELECT s_nationkey + 3 AS k, s_suppkey FROM supplier)")
def join_natural_full(t):
    return joins.natural_join(t.nation.selectExpr("n_nationkey AS k", "n_name AS name"), t.supplier.selectExpr("s_nationkey + 3 AS k", "s_suppkey"), "full")


@query("SELECT p_partkey, low FROM part JOIN (SELECT s_suppkey AS id, s_acctbal / 10 AS low, s_acctbal / 10 + 25 AS high FROM supplier) ON p_retailprice BETWEEN low AND high")
def join_band(t):
    bands = t.supplier.selectExpr("s_suppkey AS id", "s_acctbal / 10 AS low", "s_acctbal / 10 + 25 AS high")
    return joins.band_join(t.part, bands, "p_retailprice", "low", "high", 25).select("p_partkey", "low")


_ASOF = "FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ASOF {kind} JOIN (SELECT user_id, ts AS view_ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts {op} v.view_ts"


def _asof(t, **options):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return joins.asof_join(left, right, "ts", "view_ts", ["user_id"], tie=["view_id"], **options).select("event_id", "view_id", "view_ts")


query("SELECT event_id, view_id, view_ts " + _ASOF.format(kind="", op=">="), name="join_asof")(lambda t: _asof(t))
query("SELECT event_id, view_id, view_ts " + _ASOF.format(kind="LEFT", op=">="), name="join_asof_left")(lambda t: _asof(t, how="left"))
query("SELECT event_id, view_id, view_ts " + _ASOF.format(kind="LEFT", op=">"), name="join_asof_strict")(lambda t: _asof(t, how="left", strict=True))
query("SELECT event_id, view_id, view_ts " + _ASOF.format(kind="LEFT", op=">="), name="join_asof_bucketed")(lambda t: _asof(t, how="left", bucket_seconds=86_400))


@query("SELECT a.n_name, b.s_suppkey FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) a FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) b ON a.r = b.r")
def join_positional(t):
    return joins.positional_join(t.nation.select("n_nationkey", "n_name"), t.supplier.select("s_suppkey"), ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_suppkey")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_salted(t):
    return joins.salted_join(t.lineitem, t.part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"], 8).select("l_orderkey", "l_linenumber", "p_brand")
