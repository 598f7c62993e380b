"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import windows
from . import query, sql

_RANKS = "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS d, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
sql("window_ranking", _RANKS)
sql("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lag(o_totalprice, 2, 0.0) OVER w AS b, lead(o_orderkey, 1) OVER w AS c FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("window_lag_ignore_nulls", "SELECT o_orderkey, lag(nullif(o_orderstatus, 'F')) IGNORE NULLS OVER w AS a FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "SELECT o_orderkey, lag(nullif(o_orderstatus, 'F') IGNORE NULLS) OVER w AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("window_aggregates", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, CAST(count(*) OVER w AS BIGINT) AS c, round(avg(o_totalprice) OVER w, 6) AS a, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("window_statistics", "SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER w, 2) AS s, round(median(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS m FROM {orders} WINDOW w AS (PARTITION BY o_custkey)")
sql("window_whole_partition", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM {orders}")
sql("window_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM {orders}")
sql("window_range_frame", "SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 2) AS s FROM {lineitem}")
sql("window_range_interval", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM {events}")
sql("window_filter", "SELECT o_orderkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey), 2) AS s FROM {orders}",
    "SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 2) AS s FROM orders")


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM lineitem")
def window_groups_frame(t):
    out = windows.groups_between(t.lineitem, ["l_suppkey"], ["l_shipdate"], -1, 1, s=lambda w: F.round(F.sum("l_quantity").over(w), 2))
    return out.select("l_orderkey", "l_linenumber", "s")


_FIRST, _LAST = W.unboundedPreceding, W.unboundedFollowing
_FRAMES = {
    "range_running": ("RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", ("range", _FIRST, 0), "l_shipdate"),
    "range_before": ("RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING", ("range", -2, -1), "l_quantity"),
    "range_around": ("RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING", ("range", -3, 2), "l_linenumber"),
    "rows_running": ("ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", ("rows", _FIRST, _LAST), "l_shipdate"),
    "groups_around": ("GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING", ("groups", -1, 2), "l_shipdate"),
    "groups_after": ("GROUPS BETWEEN 1 FOLLOWING AND 3 FOLLOWING", ("groups", 1, 3), "l_shipdate"),
}
for _frame, (_text, _of, _order) in _FRAMES.items():
    for _what in ("current row", "group", "ties"):
        query(
            f"SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 2) AS s, CAST(count(l_quantity) OVER w AS BIGINT) AS c, round(avg(l_quantity) OVER w, 10) AS a, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_order} {_text} EXCLUDE {_what.upper()})",
            name=f"window_exclude_{_frame}_{_what.replace(' ', '_')}",
        )(
            lambda t, what=_what, frame=_of, order=_order: windows.excluding(t.lineitem, ["l_suppkey"], order, what, frame, s=("sum", "l_quantity"), c=("count", "l_quantity"), a=("avg", "l_quantity"), lo=("min", "l_extendedprice"), hi=("max", "l_extendedprice")).select(
                "l_orderkey", "l_linenumber", F.round("s", 2).alias("s"), "c", F.round("a", 10).alias("a"), "lo", "hi"
            )
        )


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP), 2) AS g FROM orders")
def window_exclude_rows(t):
    frame = ("rows", -2, 2)
    out = windows.excluding(t.orders, ["o_custkey"], "o_orderkey", "current row", frame, m=("max", "o_totalprice"))
    return windows.excluding(out, ["o_custkey"], "o_orderkey", "group", frame, g=("sum", "o_totalprice")).select("o_orderkey", "m", F.round("g", 2).alias("g"))


@query("SELECT o_orderkey, CAST(count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS BIGINT) AS c, round(CAST(sum(DISTINCT o_orderkey % 5) OVER (PARTITION BY o_custkey) AS DOUBLE), 2) AS s FROM orders")
def window_distinct(t):
    return windows.distinct_running(t.orders, ["o_custkey"], c=("count", F.col("o_orderstatus")), s=("sum", F.col("o_orderkey") % 5)).select("o_orderkey", "c", F.round("s", 2).alias("s"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(DISTINCT l_quantity) OVER w AS BIGINT) AS c, round(avg(DISTINCT l_quantity) OVER w, 6) AS a FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate)")
def window_distinct_running(t):
    return windows.distinct_running(t.lineitem, ["l_suppkey"], ["l_shipdate"], c=("count", F.col("l_quantity")), a=("avg", F.col("l_quantity"))).select("l_orderkey", "l_linenumber", "c", F.round("a", 6).alias("a"))


@query("SELECT o_orderkey, CAST(count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS c FROM orders")
def window_distinct_rows(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-3, 0)
    return t.orders.select("o_orderkey", windows.distinct_over("count", F.col("o_orderstatus"), w).alias("c"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def event_windows_tumbling(t):
    from ..streaming.windows import windowed

    out = windowed(t.events, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "v")


@query("SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def event_windows_sessions(t):
    from ..streaming.windows import sessions

    out = sessions(t.events, "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")
