"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from . import query, sql

sql("agg_basics", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(l_linestatus, 'F')) AS BIGINT) AS k, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS d, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_tax) AS hi FROM {lineitem} GROUP BY l_returnflag")
sql("agg_empty_input", "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM {orders} WHERE o_orderkey < 0")
sql("agg_distinct_sum_avg", "SELECT l_returnflag, round(sum(DISTINCT l_quantity), 2) AS s, round(avg(DISTINCT l_discount), 6) AS a FROM {lineitem} GROUP BY l_returnflag")
sql("agg_filter_clause", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM {orders} GROUP BY o_orderpriority")
sql("agg_median_quantile", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m, round(percentile(l_extendedprice, 0.9), 4) AS q, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_tax), 6) AS pc, percentile_disc(0.75) WITHIN GROUP (ORDER BY l_quantity) AS pd FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m, round(quantile_cont(l_extendedprice, 0.9), 4) AS q, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_tax), 6) AS pc, percentile_disc(0.75) WITHIN GROUP (ORDER BY l_quantity) AS pd FROM lineitem GROUP BY l_returnflag")
sql("agg_quantile_list", "SELECT l_returnflag, transform(percentile(l_extendedprice, array(0.1, 0.5, 0.9)), x -> round(x, 4)) AS q FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, list_transform(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]), lambda x: round(x, 4)) AS q FROM lineitem GROUP BY l_returnflag")
sql("agg_variance", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_tax), 8) AS sp, round(stddev_samp(l_tax), 8) AS ss FROM {lineitem} GROUP BY l_returnflag")
sql("agg_conditional", "SELECT l_linestatus, CAST(count_if(l_quantity > 25) AS BIGINT) AS c FROM {lineitem} GROUP BY l_linestatus")
sql("agg_correlation", "SELECT l_returnflag, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs, round(corr(l_extendedprice, l_quantity), 8) AS c FROM {lineitem} GROUP BY l_returnflag")
sql("agg_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy FROM {lineitem} GROUP BY l_returnflag")
sql("agg_boolean", "SELECT o_custkey, bool_and(o_totalprice > 5000) AS a, bool_or(o_orderstatus = 'P') AS o, every(o_orderkey > 0) AS e FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 5000) AS a, bool_or(o_orderstatus = 'P') AS o, bool_and(o_orderkey > 0) AS e FROM orders GROUP BY o_custkey")
sql("agg_bits", "SELECT l_suppkey, bit_and(l_orderkey) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x FROM {lineitem} GROUP BY l_suppkey")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping_id() AS BIGINT) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_group_by_all", "SELECT o_orderstatus, year(o_orderdate) % 2 AS odd, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY ALL", "SELECT o_orderstatus, CAST(year(o_orderdate) % 2 AS INT) AS odd, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
sql("agg_expression_sets", "SELECT o_orderkey % 3 AS k, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY ROLLUP (o_orderkey % 3)")
sql("agg_string_agg", "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")


@query("SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS s, round(kurtosis(l_extendedprice), 6) AS k FROM lineitem GROUP BY l_returnflag")
def agg_skewness_kurtosis(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.skewness("l_extendedprice"), 6).alias("s"), F.round(A.kurtosis("l_extendedprice"), 6).alias("k"))


@query("SELECT o_custkey, min_by(o_orderkey, o_totalprice) AS lo, max_by(o_orderkey, o_totalprice) AS hi FROM orders GROUP BY o_custkey")
def agg_arg_min_max(t):
    """Of equal prices the first order, as the SQL finds it in a table in order of its keys."""
    return t.orders.groupBy("o_custkey").agg(A.arg_min("o_orderkey", "o_totalprice", "o_orderkey").alias("lo"), A.arg_max("o_orderkey", "o_totalprice", "o_orderkey").alias("hi"))


@query("SELECT l_returnflag, round(entropy(l_suppkey), 6) AS entropy FROM lineitem GROUP BY l_returnflag")
def agg_entropy(t):
    return A.entropy_table(t.lineitem, ["l_returnflag"], "l_suppkey").withColumn("entropy", F.round("entropy", 6))


@query("SELECT l_returnflag, round(mad(l_quantity), 6) AS mad FROM lineitem GROUP BY l_returnflag")
def agg_mad(t):
    return A.mad_table(t.lineitem, ["l_returnflag"], "l_quantity").withColumn("mad", F.round("mad", 6))


@query("SELECT n, mode FROM (SELECT o_custkey % 5 AS n, o_orderpriority AS mode, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def agg_mode(t):
    return A.mode_table(t.orders.withColumn("n", F.col("o_custkey") % 5), ["n"], "o_orderpriority")


@query("SELECT l_returnflag, l_linestatus, CAST(histogram(l_linenumber) AS MAP(INTEGER, BIGINT)) AS histogram FROM lineitem GROUP BY ALL")
def agg_histogram(t):
    return A.histogram_table(t.lineitem, ["l_returnflag", "l_linestatus"], "l_linenumber")


@query("SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS w, round(sum(CASE WHEN l_tax > 0.04 THEN l_quantity END), 2) AS s, round(avg(CASE WHEN l_tax > 0.04 THEN l_quantity END), 6) AS a, min(CASE WHEN l_tax > 0.04 THEN l_quantity END) AS lo, max(CASE WHEN l_tax > 0.04 THEN l_quantity END) AS hi FROM lineitem GROUP BY l_returnflag")
def agg_means_and_conditions(t):
    c = F.col("l_tax") > 0.04
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(A.geometric_mean("l_quantity"), 6).alias("g"), F.round(A.weighted_avg("l_discount", "l_quantity"), 6).alias("w"),
        F.round(A.sum_if("l_quantity", c), 2).alias("s"), F.round(A.avg_if("l_quantity", c), 6).alias("a"), A.min_if("l_quantity", c).alias("lo"), A.max_if("l_quantity", c).alias("hi"),
    )


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, list(nullif(n_nationkey, 3) ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def agg_list(t):
    d = t.nation.withColumn("k", F.nullif("n_nationkey", F.lit(3)))
    return d.groupBy("n_regionkey").agg(A.list_agg("n_name", ["n_nationkey"]).alias("names"), A.list_agg("k", ["n_nationkey"]).alias("keys"))


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY o_orderstatus")
def agg_list_distinct(t):
    return t.orders.groupBy("o_orderstatus").agg(A.list_distinct_agg("o_orderpriority").alias("p"))


@query("SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l, any_value(nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey")
def agg_first_last_any(t):
    d = t.orders.select("o_custkey", "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("st"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return d.groupBy("o_custkey").agg(A.first_value_by("o_orderkey", "at").alias("f"), A.last_value_by("o_orderkey", "at").alias("l"), A.any_value("st", "o_orderkey").alias("a"))


@query("SELECT n_regionkey, round(product(n_nationkey + 1.0), 0) AS p FROM nation GROUP BY n_regionkey")
def agg_product(t):
    return t.nation.withColumn("x", F.col("n_nationkey") + 1.0).groupBy("n_regionkey").agg(F.round(F.product("x"), 0).alias("p"))


@query("SELECT l_returnflag, round(CAST(sum(l_tax::DECIMAL(18,4)) AS DOUBLE), 6) AS s, round(CAST(sum(l_tax::DECIMAL(18,4)) AS DOUBLE) / count(l_tax), 9) AS a FROM lineitem GROUP BY l_returnflag")
def agg_exact_sums(t):
    """Sums that plain addition of doubles gets wrong in the last digits: large values that cancel are added to each group."""
    d = t.lineitem.select("l_returnflag", F.col("l_tax").alias("x"))
    flags = d.select("l_returnflag").distinct()
    odd = flags.withColumn("x", F.explode(F.array(F.lit(1e16), F.lit(-1e16))))
    sums = A.exact_sum_table(d.unionAll(odd), ["l_returnflag"], "x", "s")
    return sums.join(A.exact_sum_table(d, ["l_returnflag"], "x", "a", mean=True), "l_returnflag").select("l_returnflag", F.round("s", 6).alias("s"), F.round("a", 9).alias("a"))


@query("SELECT n_regionkey, CAST(bitstring_agg(n_nationkey, 0, 24) AS VARCHAR) AS b FROM nation GROUP BY n_regionkey")
def agg_bitstring(t):
    return t.nation.groupBy("n_regionkey").agg(A.bitstring_agg("n_nationkey", 0, 24).alias("b"))


@query("SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def agg_json(t):
    return t.nation.groupBy("n_regionkey").agg(A.json_group_array("n_name", ["n_nationkey"]).alias("a"), A.json_group_object("n_name", "n_nationkey").alias("o"))


@query("SELECT l_returnflag, true AS parts, true AS median, true AS tails FROM lineitem GROUP BY l_returnflag")
def agg_approximate(t):
    """Whether each estimate is within its bound of the exact value: 15 percent of the count, one percent of the rows for quantiles."""
    d = t.lineitem
    made = d.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5, 10_000).alias("median"), F.percentile_approx("l_extendedprice", [0.1, 0.9], 10_000).alias("tails"))
    named = d.join(made, "l_returnflag")
    share = lambda column, bound: F.avg((F.col(column) <= bound).cast("double"))
    below = lambda column, bound: F.avg((F.col(column) < bound).cast("double"))
    between = lambda column, bound, q: (below(column, bound) <= q + 0.01) & (share(column, bound) >= q - 0.01)
    return named.groupBy("l_returnflag").agg(
        (F.abs(F.first("parts") / F.count_distinct("l_partkey") - 1) < 0.15).alias("parts"),
        between("l_quantity", F.col("median"), 0.5).alias("median"),
        (between("l_extendedprice", F.col("tails")[0], 0.1) & between("l_extendedprice", F.col("tails")[1], 0.9)).alias("tails"),
    )


@query("SELECT abs(x - 1) < 0.1 AS close FROM (SELECT 1.0 AS x)")
def agg_approx_error(t):
    return t.lineitem.agg((F.abs(F.approx_count_distinct("l_orderkey", 0.02) / F.count_distinct("l_orderkey") - 1) < 0.1).alias("close"))


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey")
def agg_salted(t):
    return A.salted_agg(t.lineitem, ["l_suppkey"], {"q": F.sum("l_quantity")}).withColumn("q", F.round("q", 2))


@query("SELECT o_custkey, round(sqrt(sum(o_totalprice * o_totalprice)), 2) AS norm, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def agg_user_defined(t):
    from ..udf import mergeable_aggregate

    out = mergeable_aggregate(t.orders, ["o_custkey"], "o_totalprice", lambda: [0.0, 0.0], lambda s, x: [s[0] + x * x, s[1] + 1], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: [float(s[0] ** 0.5), s[1]], "array<double>", "array<double>")
    return out.select("o_custkey", F.round(F.col("value")[0], 2).alias("norm"), F.col("value")[1].cast("long").alias("n"))
