"""Pivots, nesting, recursion, changes to tables, text search, sources and user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fts, udf
from ..functions import nested
from ..operators import dml, recursive, reshape
from ..plans.materialize import shared_dir
from ..sources import readers, writers
from . import query, sql

c = F.col


@query("SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY o_orderpriority")
def pivot_counts(t):
    return reshape.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", {"n": "count(*)"}, ["F", "O", "P"])


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F_s, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F_n, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O_s, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O_n FROM orders GROUP BY o_orderpriority")
def pivot_two_aggregates(t):
    return reshape.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", {"s": lambda hit: F.round(F.sum(F.when(hit, c("o_totalprice"))), 2), "n": lambda hit: F.count_if(hit)}, ["F", "O"])


@query("SELECT n_nationkey, name, value FROM (SELECT n_nationkey, n_regionkey AS r, nullif(n_nationkey, 3) AS k FROM nation) UNPIVOT (value FOR name IN (r, k))")
def unpivot(t):
    return reshape.unpivot(t.nation.select("n_nationkey", c("n_regionkey").alias("r"), F.nullif("n_nationkey", F.lit(3)).alias("k")), ["n_nationkey"], ["r", "k"])


@query("SELECT n_nationkey, name, value FROM (SELECT n_nationkey, n_regionkey AS r, nullif(n_nationkey, 3) AS k FROM nation) UNPIVOT INCLUDE NULLS (value FOR name IN (r, k))")
def unpivot_include_nulls(t):
    return reshape.unpivot(t.nation.select("n_nationkey", c("n_regionkey").alias("r"), F.nullif("n_nationkey", F.lit(3)).alias("k")), ["n_nationkey"], ["r", "k"], include_nulls=True)


@query("SELECT vec_id, unnest(embedding[1:3]) AS unnest FROM embeddings")
def unnest(t):
    return reshape.unnest(t.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("e")), "e")


@query("SELECT n_nationkey, CAST(generate_subscripts(x, 1) AS INT) AS generate_subscripts FROM (SELECT n_nationkey, string_split(n_name, 'A') AS x FROM nation)")
def generate_subscripts(t):
    return reshape.subscripts(t.nation.select("n_nationkey", F.split("n_name", "A").alias("x")), "x").drop("x")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_each(t):
    return reshape.json_each(t.events.select("event_id", "props"), "props").drop("props")


@query("""SELECT * FROM (
SELECT 'o_orderkey' AS column_name, CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max, round(avg(o_orderkey), 4) AS avg, round(stddev_samp(o_orderkey), 4) AS std, CAST(count(*) AS BIGINT) AS count, 0.0 AS null_percentage FROM orders
UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), NULL, NULL, CAST(count(*) AS BIGINT), 0.0 FROM orders)""")
def summarize(t):
    out = reshape.summarize(t.orders.select("o_orderkey", "o_orderstatus"))
    return out.select("column_name", "min", "max", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), "count", c("null_percentage").cast("decimal(2,1)").alias("null_percentage"))


sql("recursive_union_all", "WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 50) SELECT n, total FROM r")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 50 AS a, (o_custkey * 7 + 3) % 50 AS b FROM orders), r AS (SELECT a, b FROM e WHERE a = 1 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def recursive_union_distinct(t):
    edges = t.orders.selectExpr("o_custkey % 50 AS a", "(o_custkey * 7 + 3) % 50 AS b").distinct()
    step = lambda r: r.select(c("a"), c("b").alias("k")).join(edges.select(c("a").alias("k"), "b"), "k").select("a", "b")
    return recursive.fixpoint(edges.where("a = 1"), step)


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 60 AS a, (o_custkey * 11 + 5) % 60 AS b FROM orders), r AS (SELECT CAST(2 AS BIGINT) AS b, 0 AS d UNION SELECT e.b, r.d + 1 FROM r JOIN e ON r.b = e.a WHERE r.d < 80) SELECT b, CAST(min(d) AS INT) AS d FROM r GROUP BY b")
def recursive_using_key(t):
    edges = t.orders.selectExpr("o_custkey % 60 AS a", "(o_custkey * 11 + 5) % 60 AS e").distinct()
    start = t.spark.sql("SELECT CAST(2 AS BIGINT) AS b, 0 AS d")
    step = lambda r: r.join(edges, c("b") == c("a")).select(c("e").alias("b"), (c("d") + 1).alias("d"))
    return recursive.fixpoint_by_key(start, step, ["b"], "d")


_SOURCE = "(SELECT n_nationkey AS k, 'new ' || n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 3)"


def _target_source(t):
    target = t.nation.selectExpr("n_nationkey AS k", "n_name AS name", "n_regionkey AS r")
    source = t.nation.where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS k", "concat('new ', n_name) AS name").unionAll(t.nation.where("n_nationkey < 3").selectExpr("n_nationkey + 100 AS k", "n_name AS name"))
    return target, source


@query(f"SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL THEN s.name WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN -1 WHEN t.k IS NULL THEN 9 ELSE t.r END AS r FROM (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation) t FULL JOIN {_SOURCE} s ON t.k = s.k WHERE NOT (t.k IS NOT NULL AND s.k IS NOT NULL AND t.k > 20)")
def merge_into(t):
    target, source = _target_source(t)
    return dml.merge(target, source, ["k"], [
        dml.When(True, "delete", c("target.k") > 20), dml.When(True, "update", set={"name": c("s.name")}),
        dml.When(False, "insert", set={"k": c("s.k"), "name": c("s.name"), "r": F.lit(9)}), dml.When("source", "update", set={"r": F.lit(-1)}),
    ])


@query(f"SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT k, name, NULL FROM {_SOURCE} WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def insert_or_ignore(t):
    return dml.insert_or_ignore(*_target_source(t), ["k"])


@query(f"SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey NOT IN (SELECT k FROM {_SOURCE}) UNION ALL SELECT k, name, NULL FROM {_SOURCE}")
def insert_or_replace(t):
    return dml.insert_or_replace(*_target_source(t), ["k"])


@query(f"SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN s.name WHEN s.k IS NULL OR t.k > 10 THEN t.name ELSE t.name || '/' || s.name END AS name, t.r FROM (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation) t FULL JOIN {_SOURCE} s ON t.k = s.k")
def insert_on_conflict_update(t):
    return dml.upsert(*_target_source(t), ["k"], {"name": F.concat(c("target.name"), F.lit("/"), c("excluded.name"))}, where=c("target.k") <= 10)


@query(f"SELECT n_nationkey AS k, coalesce(s.name, n_name) AS name, n_regionkey AS r FROM nation LEFT JOIN {_SOURCE} s ON s.k = n_nationkey")
def update_from(t):
    target, source = _target_source(t)
    return dml.update(target, {"name": c("s.name")}, source=source, on=c("t.k") == c("s.k"))


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'x' ELSE n_name END AS name, n_regionkey AS r FROM nation")
def update_where(t):
    return dml.update(_target_source(t)[0], {"name": F.lit("x")}, c("r") == 2)


@query(f"SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey NOT IN (SELECT k FROM {_SOURCE})")
def delete_using(t):
    target, source = _target_source(t)
    return dml.delete(target, using=source, on=c("t.k") == c("s.k"))


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE NOT coalesce(nullif(n_regionkey, 3) > 1, false)")
def delete_where(t):
    return dml.delete(_target_source(t)[0], F.nullif("r", F.lit(3)) > 1)


@query(f"SELECT k, name, r, 'insert' AS action FROM (SELECT k, name, NULL::INT AS r FROM {_SOURCE} WHERE k NOT IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT n_nationkey, coalesce(s.name, n_name), n_regionkey, 'update' FROM nation JOIN {_SOURCE} s ON s.k = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'delete' FROM nation WHERE n_regionkey > 2")
def returning(t):
    target, source = _target_source(t)
    fresh = dml.insert_returning(target, source, ["k"])
    changed = dml.update_returning(target, {"name": c("s.name")}, source=source, on=c("t.k") == c("s.k"), where=c("t.r") == 1)
    gone = dml.delete_returning(target, c("r") > 2)
    return fresh.withColumn("action", F.lit("insert")).unionAll(changed.withColumn("action", F.lit("update"))).unionAll(gone.withColumn("action", F.lit("delete")))


@query("SELECT n_nationkey AS k, 'N' || n_nationkey AS label, n_nationkey * 2 AS twice, 'new' AS state FROM nation")
def table_defaults(t):
    rows = t.nation.selectExpr("n_nationkey AS k")
    made = dml.with_defaults(rows, "k int, label string, twice int, state string", defaults={"state": F.lit("new")}, generated={"twice": c("k") * 2, "label": F.concat(F.lit("N"), c("k").cast("string"))})
    return made.select("k", "label", "twice", "state")


@query("SELECT 'check positive' AS \"constraint\", CAST(count(*) AS BIGINT) AS n FROM nation WHERE NOT (n_regionkey > 0)")
def constraint_check(t):
    return dml.violations(t.nation, ["n_nationkey"], {"positive": c("n_regionkey") > 0}, ["n_name"], [(["n_regionkey"], t.region, ["r_regionkey"])])


_STOP = ", ".join(f"'{w}'" for w in fts.STOP_WORDS)


_SEARCH = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS size, len(list_filter(ws, lambda x: x = 'ing')) AS a, len(list_filter(ws, lambda x: x = 'tion')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM d)
SELECT doc_id AS key, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM d, s WHERE a > 0 OR b > 0"""
_INDEXES: dict[tuple, fts.Index] = {}


@query(_SEARCH)
def full_text_search(t):
    """Over an index that is built once for a session and folder."""
    at = (t.spark.sparkContext.applicationId, t.folder)
    if at not in _INDEXES:
        _INDEXES[at] = fts.Index.create(t.documents, "doc_id", "text", uuid.uuid4().hex)
    return _INDEXES[at].search("the ing of tion").withColumn("score", F.round("score", 6))


@query(_SEARCH)
def full_text_scan(t):
    return fts.search(t.documents, "doc_id", "text", "the ing of tion").withColumn("score", F.round("score", 6))


def _round_trip(t, df, format, read, **options):
    path = f"{shared_dir(t.spark).rstrip('/')}/copy-{uuid.uuid4().hex}.{format}"
    writers.copy_to(df, path, **options)
    return read(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_csv(t):
    d = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return _round_trip(t, d, "csv", lambda p: readers.read_csv(t.spark, p, delim="|", columns="n_nationkey int, n_name string, n_regionkey int"), delimiter="|")


@query("SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation")
def copy_csv_auto(t):
    return _round_trip(t, t.nation.select("n_nationkey", "n_name"), "csv", lambda p: readers.read_csv_auto(t.spark, p), delimiter=";", compression="gzip")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def copy_json(t):
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return _round_trip(t, d, "json", lambda p: readers.read_json(t.spark, p, columns="o_orderkey long, o_orderstatus string, o_totalprice double"))


@query("SELECT r_regionkey, r_name FROM region")
def copy_json_array(t):
    return _round_trip(t, t.region, "json", lambda p: readers.read_json(t.spark, p, columns="r_regionkey int, r_name string"), array=True)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def copy_parquet_partitioned(t):
    d = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _round_trip(t, d, "parquet", lambda p: readers.read_parquet(t.spark, p).where("o_orderstatus <> 'P'"), partition_by=["o_orderstatus"], compression="zstd")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def copy_arrow(t):
    return _round_trip(t, t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "arrow", lambda p: readers.read_arrow(t.spark, p))


@query("SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
def copy_xlsx(t):
    from ..sources.xlsx import read_xlsx

    return _round_trip(t, t.region, "xlsx", lambda p: read_xlsx(t.spark, p))


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS y, 'N:' || n_name AS z FROM nation")
def scalar_user_function(t):
    functions = udf.Functions(t.spark)
    functions.scalar("twice_plus", lambda x: x * 2 + 1, "int", ["int"])
    functions.scalar("twice_plus", lambda s: f"N:{s}", "string", ["string"])
    return t.nation.select("n_nationkey", functions.call("twice_plus", t.nation, "n_nationkey").alias("y"), functions.call("twice_plus", t.nation, "n_name").alias("z"))


@query("SELECT range AS i, range * range AS sq FROM range(0, 20)")
def table_user_function(t):
    return udf.table_function(t.spark, "squares", lambda n: ((k, k * k) for k in range(n)), "i bigint, sq bigint")(20)


@query("SELECT range AS i FROM range(0, 40)")
def parallel_table_function(t):
    return udf.parallel_table_function(t.spark, 4, lambda k: ((k * 10 + j,) for j in range(10)), "i bigint")


@query("SELECT n_nationkey, n_nationkey * 3 + 2 AS m FROM nation WHERE n_nationkey < 7")
def macros(t):
    udf.scalar_macro(t.spark, "triple_plus", "x INT, y INT DEFAULT 2", "INT", "x * 3 + y")
    t.nation.createOrReplaceTempView("macro_nation")
    return t.spark.sql("SELECT n_nationkey, triple_plus(n_nationkey) AS m FROM macro_nation WHERE n_nationkey < 7")


@query("SELECT vec_id, round(CAST(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)) AS DOUBLE), 4) AS s FROM embeddings")
def vector_similarity(t):
    base = t.embeddings.where("vec_id = 0").select(c("embedding").alias("q"))  # one row
    d = t.embeddings.crossJoin(F.broadcast(base))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return d.select("vec_id", F.round(dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q")), 4).alias("s"))


@query("SELECT n_nationkey, key, value FROM (SELECT n_nationkey, unnest([{'key': '0', 'value': '' || n_regionkey}, {'key': '1', 'value': '\"x\"'}, {'key': '2', 'value': '[1]'}], recursive := true) FROM nation) UNION ALL SELECT 100 + n_nationkey, 'a', '' || n_nationkey FROM nation")
def json_each(t):
    d = t.nation.select("n_nationkey", F.concat(F.lit("["), c("n_regionkey").cast("string"), F.lit(',"x",[1]]')).alias("j"))
    d = d.unionAll(t.nation.select(c("n_nationkey") + 100, F.concat(F.lit('{"a":'), c("n_nationkey").cast("string"), F.lit("}"))))
    return reshape.json_each(d, "j").select("n_nationkey", "key", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 0 AS k FROM events WHERE json_valid(props)")
def variant_access(t):
    return t.events.where(nested.json_valid(c("props"))).select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
