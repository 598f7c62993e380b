"""Behaviour that the registered queries don't reach."""

import collections
import datetime
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeloom import fts
from lakeloom.functions import geo, nested, numeric, registry, strings, temporal
from lakeloom.operators import aggregates, dml, joins, recursive, reshape, sorting, windows
from lakeloom.plans import catalog, materialize, system
from lakeloom.sources import readers, writers


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_asof_keeps_null_keys_and_times_unmatched(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (None, 5), (2, None)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (None, 1, "n"), (2, 1, "c")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, "t", "u", ["k"], how="left").collect()}
    assert got == {(1, 5): "b", (1, 1): None, (None, 5): None, (2, None): None}
    assert joins.asof_join(left, right, "t", "u", ["k"], strict=True).collect()[0].v == "a"


def test_asof_in_buckets_equals_asof(spark):
    t0 = datetime.datetime(2024, 1, 1)
    left = spark.createDataFrame([(k % 3, t0 + datetime.timedelta(minutes=37 * k)) for k in range(60)], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(k % 3, t0 + datetime.timedelta(minutes=91 * k), k) for k in range(12)], "k int, u timestamp_ntz, v int")
    plain = joins.asof_join(left, right, "t", "u", ["k"], how="left").collect()
    assert sorted(map(str, plain)) == sorted(map(str, joins.asof_join(left, right, "t", "u", ["k"], how="left", bucket_seconds=3600).collect()))


def test_positional_join_pads(spark):
    a, b = spark.range(5).toDF("x"), spark.range(3).toDF("y")
    assert sorted(((r.x, r.y) for r in joins.positional_join(a, b, ["x"], ["y"]).collect()), key=str) == sorted([(0, 0), (1, 1), (2, 2), (3, None), (4, None)], key=str)


@pytest.mark.parametrize("how,want", [("left", 3), ("left_semi", 1), ("left_anti", 2)])
def test_band_join_kinds(spark, how, want):
    left = spark.createDataFrame([(1.0,), (7.5,), (99.0,)], "v double")
    right = spark.createDataFrame([(5.0, 9.0), (200.0, 300.0)], "lo double, hi double")
    assert joins.band_join(left, right, "v", "lo", "hi", 2.0, how).count() == want


def test_quantified_with_nulls(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    other = spark.createDataFrame([(3,), (None,)], "y int")
    got = [tuple(r) for r in df.select(joins.compare_any(df, F.col("x"), ">", other, "y"), joins.compare_all(df, F.col("x"), ">", other, "y")).collect()]
    assert got == [(None, False), (True, None)]
    empty = other.limit(0)
    assert tuple(df.select(joins.compare_any(df, F.col("x"), ">", empty, "y"), joins.compare_all(df, F.col("x"), ">", empty, "y")).first()) == (False, True)


def test_recursion_ends_on_cycles_and_at_the_limit(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    step = lambda r: r.select(F.col("a"), F.col("b").alias("k")).join(edges.toDF("k", "b"), "k").select("a", "b")
    assert recursive.fixpoint(edges.where("a = 1"), step).count() == 3
    with pytest.raises(RecursionError):
        recursive.fixpoint(spark.range(1).toDF("n"), lambda r: r.select((F.col("n") + 1).alias("n")), limit=3)


def test_merge_do_nothing_and_conditions(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (3, "z"), (4, "w")], "k int, v string")
    out = dml.merge(target, source, ["k"], [dml.When(True, "nothing"), dml.When(False, "insert", F.col("s.k") == 3)])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b"), (3, "z")]


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5), (1, -1), (2, None)], "k int, v int")
    found = {r["constraint"]: r.n for r in dml.violations(df, ["k"], {"positive": F.col("v") > 0}, ["v"]).collect()}
    assert found == {"primary key": 1, "not null v": 1, "check positive": 1}


def test_with_ties_and_reservoir(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "x int")
    assert sorting.with_ties(df, 2, ["x"]).count() == 4
    assert sorting.reservoir(df, 2).count() == 2


def test_list_and_json_aggregates_keep_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, v string")
    r = df.agg(aggregates.list_agg("v", ["i"]).alias("l"), aggregates.json_group_array("v", ["i"]).alias("j"), aggregates.string_agg("v", "-", "i").alias("s")).first()
    assert r.l == ["a", None] and r.j == '["a",null]' and r.s == "a"
    assert df.where("i > 9").agg(aggregates.list_agg("v").alias("l")).first().l is None


def test_string_edge_cases(spark):
    r = one(spark, strings.left(F.lit("hello"), -2), strings.regexp_replace(F.lit("aXbX"), "X", "-"), strings.similar_to(F.lit("a.c"), "a.%"), strings.similar_to(F.lit("abc"), "a.c"), strings.jaro_similarity(F.lit(""), F.lit("")), strings.hamming(F.lit("ab"), F.lit("abc")))
    assert tuple(r) == ("hel", "a-bX", True, False, 1.0, None)


def test_age_and_date_sub(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    r = one(spark, temporal.age(t("2024-03-31"), t("2024-02-28")), temporal.date_sub("month", t("2024-01-31"), t("2024-02-29")), temporal.time_bucket(t("2024-05-17"), width_months=3))
    assert (r.c0.months, r.c0.days) == (1, 3) and r.c1 == 1 and r.c2 == datetime.datetime(2024, 4, 1)


def test_geometry():
    square, inner, line = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "LINESTRING (-1 2, 5 2)"
    assert geo.contains(square, inner) and geo.within(inner, square) and not geo.contains(inner, square)
    assert geo.crosses(line, square) and geo.touches("POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", square) and geo.disjoint(inner, "POINT (9 9)")
    assert geo.overlaps(square, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))") and geo.area(geo.intersection(square, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))")) == 4
    assert geo.length(line) == 6 and geo.distance(square, "POINT (7 8)") == 5 and geo.envelope(line).startswith("POLYGON ((-1 2")
    assert geo.from_wkb(geo.to_wkb(square)) == square and geo.equals(square, "POLYGON ((4 0, 4 4, 0 4, 0 0, 4 0))")
    assert abs(geo.area(geo.buffer("POINT (0 0)", 1.0)) - 3.12) < 0.02 and geo.area(geo.union(square, inner)) == 16


def test_registry_resolves_aliases(spark):
    assert registry.function("list_append") is F.array_append and registry.function("EVEN")(F.lit(2.1)) is not None
    with pytest.raises(KeyError):
        registry.function("no_such_function")
    registry.register(spark)
    assert tuple(spark.sql("SELECT even(2.1), isodow(TIMESTAMP_NTZ'2024-01-07 00:00:00'), jaro_similarity('ab', 'ab'), json_valid('{')").first()) == (4.0, 7, 1.0, False)


def test_csv_options_and_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nx;y\n1;one\n2;\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), delim=";", skip=1).collect()] == [("1", "one"), ("2", None)]
    (tmp_path / "b.csv").write_text('p|q\n1|"a|b"\n')
    assert readers.scan_path(spark, str(tmp_path / "b.csv")).first().q == "a|b"
    assert len(readers.glob(spark, f"{tmp_path}/*.csv")) == 2 and readers.glob(spark, f"{tmp_path}/*.nope", empty="allow") == []
    with pytest.raises(FileNotFoundError):
        readers.glob(spark, f"{tmp_path}/*.nope")
    writers.copy_to(spark.range(3), f"{tmp_path}/t.parquet")
    assert readers.read_parquet(spark, f"{tmp_path}/t.parquet", filename=True, file_row_number=True, file_index=True).select("file_index").distinct().count() >= 1


def test_export_and_import(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("exported")
    writers.export_database(spark, str(tmp_path / "db"), ["exported"])
    spark.catalog.dropTempView("exported")
    assert writers.import_database(spark, str(tmp_path / "db")) == ["exported"] and spark.table("exported").count() == 3


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("seen")
    assert catalog.tables(spark).where("table_name = 'seen'").count() == 1 and catalog.columns(spark).where("table_name = 'seen'").first().data_type == "bigint"
    s = catalog.Sequence_(10, 5)
    assert (s.nextval(), s.nextval(), s.currval()) == (10, 15, 15)
    assert [r.n for r in s.number(spark.range(2), ["id"], "n").orderBy("id").collect()] == [20, 25] and s.nextval() == 30
    p = catalog.Prepared(spark)
    p.prepare("q", "SELECT ? + 1 AS x")
    assert p.execute("q", 4).first().x == 5
    mood = catalog.Enumeration("sad", "ok", "happy")
    df = spark.createDataFrame([("happy",), ("sad",)], "m string")
    assert df.orderBy(mood.order(F.col("m"))).first().m == "sad" and mood.range() == ["sad", "ok", "happy"]
    assert "Range" in catalog.explain(spark.range(2)) and reshape.describe(spark.range(1)).first().column_name == "id"


def test_scan_prunes_and_pushes_down(spark):
    plan = catalog.explain(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 49").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_asof_plan_has_one_shuffle_and_no_join(spark):
    left = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("u"))
    plan = catalog.explain(joins.asof_join(left, right, "t", "u", ["k"]), "simple")
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_streaming_windows(spark, tmp_path):
    from lakeloom.streaming.windows import windowed

    spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id AS int)) AS ts, id FROM range(90)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, id long").parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "30 minutes", [], [F.count("*").alias("n")], late="10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counted").collect()) == [30, 30, 30]


def test_union_type(spark):
    r = one(spark, nested.union_value("num", F.lit(3), {"num": "int", "str": "string"}))
    assert (r.c0.tag, r.c0.num, r.c0.str) == ("num", 3, None)


def test_overlays_of_polygons():
    rng = random.Random(3)

    def star(n):
        x, y = rng.randint(0, 6), rng.randint(0, 6)
        points = [(x + rng.randint(1, 5) * math.cos(6.283 * (k + 0.4 * rng.random()) / n), y + rng.randint(1, 5) * math.sin(6.283 * (k + 0.4 * rng.random()) / n)) for k in range(n)]
        turns = [geo._side(points[k - 2], points[k - 1], points[k]) for k in range(n)]
        return geo.text("POLYGON", [points + points[:1]]) if min(turns) > 0 else star(n)  # convex, so surely simple

    def box(x, y, w, h):
        return f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"

    for k in range(80):
        a, b = (star(rng.randint(4, 6)), star(rng.randint(4, 6))) if k % 2 else (box(*(rng.randint(1, 4) for _ in range(4))), box(*(rng.randint(1, 4) for _ in range(4))))
        for c in (a, geo.difference(a, b) if geo.area(geo.difference(a, b)) else a):  # also with holes and parts
            union, both, rest = geo.union(c, b), geo.intersection(c, b), geo.difference(c, b)
            assert abs(geo.area(union) - geo.area(c) - geo.area(b) + geo.area(both)) < 1e-9 and abs(geo.area(rest) - geo.area(c) + geo.area(both)) < 1e-9
    assert geo.union(box(0, 0, 1, 1), box(5, 0, 1, 1)) == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 0, 6 0, 6 1, 5 1, 5 0)))"
    assert geo.difference(box(0, 0, 4, 4), box(1, 1, 2, 2)) == "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"
    assert geo.difference(box(0, 0, 1, 1), box(0, 0, 2, 2)) == "POLYGON EMPTY" and geo.union(box(0, 0, 1, 1), box(1, 0, 1, 1)) == "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))"
    assert abs(geo.area(geo.buffer(box(0, 0, 4, 4), 1.0)) - 32 - math.pi) < 0.05 and abs(geo.area(geo.buffer("LINESTRING (0 0, 4 0, 4 4)", 1.0)) - 18.9) < 0.1
    with pytest.raises(ValueError):
        geo.union("POINT (0 0)", box(0, 0, 1, 1))


def test_hash_is_fnv_1a(spark):
    def fnv(raw):
        h = 0xCBF29CE484222325
        for byte in raw:
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    texts = ["", "a", "foobar", "é字" * 50, "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(numeric.hash(df["t"])).collect()] == [fnv(t.encode()) for t in texts]


def test_seeded_random_numbers(spark):
    draw = lambda: spark.range(20).select(numeric.random().alias("x")).collect()
    numeric.setseed(0.25)
    assert draw() == draw()


def test_index_of_postings(spark):
    rows = [(1, "Quick brown fox, ii² foxes"), (2, "the fox"), (3, None), (4, ""), (5, "FOX fox fox lazy")]
    docs = spark.createDataFrame(rows, "id long, body string")
    index = fts.Index.create(docs, "id", "body", "test", overwrite=True)
    for query in ("fox", "the", "ii² lazy", "", "none of them", "quick fox"):
        want = {r.key: round(r.score, 9) for r in fts.search(docs, "id", "body", query).collect()}
        assert {r.key: round(r.score, 9) for r in index.search(query).collect()} == want
    assert [r.key for r in index.search("fox", 2).collect()] == [r.key for r in fts.search(docs, "id", "body", "fox", 2).collect()] and index.search("ii²").count() == 1
    index.drop()
    with pytest.raises(Exception):
        fts.Index(spark, index.path)


def test_excluded_rows_keep_precision(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([1.0, 2.0, 4.0, 8.0, 1e17])], "k long, x double")
    out = windows.excluding(df, [], "k", "current row", ("rows", -10, 10), s=("sum", "x"))
    assert out.where("k = 4").head().s == 15.0
    out = windows.excluding(spark.createDataFrame([(1,), (2,), (4,)], "v int"), [], "v", "group", ("range", -2, -1), s=("sum", "v"))
    assert {r.v: r.s for r in out.collect()} == {1: None, 2: 1.0, 4: 2.0}


def test_asof_without_keys_is_cut(spark):
    rng = random.Random(5)
    left, right = [(k, rng.randint(0, 300) if k else None) for k in range(200)], [(rng.randint(0, 300), k) for k in range(60)]
    rows = joins.asof_join(spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "u int, v int"), "t", "u", how="left", tie=["v"]).collect()
    want = {k: max(((u, v) for u, v in right if t is not None and u <= t), default=(None, None)) for k, t in left}
    assert {r.k: (r.u, r.v) for r in rows} == want
    empty = spark.createDataFrame([], "u int, v int")
    assert joins.asof_join(spark.createDataFrame(left, "k int, t int"), empty, "t", "u", how="left").count() == 200


def test_written_tables_are_dropped(spark):
    materialize.drop_written(spark)
    made = materialize.written(spark.range(5), "five")
    (file,) = {f.rpartition("/")[0] for f in made.inputFiles()}
    assert made.count() == 5 and os.path.isdir(file.removeprefix("file://"))
    assert materialize.drop_written(spark) == 1 and not os.path.exists(file.removeprefix("file://")) and materialize.drop_written(spark) == 0


def test_system_tables(spark, tmp_path):
    spark.range(3).toDF("k").createOrReplaceTempView("system_view")
    catalog.Sequence_(name="numbers").nextval()
    for name in system.system_names():
        assert system.system_table(spark, name).columns, name
    assert system.system_table(spark, "duckdb_views()").where("view_name = 'system_view'").count() == 1
    assert [r.data_type for r in system.system_table(spark, "information_schema.columns").where("table_name = 'system_view'").collect()] == ["BIGINT"]
    assert system.system_table(spark, "sequences").where("sequence_name = 'numbers' and last_value = 1").count() == 1
    assert system.system_table(spark, "keywords").where("keyword_name = 'select'").count() == 1 and system.system_table(spark, "pg_catalog.pg_class").where("relname = 'system_view' and relkind = 'v'").count() == 1


def test_tables_by_name_and_attached_folders(spark, tmp_path):
    made = system.create_table(spark, "made", "k int, twice int, state string", spark.sql("SELECT 4 AS k"), {"state": F.lit("new")}, {"twice": F.col("k") * 2})
    assert [tuple(r) for r in made.collect()] == [(4, 8, "new")]
    assert system.create_table_as(made, "copied").count() == 1 and system.create_table_as(made.limit(0), "copied", if_not_exists=True).count() == 1
    assert [r.name for r in system.pragma(spark, "table_info", "made").collect()] == ["k", "twice", "state"]
    for name in ("made", "copied"):
        system.drop_table(spark, name)
    system.drop_table(spark, "made", if_exists=True)
    spark.range(4).write.parquet(f"{tmp_path}/four.parquet")
    assert system.attach(spark, str(tmp_path), "other") == ["four"] and spark.table("other.four").count() == 4
    system.use(spark, "other")
    assert spark.table("four").count() == 4 and system.pragma(spark, "show_tables").where("name = 'four'").count() == 1
    system.use(spark, "default")
    system.detach(spark, "other")
    assert spark.read.parquet(f"{tmp_path}/four.parquet").count() == 4
    with pytest.raises(ValueError):
        dml.with_defaults(spark.sql("SELECT 1 AS k"), "k int", generated={"k": F.lit(1)})


def test_ranges_of_a_sheet(spark, tmp_path):
    from lakeloom.sources.xlsx import read_xlsx

    path = f"{tmp_path}/a.xlsx"
    writers.copy_to(spark.createDataFrame([(k, f"t{k}", k * 2.5) for k in range(6)], "a int, b string, c double").orderBy("a"), path)
    assert [tuple(r) for r in read_xlsx(spark, path, header=False, cells="B3:C4").collect()] == [("t1", 2.5), ("t2", 5.0)]
    assert read_xlsx(spark, path, cells="B1").columns == ["b", "c"] and read_xlsx(spark, path, cells="A1:A").count() == 6
    with pytest.raises(ValueError):
        read_xlsx(spark, path, cells="1:2")


def test_skipped_lines_keep_rows_like_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note\na,b\n1,2\na,b\n3,4\n")
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/a.csv", skip=1).collect()] == [("1", "2"), ("a", "b"), ("3", "4")]


def test_vectorised_aggregate(spark):
    from lakeloom.udf import mergeable_aggregate, vectorised

    df = spark.range(100).selectExpr("id % 3 AS k", "double(id) AS x").repartition(5)
    out = mergeable_aggregate(df, ["k"], "x", lambda: 0.0, vectorised(lambda s, v: max(s, v.max())), max, lambda s: s, "double", "double", "m")
    assert dict(out.collect()) == {0: 99.0, 1: 97.0, 2: 98.0}
    empty = aggregates.exact_sum_table(spark.createDataFrame([("a", None), ("b", 1e16), ("b", 1.0), ("b", -1e16)], "k string, x double"), ["k"], "x")
    assert dict(empty.collect()) == {"a": None, "b": 1.0}


def test_mergeable_aggregate_merges_in_order_of_keys_without_a_call_per_group(spark):
    from lakeloom.udf import mergeable_aggregate

    count = lambda d, keys: mergeable_aggregate(d, keys, "x", lambda: 0, lambda s, x: s + 1, lambda a, b: a + b, lambda s: s, "long", "long", "n")
    df = spark.range(3000).selectExpr("id % 1000 AS a", "if(id % 7 = 0, null, cast(id % 7 AS string)) AS b", "double(id) AS x").repartition(70)
    out = count(df, ["a", "b"])
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert sorted(map(str, out.collect())) == sorted(map(str, df.groupBy("a", "b").agg(F.count("*").alias("n")).collect()))
    zeros = spark.createDataFrame([(-0.0, 1.0), (0.0, 1.0), (1.0, 1.0)], "k double, x double").repartition(3)
    assert sorted(r.n for r in count(zeros, ["k"]).collect()) == [1, 2]
    assert [r.n for r in count(df, []).collect()] == [3000]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_broadcasts_no_repeated_side(spark, how):
    large = spark.range(1000).selectExpr("id % 12 AS k", "id")
    small = spark.range(10).selectExpr("id AS k", "id * 2 AS twice")
    out = joins.salted_join(large, small, ["k"], 4, how)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.collect())) == sorted(map(str, large.join(small, "k", how).collect()))


def test_postings_of_long_texts_and_segments(spark):
    words = [f"w{k * k % 4001}" for k in range(20_000)]
    rows = [(k, " ".join(words[k:])) for k in range(3)] + [(3, None), (4, "the"), (5, "w1 W1 w1"), (6, "w1")]
    docs = spark.createDataFrame(rows, "id long, body string").repartition(3)
    made = fts.postings(docs, "id", "body")
    plan = made._jdf.queryExecution().toString()
    assert "array_remove" not in plan  # a pass over a text for each of its terms
    want = {(k, w, n, sum(c.values())) for k, t in rows for c in [collections.Counter(x for x in (t or "").lower().split() if x != "the")] for w, n in c.items()}
    assert {tuple(r) for r in made.collect()} == want
    index = fts.Index.create(docs, "id", "body", "segments", overwrite=True)
    for r in spark.read.parquet(f"{index.path}/postings").withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list(F.struct("term", "key")).alias("x")).collect():
        assert r.x == sorted(r.x)
    assert index.documents == 7 and index.mean == sum(n for _, _, n, _ in want) / 7
    index.drop()
    none = fts.Index.create(docs.where("id < 0"), "id", "body", "none", overwrite=True)
    assert none.documents == 0 and none.search("w1").count() == 0
    none.drop()


@pytest.mark.parametrize("name", ["agg_arg_min_max", "agg_names"])
def test_equal_prices_give_the_first_order(spark, tmp_path, name):
    import duckdb

    from lakeloom import queries

    queries.load()
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT k AS o_orderkey, k % 3 AS o_custkey, 'F' AS o_orderstatus, CASE WHEN k % 7 < 5 THEN (k // 3 % 2) * 10.0::DOUBLE END AS o_totalprice FROM range(60) r(k) ORDER BY k) TO '{tmp_path}/orders.parquet'")
    duck.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    want = duck.sql(f"SELECT o_custkey, lo, hi FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("o_custkey", "lo", "hi").collect()) == sorted(want)
