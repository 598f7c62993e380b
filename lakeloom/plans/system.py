"""System tables, attached folders, tables by name and pragmas, as DataFrames over Spark's catalog.

The catalog's own size bounds what is gathered on the driver here; no table's rows are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.strings import TYPE_NAMES
from ..operators.dml import with_defaults
from ..sources.readers import glob
from . import catalog


def _relations(spark: SparkSession) -> Iterator[tuple[str, str, str, bool, bool, StructType]]:
    """(catalog, schema, name, is a view, is temporary, columns) of every table and view of all databases."""
    seen = set()
    for database in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(database.name):
            schema = ".".join(t.namespace or []) or "temp"
            if (schema, t.name) not in seen:
                seen.add((schema, t.name))
                found = spark.table(f"`{t.name}`" if t.isTemporary else f"`{schema}`.`{t.name}`").schema
                yield t.catalog or "temp", schema, t.name, t.tableType in ("VIEW", "TEMPORARY"), t.isTemporary, found


def _columns(spark: SparkSession) -> Iterator[tuple]:
    for database, schema, name, _, _, fields in _relations(spark):
        for k, f in enumerate(fields.fields, 1):
            kind = f.dataType.simpleString()
            yield database, schema, name, f.name, k, f.nullable, TYPE_NAMES.get(kind, kind.upper())


def _oid(*names: str) -> int:
    return zlib.crc32(".".join(names).encode()) & 0x7FFFFFFF


def _memory(spark: SparkSession) -> Iterator[tuple]:
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    entries = status.iterator()
    while entries.hasNext():
        entry = entries.next()
        yield entry._1(), entry._2()._1() - entry._2()._2(), entry._2()._1()


def _rules(spark: SparkSession) -> Iterator[tuple]:
    rules = spark._jsparkSession.sessionState().optimizer().nonExcludableRules().iterator()
    while rules.hasNext():
        yield (rules.next().rpartition(".")[2],)


def _schemas(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def _table_rows(spark: SparkSession, views: bool | None) -> list[tuple]:
    return [x for x in _relations(spark) if views is None or x[3] == views]


#: Columns and rows of each system table.
_SYSTEM: dict[str, tuple[str, Callable[[SparkSession], Iterator[tuple] | list[tuple]]]] = {
    "tables": ("database_name string, schema_name string, table_name string, temporary boolean, column_count int", lambda s: [(a, b, c, e, len(f)) for a, b, c, _, e, f in _table_rows(s, False)]),
    "views": ("database_name string, schema_name string, view_name string, temporary boolean, column_count int", lambda s: [(a, b, c, e, len(f)) for a, b, c, _, e, f in _table_rows(s, True)]),
    "columns": ("database_name string, schema_name string, table_name string, column_name string, column_index int, is_nullable boolean, data_type string", _columns),
    "constraints": ("schema_name string, table_name string, constraint_type string, constraint_column_names array<string>", lambda s: [(b, c, "NOT NULL", [x]) for _, b, c, x, _, n, _ in _columns(s) if not n]),
    "indexes": ("schema_name string, table_name string, index_name string, is_unique boolean", lambda s: []),
    "databases": ("database_name string, path string", lambda s: [(d.name, d.locationUri) for d in s.catalog.listDatabases()]),
    "schemas": ("database_name string, schema_name string", lambda s: [(d.catalog, d.name) for d in s.catalog.listDatabases()]),
    "sequences": ("sequence_name string, increment_by long, last_value long", lambda s: [(n, q._increment, q._last) for n, q in catalog.SEQUENCES.items()]),
    "dependencies": ("object_name string, referenced_name string", lambda s: []),
    "optimizers": ("name string", _rules),
    "keywords": ("keyword_name string, keyword_category string", lambda s: [(r["keyword"].lower(), "reserved" if r["reserved"] else "unreserved") for r in s.sql("SELECT * FROM sql_keywords()").collect()]),
    "extensions": ("extension_name string, loaded boolean", lambda s: [(n, True) for n in ("arrow", "csv", "fts", "json", "orc", "parquet", "spatial", "xlsx")]),
    "memory_usage": ("tag string, memory_usage_bytes long, memory_limit_bytes long", _memory),
    "temp_directory": ("path string", lambda s: [(s.sparkContext.getConf().get("spark.local.dir", "/tmp"),)]),
    "types": ("type_name string, spark_name string", lambda s: [(v, k) for k, v in TYPE_NAMES.items()]),
    "information_schema.schemata": ("catalog_name string, schema_name string", lambda s: [(d.catalog, d.name) for d in s.catalog.listDatabases()]),
    "information_schema.tables": ("table_catalog string, table_schema string, table_name string, table_type string", lambda s: [(a, b, c, "VIEW" if d else "BASE TABLE") for a, b, c, d, _, _ in _table_rows(s, None)]),
    "information_schema.views": ("table_catalog string, table_schema string, table_name string", lambda s: [(a, b, c) for a, b, c, *_ in _table_rows(s, True)]),
    "information_schema.columns": ("table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string", lambda s: [(a, b, c, x, k, "YES" if n else "NO", t) for a, b, c, x, k, n, t in _columns(s)]),
    "information_schema.table_constraints": ("table_schema string, table_name string, constraint_type string", lambda s: [(b, c, "CHECK") for _, b, c, _, _, n, _ in _columns(s) if not n]),
    "information_schema.key_column_usage": ("table_schema string, table_name string, column_name string, ordinal_position int", lambda s: []),
    "pg_catalog.pg_namespace": ("oid long, nspname string", lambda s: [(_oid(n), n) for n in _schemas(s)]),
    "pg_catalog.pg_class": ("oid long, relname string, relnamespace long, relkind string, relnatts int", lambda s: [(_oid(b, c), c, _oid(b), "v" if d else "r", len(f)) for _, b, c, d, _, f in _table_rows(s, None)]),
    "pg_catalog.pg_attribute": ("attrelid long, attname string, attnum int, attnotnull boolean, atttypid long", lambda s: [(_oid(b, c), x, k, not n, _oid(t)) for _, b, c, x, k, n, t in _columns(s)]),
    "pg_catalog.pg_type": ("oid long, typname string", lambda s: [(_oid(v), v.lower()) for v in TYPE_NAMES.values()]),
    "pg_catalog.pg_tables": ("schemaname string, tablename string", lambda s: [(b, c) for _, b, c, *_ in _table_rows(s, False)]),
    "pg_catalog.pg_views": ("schemaname string, viewname string", lambda s: [(b, c) for _, b, c, *_ in _table_rows(s, True)]),
    "pg_catalog.pg_database": ("oid long, datname string", lambda s: [(_oid(n), n) for n in _schemas(s)]),
    "pg_catalog.pg_proc": ("oid long, proname string", lambda s: [(_oid(r["function_name"]), r["function_name"]) for r in catalog.functions(s).collect()]),
    "pg_catalog.pg_settings": ("name string, setting string", lambda s: [(r["name"], r["value"]) for r in catalog.settings(s).collect()]),
    "pg_catalog.pg_index": ("indexrelid long, indrelid long, indisunique boolean", lambda s: []),
    "pg_catalog.pg_constraint": ("oid long, conname string, conrelid long, contype string", lambda s: [(_oid(b, c, x), f"{c}_{x}_not_null", _oid(b, c), "n") for _, b, c, x, _, n, _ in _columns(s) if not n]),
    "pg_catalog.pg_sequence": ("seqname string, seqincrement long", lambda s: [(n, q._increment) for n, q in catalog.SEQUENCES.items()]),
}


def system_names() -> list[str]:
    return sorted([*_SYSTEM, "settings", "functions"])


def system_table(spark: SparkSession, name: str) -> DataFrame:
    """A system table by name: tables, columns, ..., information_schema.columns, pg_catalog.pg_class, ..."""
    name = name.lower().removesuffix("()").removeprefix("duckdb_")
    if name == "settings":
        return catalog.settings(spark)
    if name == "functions":
        return catalog.functions(spark)
    schema, rows = _SYSTEM[name]
    return spark.createDataFrame(list(rows(spark)), schema)


def create_table(spark: SparkSession, name: str, columns: str, rows: DataFrame | None = None, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None, replace: bool = False) -> DataFrame:
    """CREATE TABLE with columns as DDL, filled with rows whose missing columns take their defaults."""
    empty = spark.createDataFrame([], columns)
    made = with_defaults(rows, columns, defaults, generated) if rows is not None else empty
    made.write.mode("overwrite" if replace else "error").saveAsTable(name)
    return spark.table(name)


def create_table_as(df: DataFrame, name: str, replace: bool = False, if_not_exists: bool = False) -> DataFrame:
    """CREATE TABLE AS."""
    df.write.mode("overwrite" if replace else "ignore" if if_not_exists else "error").saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str, if_exists: bool = False) -> None:
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name}")


def attach(spark: SparkSession, folder: str, name: str) -> list[str]:
    """ATTACH: the Parquet tables of a folder, under a database's name; nothing is copied."""
    spark.sql(f"CREATE DATABASE `{name}`")
    found = []
    for path in glob(spark, f"{folder.rstrip('/')}/*.parquet", empty="allow"):
        table = path.rstrip("/").rpartition("/")[2].removesuffix(".parquet")
        spark.catalog.createTable(f"`{name}`.`{table}`", path=path, source="parquet")
        found.append(table)
    return found


def detach(spark: SparkSession, name: str) -> None:
    """DETACH; the files stay."""
    spark.sql(f"DROP DATABASE `{name}` CASCADE")


def use(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def pragma(spark: SparkSession, name: str, *args: str) -> DataFrame:
    """PRAGMA show_tables, table_info(name), database_list, version, functions, and settings by name."""
    if name == "show_tables":
        return system_table(spark, "information_schema.tables").select(F.col("table_name").alias("name"))
    if name == "table_info":
        fields = spark.table(args[0]).schema.fields
        rows = [(k, f.name, TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()), not f.nullable) for k, f in enumerate(fields)]
        return spark.createDataFrame(rows, "cid int, name string, type string, notnull boolean")
    if name == "database_list":
        return system_table(spark, "databases").select(F.col("database_name").alias("name"), "path")
    if name == "version":
        return spark.createDataFrame([(spark.version,)], "library_version string")
    if name == "functions":
        return catalog.functions(spark).select(F.col("function_name").alias("name"))
    return spark.createDataFrame([(spark.conf.get(name, None),)], f"`{name}` string")
