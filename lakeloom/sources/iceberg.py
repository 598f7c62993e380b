"""Iceberg tables by their own files: metadata, snapshots, manifests, and scans with positional and equality deletes.

The driver reads the table's metadata and one snapshot's list of manifests; tasks decode the manifests; the data are
Spark's Parquet scan over the snapshot's files, by field id, so renamed and added columns are right, and filters and
columns are pushed into it. Deletes are anti-joins. Files are looked for below the table's folder, wherever it was moved.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import avro
from .readers import glob

_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.BinaryType(), "binary": T.BinaryType()}
_ENTRY = "manifest_path string, content int, status int, sequence_number long, file_path string, file_format string, record_count long, equality_ids array<int>"


def _read(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def table_metadata(spark: SparkSession, path: str) -> dict:
    """The newest metadata file of a table's folder."""
    found = glob(spark, f"{path.rstrip('/')}/metadata/*.metadata.json")
    number = lambda name: int((re.search(r"/v?(\d+)[^/]*\.metadata\.json$", name) or [0, 0])[1])
    return json.loads(_read(spark, max(found, key=number)))


def _type(kind) -> T.DataType:
    if isinstance(kind, str):
        if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
            return T.DecimalType(int(m[1]), int(m[2]))
        return T.BinaryType() if kind.startswith("fixed") else _PLAIN[kind]
    if kind["type"] == "struct":
        return _struct(kind["fields"])
    if kind["type"] == "list":
        return T.ArrayType(_type(kind["element"]), not kind.get("element-required", False))
    return T.MapType(_type(kind["key"]), _type(kind["value"]), not kind.get("value-required", False))


def _struct(fields: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], _type(f["type"]), True, {"parquet.field.id": f["id"]}) for f in fields])


def _schema(meta: dict, schema_id: int | None = None) -> T.StructType:
    if "schemas" not in meta:
        return _struct(meta["schema"]["fields"])
    wanted = meta["current-schema-id"] if schema_id is None else schema_id
    return _struct(next(s for s in meta["schemas"] if s["schema-id"] == wanted)["fields"])


def _moved(path: str, meta: dict, folder: str) -> str:
    """A file's path below the folder where the table is now."""
    own = meta["location"].rstrip("/")
    return folder.rstrip("/") + path[len(own) :] if path.startswith(own + "/") else path


def _snapshot(meta: dict, snapshot_id: int | None, timestamp_ms: int | None) -> dict | None:
    every = meta.get("snapshots", [])
    if snapshot_id is not None:
        found = [s for s in every if s["snapshot-id"] == snapshot_id]
        if not found:
            raise ValueError(f"no snapshot {snapshot_id}")
        return found[0]
    if timestamp_ms is not None:
        earlier = [s for s in every if s["timestamp-ms"] <= timestamp_ms]
        if not earlier:
            raise ValueError("the table has no snapshot as old as that")
        return max(earlier, key=lambda s: s["timestamp-ms"])
    return next((s for s in every if s["snapshot-id"] == meta.get("current-snapshot-id")), None)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """sequence_number, snapshot_id, timestamp_ms, manifest_list and operation of a table's snapshots."""
    rows = [(s.get("sequence-number", 0), s["snapshot-id"], s["timestamp-ms"], s.get("manifest-list"), s.get("summary", {}).get("operation")) for s in table_metadata(spark, path).get("snapshots", [])]
    return spark.createDataFrame(rows, "sequence_number long, snapshot_id long, timestamp_ms long, manifest_list string, operation string")


def entries(spark: SparkSession, path: str, snapshot_id: int | None = None, timestamp_ms: int | None = None) -> DataFrame:
    """The entries of a snapshot's manifests: content 0 are data, 1 positional and 2 equality deletes; status 2 is gone."""
    meta = table_metadata(spark, path)
    snapshot = _snapshot(meta, snapshot_id, timestamp_ms)
    if snapshot is None:
        return spark.createDataFrame([], _ENTRY)
    listed = list(avro.records(_read(spark, _moved(snapshot["manifest-list"], meta, path))))
    if not listed:
        return spark.createDataFrame([], _ENTRY)
    known = {_plain_path(_moved(m["manifest_path"], meta, path)): (m["manifest_path"], m.get("sequence_number") or 0) for m in listed}
    columns = [f.name for f in T.StructType.fromDDL(_ENTRY)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                manifest, number = known[_plain_path(name)]
                rows = []
                for e in avro.records(content.as_py()):
                    file = e["data_file"]
                    own = e.get("sequence_number")
                    rows.append((manifest, file.get("content") or 0, e["status"], number if own is None else own, file["file_path"], file["file_format"].upper(), file["record_count"], file.get("equality_ids")))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], columns)

    files = spark.read.format("binaryFile").load([_moved(m["manifest_path"], meta, path) for m in listed])
    return files.select("path", "content").mapInArrow(decode, _ENTRY)


def _plain_path(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _file_of() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def scan(spark: SparkSession, path: str, snapshot_id: int | None = None, timestamp_ms: int | None = None) -> DataFrame:
    """A table's rows, now or as of a snapshot or time, in its schema of then."""
    meta = table_metadata(spark, path)
    snapshot = _snapshot(meta, snapshot_id, timestamp_ms)
    schema = _schema(meta, snapshot.get("schema-id") if snapshot and (snapshot_id is not None or timestamp_ms is not None) else None)
    # Only schemas with field ids, such as this one, are read by them; others stay by name.
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    live = entries(spark, path, snapshot_id, timestamp_ms).where("status <> 2").collect()  # a row a file
    if any(e["file_format"] != "PARQUET" for e in live):
        raise ValueError("only Parquet files are read")
    of = lambda content: [(_moved(e["file_path"], meta, path), e["sequence_number"], e["equality_ids"]) for e in live if e["content"] == content]
    data, by_place, by_value = of(0), of(1), of(2)
    if not data:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(p for p, *_ in data))
    if not by_place and not by_value:
        return rows
    rows = rows.select("*", _file_of().alias("_file"), F.col("_metadata.row_index").alias("_place"))
    numbers = lambda files: spark.createDataFrame([(_plain_path(p), n) for p, n, _ in files], "_file string, _number long")  # noqa: E731  a row a file
    rows = rows.join(F.broadcast(numbers(data)), "_file")
    if by_place:
        gone = spark.read.parquet(*(p for p, *_ in by_place)).select(F.col("file_path").alias("_of"), F.col("pos").alias("_at"), _file_of().alias("_file"))
        own, now = meta["location"].rstrip("/"), _plain_path(path.rstrip("/"))
        moved = F.when(F.col("_of").startswith(own + "/"), F.concat(F.lit(now), F.substring(F.col("_of"), len(own) + 1, 1 << 20))).otherwise(F.regexp_replace("_of", "^file:/+", "/"))
        gone = gone.join(F.broadcast(numbers(by_place)), "_file").select(moved.alias("_of"), "_at", F.col("_number").alias("_until"))
        rows = rows.join(gone, (F.col("_file") == F.col("_of")) & (F.col("_place") == F.col("_at")) & (F.col("_number") <= F.col("_until")), "left_anti")
    for ids in sorted({tuple(ids or ()) for *_, ids in by_value}):
        files = [f for f in by_value if tuple(f[2] or ()) == ids]
        fields = [f for f in schema.fields if f.metadata["parquet.field.id"] in ids]
        gone = spark.read.schema(T.StructType(fields)).parquet(*(p for p, *_ in files)).select("*", _file_of().alias("_file"))
        gone = gone.join(F.broadcast(numbers(files)), "_file").select(*(F.col(f.name).alias(f"_v{k}") for k, f in enumerate(fields)), F.col("_number").alias("_until"))
        same = F.col("_number") < F.col("_until")
        for k, f in enumerate(fields):
            same = same & F.col(f.name).eqNullSafe(F.col(f"_v{k}"))
        rows = rows.join(gone, same, "left_anti")
    return rows.select(*schema.names)
