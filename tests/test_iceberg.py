"""Iceberg tables written here, file by file, with renamed columns, deletes of both kinds and several snapshots."""

import json
import os
import shutil
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeloom.sources import avro, iceberg


def varint(n):
    n = n << 1 ^ n >> 63
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def encoded(kind, v):
    if isinstance(kind, list):
        k = 0 if v is None else 1
        return varint(k) + encoded(kind[k], v)
    if isinstance(kind, dict):
        if kind["type"] == "record":
            return b"".join(encoded(f["type"], v[f["name"]]) for f in kind["fields"])
        if kind["type"] == "map":
            return (varint(len(v)) + b"".join(encoded("string", a) + encoded(kind["values"], b) for a, b in v.items()) if v else b"") + b"\0"
        return (varint(len(v)) + b"".join(encoded(kind["items"], x) for x in v) if v else b"") + b"\0"
    if kind == "null":
        return b""
    raw = v.encode() if kind == "string" else v if kind == "bytes" else None
    return varint(v) if raw is None else varint(len(raw)) + raw


def write_avro(path, schema, rows, codec="null"):
    sync = os.urandom(16)
    body = b"".join(encoded(schema, r) for r in rows)
    if codec == "deflate":
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = z.compress(body) + z.flush()
    head = encoded({"type": "map", "values": "bytes"}, {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()})
    path.write_bytes(avro.MAGIC + head + sync + varint(len(rows)) + varint(len(body)) + body + sync)


FILE = {"type": "record", "name": "data_file", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "equality_ids", "type": ["null", {"type": "array", "items": "int"}]}]}
ENTRY = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": FILE}]}
LISTED = {"type": "record", "name": "manifest", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}, {"name": "sequence_number", "type": "long"}]}


@pytest.fixture
def table(tmp_path):
    top = tmp_path / "old"
    for d in ("data", "metadata"):
        (top / d).mkdir(parents=True)

    def parquet(file, ids, **columns):
        fields = [pa.field(n, pa.array(v).type, metadata={"PARQUET:field_id": str(i)}) for (n, v), i in zip(columns.items(), ids, strict=True)]
        pq.write_table(pa.table([pa.array(v) for v in columns.values()], schema=pa.schema(fields)), top / "data" / file)
        return f"{top}/data/{file}", len(next(iter(columns.values())))

    def manifest(name, entries, number, codec="null"):
        rows = [{"status": s, "sequence_number": n, "data_file": {"content": c, "file_path": f[0], "file_format": "PARQUET", "record_count": f[1], "equality_ids": ids}} for s, n, c, f, ids in entries]
        write_avro(top / "metadata" / name, ENTRY, rows, codec)
        return {"manifest_path": f"{top}/metadata/{name}", "content": int(any(e[2] for e in entries)), "sequence_number": number}

    first = parquet("a.parquet", [1, 2], id=[1, 2, 3, 4], old_name=["a", "b", "c", None])
    second = parquet("b.parquet", [1, 2, 3], id=[5, 6], name=["e", "b"], extra=[1.5, None])
    gone = parquet("gone.parquet", [1, 2], id=[99], old_name=["x"])
    places = parquet("places.parquet", [2147483546, 2147483545], file_path=[f"{top}/data/a.parquet"], pos=[2])
    values = parquet("values.parquet", [2], name=["b", None])
    m1 = manifest("m1.avro", [(1, None, 0, first, None), (2, None, 0, gone, None)], 1)
    m2 = manifest("m2.avro", [(1, 3, 0, second, None)], 3, "deflate")
    m3 = manifest("m3.avro", [(1, None, 1, places, None)], 2)
    m4 = manifest("m4.avro", [(1, 3, 2, values, [2])], 3)
    snapshots = []
    for k, manifests in enumerate(([m1], [m1, m3], [m1, m2, m3, m4]), 1):
        write_avro(top / "metadata" / f"snap-{k}.avro", LISTED, manifests)
        snapshots.append({"snapshot-id": k, "sequence-number": k, "timestamp-ms": 1000 * k, "manifest-list": f"{top}/metadata/snap-{k}.avro", "schema-id": 0 if k < 3 else 1, "summary": {"operation": "append"}})
    fields = [{"id": 1, "name": "id", "required": True, "type": "long"}, {"id": 2, "name": "old_name", "required": False, "type": "string"}]
    newer = [fields[0], fields[1] | {"name": "name"}, {"id": 3, "name": "extra", "required": False, "type": "double"}]
    meta = {"format-version": 2, "location": str(top), "current-schema-id": 1, "current-snapshot-id": 3, "snapshots": snapshots, "schemas": [{"schema-id": 0, "type": "struct", "fields": fields}, {"schema-id": 1, "type": "struct", "fields": newer}]}
    (top / "metadata" / "v2.metadata.json").write_text("{}")
    (top / "metadata" / "v10.metadata.json").write_text(json.dumps(meta))
    shutil.move(top, tmp_path / "moved")
    return f"{tmp_path}/moved"


def test_scan_of_snapshots_with_deletes(spark, table):
    # Equality deletes take older rows only: "b" of the second file has their own number and stays.
    assert sorted(map(tuple, iceberg.scan(spark, table).collect())) == [(1, "a", None), (5, "e", 1.5), (6, "b", None)]
    old = iceberg.scan(spark, table, snapshot_id=1)
    assert old.columns == ["id", "old_name"] and sorted(r.id for r in old.collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in iceberg.scan(spark, table, timestamp_ms=2500).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        iceberg.scan(spark, table, snapshot_id=7)
    with pytest.raises(ValueError):
        iceberg.scan(spark, table, timestamp_ms=1)


def test_snapshots_and_entries(spark, table):
    assert [r.snapshot_id for r in iceberg.snapshots(spark, table).orderBy("snapshot_id").collect()] == [1, 2, 3]
    found = iceberg.entries(spark, table).groupBy("content", "status").count().collect()
    assert {(r["content"], r["status"]): r["count"] for r in found} == {(0, 1): 2, (0, 2): 1, (1, 1): 1, (2, 1): 1}


def test_damaged_files_are_refused(tmp_path):
    write_avro(tmp_path / "a.avro", LISTED, [{"manifest_path": "x", "content": 0, "sequence_number": -5}])
    data = (tmp_path / "a.avro").read_bytes()
    assert [r["sequence_number"] for r in avro.records(data)] == [-5]
    for bad in (b"none" + data[4:], data[:-1] + bytes([data[-1] ^ 1]), data[:-20]):
        with pytest.raises(ValueError):
            list(avro.records(bad))
