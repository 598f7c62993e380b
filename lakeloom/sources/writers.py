"""COPY TO: sinks by format, all written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codec names of COPY and of Spark.
CODECS = {"gzip": "gzip", "gz": "gzip", "zstd": "zstd", "snappy": "snappy", "lz4": "lz4", "brotli": "brotli", "none": "none", "uncompressed": "none"}


def copy_to(df: DataFrame, path: str, format: str | None = None, header: bool = True, delimiter: str = ",", quote: str = '"', nullstr: str = "", compression: str | None = None, partition_by: Sequence[str] = (), overwrite: bool = True, array: bool = False) -> None:
    """format: csv, parquet, json (array with array=True, else one object a line), ndjson, orc, arrow, arrow_stream or xlsx; by the path's ending if not given."""
    format = (format or path.rstrip("/").rpartition(".")[2]).lower()
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if compression:
        writer = writer.option("compression", CODECS[compression.lower()])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.options(header=header, sep=delimiter, quote=quote, escape='"', nullValue=nullstr).csv(path)
    elif format in ("parquet", "pq"):
        writer.parquet(path)
    elif format in ("json", "ndjson", "jsonl"):
        if array:  # a whole file of one array, for tables that one file can hold
            rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).coalesce(1)
            rows.mapInPandas(_array, "value string").write.mode("overwrite" if overwrite else "errorifexists").text(path)
        else:
            writer.option("ignoreNullFields", False).json(path)
    elif format == "orc":
        writer.orc(path)
    elif format in ("arrow", "arrows", "arrow_stream", "ipc", "feather"):
        _arrow(df, path, stream=format in ("arrow_stream", "arrows"))
    elif format == "xlsx":
        from .xlsx import write_xlsx

        write_xlsx(df, path)
    else:
        raise ValueError(f"no writer for {format}")


def _array(frames):
    import pandas as pd

    first = True
    for f in frames:
        for r in f["r"]:
            yield pd.DataFrame({"value": [("[" if first else ",") + r]})
            first = False
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def _arrow(df: DataFrame, path: str, stream: bool) -> None:
    """An IPC file per partition, written by the tasks: through pyarrow's file systems where they know the path's, which
    all executors then share, and through the driver's Hadoop file systems, a partition at a time, where they don't."""
    import io
    import uuid

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    kind = "arrows" if stream else "arrow"

    def fill(out, batches) -> None:
        with (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, schema) as writer:
            for b in batches:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema))

    jvm = df.sparkSession.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    qualified = fs.makeQualified(top).toString()
    if qualified.startswith(("file:", "s3", "gs:", "hdfs:")):

        def put(batches):
            from pyarrow import fs as arrow_fs

            system, base = arrow_fs.FileSystem.from_uri("file:///" + qualified.removeprefix("file:").lstrip("/") if qualified.startswith("file:") else qualified)
            name = f"part-{uuid.uuid4().hex}.{kind}"
            with system.open_output_stream(f"{base}/_{name}") as out:  # readers pass over names with a line in front
                fill(out, batches)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        names = [r["name"] for r in df.mapInArrow(put, "name string").collect()]  # a row a task
        for name in names:  # files of attempts that didn't count stay out
            fs.rename(jvm.org.apache.hadoop.fs.Path(top, f"_{name}"), jvm.org.apache.hadoop.fs.Path(top, name))
        for status in fs.listStatus(top):
            if status.getPath().getName().startswith("_part-"):
                fs.delete(status.getPath(), False)
        return

    def pack(batches):
        out = io.BytesIO()
        fill(out, batches)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["content"])

    for row in df.mapInArrow(pack, "content binary").toLocalIterator():  # a partition at a time
        target = fs.create(jvm.org.apache.hadoop.fs.Path(path, f"part-{uuid.uuid4().hex}.{kind}"))
        target.write(bytearray(row[0]))
        target.close()


def export_database(spark: SparkSession, path: str, tables: Sequence[str], format: str = "parquet") -> None:
    """Each table's rows and schema; import_database reads them back."""
    for name in tables:
        df = spark.table(name)
        copy_to(df, f"{path}/{name}.{format}", format)
    rows = [(name, spark.table(name).schema.json()) for name in tables]
    spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/schema.json")


def import_database(spark: SparkSession, path: str, format: str = "parquet") -> list[str]:
    """Temporary views of an exported database's tables."""
    import json

    from pyspark.sql.types import StructType

    names = []
    for row in spark.read.json(f"{path}/schema.json").collect():
        schema = StructType.fromJson(json.loads(row["schema"]))
        reader = spark.read.schema(schema)
        df = reader.option("header", True).csv(f"{path}/{row['name']}.csv") if format == "csv" else reader.format("json" if "json" in format else format).load(f"{path}/{row['name']}.{format}")
        df.createOrReplaceTempView(row["name"])
        names.append(row["name"])
    return names


def append_rows(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    """An appender: rows of the driver as one batch appended to a Parquet table."""
    spark.createDataFrame(list(rows), schema).write.mode("append").parquet(path)
