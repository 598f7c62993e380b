"""File sources with the dialect's options, on Spark's readers, which push filters and columns into the files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _annotated(df: DataFrame, filename: bool, file_row_number: bool, file_index: bool) -> DataFrame:
    """Columns that tell a row's file, from Spark's file metadata."""
    if filename or file_index:
        df = df.select("*", F.col("_metadata.file_path").alias("filename"))
    if file_row_number:
        df = df.select("*", F.col("_metadata.row_index").alias("file_row_number"))
    if file_index:
        names = [x[0] for x in df.select("filename").distinct().orderBy("filename").collect()]  # one per file
        df = df.withColumn("file_index", F.array_position(F.array(*map(F.lit, names)), F.col("filename")) - 1)
        df = df if filename else df.drop("filename")
    return df


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, union_by_name: bool = False, filename: bool = False, file_row_number: bool = False, file_index: bool = False, hive_partitioning: bool = True) -> DataFrame:
    reader = spark.read.option("mergeSchema", union_by_name)
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", True)
    df = _annotated(reader.parquet(*_paths(path)), filename, file_row_number, file_index)
    return df.select(*columns) if columns else df


def sniff(spark: SparkSession, path: str, lines: int = 20) -> dict:
    """Delimiter and header of a CSV file, from its first lines: the delimiter that splits them most evenly."""
    rows = [x[0] for x in spark.read.text(path).limit(lines).collect()]
    best, delimiter = (0, 0), ","
    for d in (",", "\t", ";", "|", ":"):
        counts = [len(re.sub(r'"[^"]*"', "", r).split(d)) for r in rows if r]
        even = counts.count(counts[0]) if counts else 0
        if counts and counts[0] > 1 and (even, counts[0]) > best:
            best, delimiter = (even, counts[0]), d
    numeric = lambda s: bool(re.fullmatch(r"\s*-?\d+(\.\d*)?([eE][-+]?\d+)?\s*", s))
    first, rest = (rows[0].split(delimiter), [r.split(delimiter) for r in rows[1:]]) if rows else ([], [])
    header = bool(first) and not any(map(numeric, first)) and (not rest or any(numeric(x) for r in rest for x in r) or len(set(first)) == len(first))
    return {"delimiter": delimiter, "header": header}


def read_csv(spark: SparkSession, path: str | Sequence[str], delim: str = ",", quote: str = '"', escape: str = '"', header: bool = True, nullstr: str = "", skip: int = 0, columns: str | None = None, dateformat: str | None = None, timestampformat: str | None = None, ignore_errors: bool = False, sample: float = 1.0, union_by_name: bool = False, filename: bool = False, file_index: bool = False) -> DataFrame:
    """columns is a DDL schema; without it types are inferred from a share of the rows."""
    if union_by_name and not isinstance(path, str):
        parts = [read_csv(spark, p, delim, quote, escape, header, nullstr, skip, columns, dateformat, timestampformat, ignore_errors, sample, False, filename) for p in path]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    options = {"sep": delim, "quote": quote, "escape": escape, "header": header, "nullValue": nullstr, "mode": "DROPMALFORMED" if ignore_errors else "FAILFAST", "samplingRatio": sample}
    options |= {k: v for k, v in (("dateFormat", dateformat), ("timestampFormat", timestampformat)) if v}
    reader = spark.read.options(**options)
    if skip:
        lines = spark.read.text(_paths(path))
        kept = lines.select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
        from pyspark.sql import Window

        kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("i"))) if len(_paths(path)) > 1 else kept.withColumn("n", F.col("i") + 1)
        text = kept.where(F.col("n") > skip + (1 if header else 0)).select("value")
        names = kept.where(F.col("n") == skip + 1).select("value").first()
        heads = [x.strip(quote) for x in names[0].split(delim)] if names and header else [f"column{k}" for k in range(len(names[0].split(delim)))]
        ddl = columns or ", ".join(f"`{h}` string" for h in heads)
        return text.select(F.from_csv("value", ddl, {k: str(v) for k, v in options.items() if k in ("sep", "quote", "escape", "nullValue")}).alias("r")).select("r.*")
    df = (reader.schema(columns) if columns else reader.option("inferSchema", True)).csv(_paths(path))
    if not columns and not header:
        df = df.toDF(*(f"column{k}" for k in range(len(df.columns))))
    return _annotated(df, filename, False, file_index)


def read_csv_auto(spark: SparkSession, path: str, **options) -> DataFrame:
    found = sniff(spark, path)
    return read_csv(spark, path, **({"delim": found["delimiter"], "header": found["header"]} | options))


def read_json(spark: SparkSession, path: str | Sequence[str], columns: str | None = None, format: str = "auto", ignore_errors: bool = False, filename: bool = False) -> DataFrame:
    """format: newline_delimited, array or auto, which looks at the first sign of the first file."""
    if format == "auto":
        first = spark.read.text(_paths(path)[0]).where(F.trim("value") != "").first()
        format = "array" if first and first[0].lstrip().startswith("[") else "newline_delimited"
    reader = spark.read.option("multiLine", format == "array").option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST")
    df = (reader.schema(columns) if columns else reader).json(_paths(path))
    return _annotated(df, filename, False, False)


def read_ndjson(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    return read_json(spark, path, format="newline_delimited", **options)


def read_arrow(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Arrow IPC files or streams, each read by the executor that gets its bytes."""
    import pyarrow as pa

    def open_(data: bytes):
        return pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)

    files = spark.read.format("binaryFile").load(_paths(path))
    head = files.select("content").first()[0]
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(open_(head).schema)

    def work(batches):
        for batch in batches:
            for content in batch.column("content"):
                reader = open_(content.as_buffer())
                yield from (reader.get_batch(k) for k in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

    return files.select("content").mapInArrow(work, schema)


def scan_path(spark: SparkSession, path: str) -> DataFrame:
    """A replacement scan: a file's or glob's reader, by its extension."""
    name = re.sub(r"\.(gz|zst|bz2|snappy)$", "", path.lower())
    if name.endswith((".parquet", ".pq")):
        return read_parquet(spark, path)
    if name.endswith((".csv", ".tsv")):
        return read_csv_auto(spark, path)
    if name.endswith((".json", ".ndjson", ".jsonl")):
        return read_json(spark, path)
    if name.endswith((".arrow", ".arrows", ".ipc", ".feather")):
        return read_arrow(spark, path)
    if name.endswith(".xlsx"):
        from .xlsx import read_xlsx

        return read_xlsx(spark, path)
    if name.endswith(".orc"):
        return spark.read.orc(path)
    raise ValueError(f"no reader for {path}")


def glob(spark: SparkSession, pattern: str, empty: str = "disallow") -> list[str]:
    """Files that match * ? [] and **, by the session's file systems; empty: disallow (raises) or allow."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[str] = []
    try:
        if "**" in pattern:
            top = pattern.split("**")[0].rstrip("/") or "/"
            tail = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            files = fs.listFiles(jvm.org.apache.hadoop.fs.Path(top), True)
            while files.hasNext():
                name = files.next().getPath().toString()
                if re.fullmatch(f"(?:[a-z0-9]+:(?://)?)?{tail}", name):
                    found.append(name)
        else:
            found = [x.getPath().toString() for x in fs.globStatus(path) or []]
    except Py4JJavaError:
        found = []
    if not found and empty == "disallow":
        raise FileNotFoundError(pattern)
    return sorted(found)
