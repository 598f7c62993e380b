"""What the operators of this subpackage share: worker set-up, written intermediate tables, small SQL helpers."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.plans.materialize import written

__all__ = ["ARROW_ROWS", "WORD", "documents", "in_arrow", "n_words", "parallelism", "quoted", "written"]

#: A word: a run of characters that are neither a space nor one of the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch sent to Python; documents may be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20
_REPO = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches short, where the session doesn't set their size itself."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if _REPO not in have:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *filter(None, have)])
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and hold what earlier tasks took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with short batches and workers that give memory back after each task."""
    prepare(df.sparkSession)

    @functools.wraps(f)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    if any("." in c or "`" in c for c in df.columns):  # names that mapInArrow takes for expressions
        df = df.toDF(*(f"column{k}" for k in range(len(df.columns))))
    return df.mapInArrow(work, schema)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
