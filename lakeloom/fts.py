"""Full-text search by BM25: over an index of written postings, or over the texts themselves."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.materialize import shared_dir

K1, B = 1.2, 0.75
#: Rows and bytes of one Arrow batch of texts' words, where the session doesn't set their size itself.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Words left out of the index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with "
    "about after all also am been before between both can could did do does each from had has have he her here him his how "
    "i its just may me more most my nor only other our out over own same she should so some still than them those through "
    "too under up very we were what when where which while who whom why would you your"
).split()


def tokens(text: str):
    """Lower-case runs of letters and digits without stop words, as an array column."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{Nd}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def terms_of(query: str) -> list[str]:
    """The distinct tokens of a query, by the rule of tokens()."""
    kept = (c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in query.lower())
    return sorted(set("".join(kept).split()).difference(STOP_WORDS))


def _equals(term: str):
    return lambda w: w == term


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, size): a document's terms with their counts and its length.

    The words of a batch of documents are counted at once, by sorted pairs of word and document, so a long text costs no
    more than its words. A batch's rows come in order of their terms, which leaves a sort of them only runs to merge.
    """
    spark = docs.sparkSession
    for name, most in ARROW.items():
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, str(most))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.columns
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
            words = lists.flatten().dictionary_encode()
            order = pc.sort_indices(words.dictionary)
            terms, rank = words.dictionary.take(order), np.argsort(order.to_numpy())
            rows = max(1, len(sizes))
            pairs, tf = np.unique(rank[words.indices.to_numpy(zero_copy_only=False)] * rows + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
            for start in range(0, len(pairs), 1 << 16):
                part = slice(start, start + (1 << 16))
                at = pairs[part] % rows
                found = [keys.take(pa.array(at)), terms.take(pa.array(pairs[part] // rows)), pa.array(tf[part], pa.int32()), pa.array(sizes[at], pa.int32())]
                yield pa.RecordBatch.from_arrays(found, ["key", "term", "tf", "size"])

    listed = docs.select(F.col(key).alias("key"), tokens(text).alias("words"))
    schema = T.StructType([T.StructField("key", listed.schema["key"].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("size", T.IntegerType())])
    return listed.mapInArrow(counted, schema)


def _weight(n: Column, df: Column, tf: Column, size: Column, mean: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


class Index:
    """Postings of a table in segments, each in order of its terms, so that a search reads the row groups of its terms alone.

    A segment holds the postings of one task's documents. It is sorted where it is made, so no posting is shuffled, and a
    frequent term is as spread as the documents are.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        totals = spark.read.parquet(f"{path}/totals").head()  # one row
        self.documents, self.mean = totals["documents"], totals["mean"]

    @classmethod
    def create(cls, docs: DataFrame, key: str, text: str, name: str, overwrite: bool = False) -> Index:
        """Build the index of a text column in the shared folder, under a name."""
        spark = docs.sparkSession
        path = f"{shared_dir(spark).rstrip('/')}/fts-{name}"
        mode = "overwrite" if overwrite else "error"
        segments = postings(docs, key, text).sortWithinPartitions("term", "key")
        segments.write.mode(mode).option("parquet.block.size", str(4 << 20)).parquet(f"{path}/postings")
        documents = docs.count()
        words = spark.read.parquet(f"{path}/postings").agg(F.sum("tf")).head()[0] or 0  # one row
        totals = spark.createDataFrame([(documents, words / documents if documents else None)], "documents long, mean double")
        totals.write.mode(mode).parquet(f"{path}/totals")
        return cls(spark, path)

    def drop(self) -> None:
        jvm = self._spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """key and score of the documents that hold a term of the query; with a limit the best, then by key."""
        terms = terms_of(query)
        found = self._spark.read.parquet(f"{self.path}/postings").where(F.col("term").isin(terms) if terms else F.lit(False))
        frequencies = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        weight = _weight(F.lit(self.documents), F.col("df"), F.col("tf"), F.col("size"), F.lit(self.mean))
        out = found.join(F.broadcast(frequencies), "term").groupBy("key").agg(F.sum(weight).alias("score"))
        return out.orderBy(F.col("score").desc(), "key").limit(limit) if limit else out


def search(docs: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """key and score as Index.search gives them, without an index: for a table that is searched once.

    Only the query's terms are counted, by array functions in the scan's stage, so no text or posting is shuffled.
    """
    terms = terms_of(query)
    if not terms:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)
    counted = docs.select(F.col(key).alias("key"), tokens(text).alias("words")).select(
        "key", F.coalesce(F.size("words"), F.lit(0)).alias("size"), *(F.size(F.filter("words", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms))
    )
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    parts = (_weight(F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("size"), F.col("mean")) for i in range(len(terms)))
    out = joined.select("key", sum(parts, F.lit(0.0)).alias("score"))
    return out.orderBy(F.col("score").desc(), "key").limit(limit) if limit else out
