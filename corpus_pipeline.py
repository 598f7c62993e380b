"""A training corpus from raw documents: toxic ones go, one of each group of near copies stays, personal data is replaced,
sources are mixed to their weights, and what is left is encoded.

Cases: null and empty texts are clean, nobody's copies, and have no words to mix, so the mix leaves them out; without
labels of both classes no text counts as toxic; rows with equal doc_id are one document to near-duplicate detection;
null sources are a source; an empty table gives an empty table; other columns stay, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import byte_bpe, mixing, near_dedup, surrogates, toxicity
from lakeloom.llm.common import documents, written
from lakeloom.llm.queries import TIKTOKEN_FILE, _tokenizer, surrogate_key, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity_model(docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = surrogates.pseudonymised(docs, surrogate_key(spark))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(docs, *_tokenizer(TIKTOKEN_FILE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Signatures, trained scores and keyed replacements are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
