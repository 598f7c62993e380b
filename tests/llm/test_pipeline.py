"""The corpus pipeline against a recomputation of its stages on the smallest tables."""

import base64
import collections
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import mixing, surrogates
from lakeloom.llm.common import documents
from lakeloom.llm.queries import surrogate_key, toxicity_model

from .test_documents import WORD, brute_components, brute_copies, brute_mix

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = documents(spark, SF)
    model = toxicity_model(docs, SF)
    texts = {r.doc_id: r for r in docs.collect()}

    def score(text):
        from lakeloom.llm.toxicity import words_of

        return model.probability(model.logit(np.array([model.word(w) for w in words_of(text)])))

    texts = {k: r for k, r in texts.items() if score(r.text) < 0.7}
    keep = brute_components([(k, r.text) for k, r in texts.items()])
    texts = {k: r for k, r in texts.items() if keep[k][1] == k}
    clean = {k: surrogates.replaced(r.text, lambda kind, c: surrogates.surrogate(kind, c, 0, surrogate_key(spark)))[0] for k, r in texts.items()}
    rows = [(k, clean[k], r.source) for k, r in texts.items()]
    sizes = {k: len(WORD.findall(clean[k])) for k in clean}
    taken, _ = brute_mix(rows, mixing.block_words(sum(sizes.values())))
    copies = brute_copies([(k, sizes[k], source, n) for (k, _, source), n in zip(rows, taken, strict=True)])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for k, n in copies.items():
        if n:
            want[k, hashlib.sha256(np.array(library.encode_ordinary(clean[k]), "<u4").tobytes()).hexdigest()] = n
    got = collections.Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and sum(len(WORD.findall(clean[k])) for k in clean) > 0


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark, SF)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "personal data", "mixing", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_stages_on_odd_tables(spark, empty, docs):
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("my col", F.lit("x")).withColumn("a.b", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() > 0, name
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def test_without_labels_no_text_goes(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == docs.count()
