"""One query for each operator, over the whole tables, with the results that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_text, lz_fingerprint, media, mixing, near_dedup, secrets, surrogates, token_counts, toxicity
from .common import documents

TIKTOKEN_FILE = "byte_bpe_multi_50k.tiktoken"
COUNTED_FILE = "byte_bpe_50k.json"


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of the surrogates, from the session's spark.lakeloom.surrogateKey. Without it, a key that is no secret, for trials."""
    return spark.conf.get("spark.lakeloom.surrogateKey", "for trials only").encode()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(documents(spark, sf_dir), *_tokenizer(TIKTOKEN_FILE), ids=False)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.with_media(documents(spark, sf_dir)))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(documents(spark, sf_dir), surrogate_key(spark), count="n_replaced").select("doc_id", "text", "n_replaced")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Trained on labelled documents outside the held-out third."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(*toxicity.training_sample(docs, labels, toxicity.remainder(F.col("key")) != 1))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_model(docs, sf_dir)
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(toxicity.remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.digest(secrets.scanned(docs, secrets.train(secrets.labelled_samples(docs))))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir), *_tokenizer(COUNTED_FILE))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_byte_bpe, op3_media, op4_surrogates, op5_html_text, op6_lz_fingerprint, op7_toxicity, op8_secrets, op9_near_dedup, op10_token_counts)}


#: Results that DuckDB SQL can express. The rest rest on trained scores, tokenizers, signatures or keyed hashes.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, size, k, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (sum(size) OVER ())::BIGINT AS words FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY 2 * size / w, k) AS r, 1.5::DOUBLE * words - coalesce(sum(2.0::DOUBLE * size) OVER (ORDER BY 2 * size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY 2 * size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM w),
f AS (SELECT r AS first, rest, weight FROM c WHERE rest * w / weight <= 2.0::DOUBLE * size ORDER BY r LIMIT 1),
t AS (SELECT c.source, c.k, c.size, CASE WHEN c.r < f.first THEN 2.0::DOUBLE * c.size ELSE f.rest * c.w / f.weight END AS target, greatest(1, least(64, c.words // 4096)) AS block, c.words FROM c, f),
n AS (SELECT *, (size + block - 1) // block AS blocks, floor(1.5::DOUBLE * words / block + 0.5)::BIGINT AS seats, greatest(1, ((size + block - 1) // block + 31) // 32) AS per FROM t),
q AS (SELECT k, row_number() OVER (ORDER BY target / (2 * h + 1) DESC, k) AS rank, seats FROM (SELECT k, target, seats, unnest(range(0, 2 * blocks)) AS h FROM n WHERE target > 0)),
a AS (SELECT k, count(*) AS share FROM q WHERE rank <= seats GROUP BY k),
u AS (SELECT k, size, per, blocks, unnest(range(0, (blocks + per - 1) // per)) AS j FROM n),
v AS (SELECT k, size, j, least(per, blocks - j * per) AS have FROM u),
p AS (SELECT k, j, row_number() OVER (PARTITION BY k ORDER BY have::DOUBLE / (2 * h + 1) DESC, j) AS rank FROM (SELECT k, j, have, unnest(range(0, 2 * have)) AS h FROM v)),
g AS (SELECT p.k, p.j, count(*) AS quota FROM p JOIN a ON a.k = p.k WHERE p.rank <= a.share GROUP BY p.k, p.j),
b AS (SELECT v.k, v.j, v.have, coalesce(g.quota, 0)::BIGINT AS quota, ('0x' || md5(concat_ws(':', 20240229, v.k, v.j, v.size))[:15])::BIGINT % v.have AS turn FROM v LEFT JOIN g ON g.k = v.k AND g.j = v.j),
runs AS (SELECT *, quota // have AS base, quota % have AS rest, coalesce(sum(quota) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
o AS (SELECT *, row_number() OVER () AS row, ('0x' || md5(concat_ws(':', 20240229, doc_id, size))[:15])::BIGINT AS place FROM d),
e AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size, row ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM o),
x AS (SELECT row, source, until AS pos, 1 AS sign FROM e UNION ALL SELECT row, source, until - size, -1 FROM e),
y AS (SELECT x.row, x.sign, x.pos, n.block, x.pos // n.block - r.j * n.per AS local, r.* FROM x JOIN n ON n.source IS NOT DISTINCT FROM x.source JOIN runs r ON r.k = n.k AND r.j = least(x.pos // n.block // n.per, (n.blocks + n.per - 1) // n.per - 1)),
z AS (SELECT row, sum(sign * ((before + local * base + (local + turn) * rest // have - turn * rest // have) * block + pos % block * (base + (local + 1 + turn) * rest // have - (local + turn) * rest // have)))::BIGINT AS taken FROM y GROUP BY row)
SELECT e.doc_id, e.size, n.size AS source_size, n.target, CASE WHEN e.size > 0 THEN z.taken ELSE 0 END AS taken
FROM e JOIN n ON n.source IS NOT DISTINCT FROM e.source LEFT JOIN z ON z.row = e.row""",
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id""",
}
