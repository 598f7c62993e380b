"""Lempel-Ziv phrase fingerprints: likeness of texts by the phrases that an incremental parse of each one finds.

A text is parsed into phrases, each the shortest run of characters from where the last one ended that is not yet in
the dictionary; it then joins the dictionary. The phrase set is hashed to 64 bits a phrase, and the SIGNATURE smallest
hashes are the fingerprint. The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets from
the smallest hashes of their union; like a compression distance it needs no words, so it fits any language or format.

Cases: a null text counts as empty; an empty text has the fingerprint "" and likeness 1 to another empty one, 0 to
the rest; equal texts have equal fingerprints; rows with equal keys, and rows without a key, which come first, follow
each other by the SHA-256 of their text; keys may be of any type that has an order; a single row is its own next; an
empty table gives an empty table; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, parallelism, prepare, quoted

#: Hashes of a fingerprint.
SIGNATURE = 128
#: Rows, about, whose keys and sizes tell where to cut the table into ranges.
SAMPLE_ROWS = 20_000
#: Characters that a row weighs besides its text.
ROW_CHARS = 200


def _parse(text: str, phrases: set[str]) -> int:
    """Parse text, add its phrases, and return the length of the rest, which is a phrase already."""
    phrase, add = "", phrases.add
    for char in text:
        phrase += char
        if phrase not in phrases:
            add(phrase)
            phrase = ""
    return len(phrase)


def phrases_of(text: str) -> set[str]:
    """The phrases of a text; a rest at its end that is already a phrase adds nothing."""
    found: set[str] = set()
    _parse(text, found)
    return found


def signature(phrases: set[str]) -> np.ndarray:
    """The SIGNATURE smallest 64-bit hashes of the phrases, ascending."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
    if len(hashes) > SIGNATURE:
        hashes = np.partition(hashes, SIGNATURE - 1)[:SIGNATURE]
    return np.unique(hashes)


def spelled(signature_: np.ndarray) -> str:
    return signature_.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = np.append(both[1:] == both[:-1], False)  # the first of each pair of equals
    once = np.append(True, both[1:] != both[:-1])
    shared = twice[once][:SIGNATURE]
    return float(shared.mean())


def _rows(key: str):
    """Rows in order of their keys to fingerprints; the last row of a partition is the first of the next one, unmarked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, whether it is this partition's own, text, signature, phrases up to the middle, where they end
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out: list[tuple] = []
        for batch in batches:
            for k, own, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                keep = len(text) - len(text) // 2
                phrases: set[str] = set()
                end = keep - _parse(text[:keep], phrases)  # up to here the edited text has the same phrases
                half = phrases.copy()
                _parse(text[end:], phrases)
                now = signature(phrases)
                if held is not None and held[1]:
                    of, _, before, was, part, at = held
                    edited = before[: len(before) - len(before) // 2] + text[: len(before) // 2]
                    _parse(edited[at:], part)
                    other = signature(part)
                    out.append((of, len(before), hashlib.sha256(edited.encode()).hexdigest(), spelled(was), spelled(other), likeness(was, other), likeness(was, now)))
                held = k, own, text, now, half, end
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0].as_py() for x in out], batch.schema.field(0).type), *(pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], 1))], names
                )
                out = []

    return work


def _place(key: object, sha: str) -> tuple:
    return (False, sha) if key is None else (True, key, sha)


def _cuts(sample: list[tuple], parts: int) -> list[tuple]:
    """Places (key, SHA-256) that cut the sampled rows (key, SHA-256, weight) into ranges of about equal weight."""
    ordered = sorted((_place(k, sha), weight) for k, sha, weight in sample)
    total, so_far, out = sum(w for _, w in ordered), 0, []
    for place, weight in ordered:
        if so_far >= total * (len(out) + 1) / parts and len(out) + 1 < parts and so_far:
            out.append(place)
        so_far += weight
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and likeness to the edited text and to the next row.

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next row's text, in
    order of key (after the last row: the first). Rows are dealt in ranges of (key, SHA-256), a range to a task; of
    every other range only the first row is needed, and it is sent along as the range's end.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    body = F.col(quoted(text)).cast("string")
    narrow = docs.select(F.col(quoted(key)).alias("key"), body.alias("text"), F.sha2(F.coalesce(body, F.lit("")), 256).alias("sha"))
    parts = parallelism(spark)
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    drawn = narrow.where(F.pmod(F.xxhash64("key", "sha"), F.lit(2**31)) < int(share * 2**31)).groupBy("key", "sha").agg(F.max(F.length("text")).alias("n"))
    cuts = _cuts([(x["key"], x["sha"], ROW_CHARS + (x["n"] or 0)) for x in drawn.collect()], parts)  # about SAMPLE_ROWS rows, repeats once

    @F.arrow_udf("int")
    def range_of(keys: pa.Array, shas: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, _place(k, s)) for k, s in zip(keys.to_pylist(), shas.to_pylist(), strict=True)], pa.int32())

    ranged = narrow.withColumn("range", range_of("key", "sha"))
    heads = ranged.groupBy("range").agg(F.min(F.struct("key", "sha")).alias("head")).orderBy("range").collect()  # a row a task
    schema = f"{quoted(key)} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return spark.createDataFrame([], schema)
    before = {h["range"]: heads[k - 1]["range"] for k, h in enumerate(heads)}
    ends = spark.createDataFrame([(h["head"]["key"], h["head"]["sha"], before[h["range"]]) for h in heads], f"head_key {kind}, head_sha string, into int")
    # one copy of each range's first row, whatever repeats it has
    again = narrow.join(F.broadcast(ends), F.col("key").eqNullSafe(F.col("head_key")) & (F.col("sha") == F.col("head_sha"))).groupBy("into").agg(F.first("key").alias("key"), F.first("text").alias("text"))
    rows = ranged.select("range", F.lit(0).alias("last"), "key", "sha", F.lit(True).alias("own"), "text").unionAll(again.select("into", F.lit(1), "key", F.lit(""), F.lit(False), "text"))
    dealt = rows.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "last", F.col("key").asc_nulls_first(), "sha")
    return in_arrow(dealt.select("key", "own", "text"), _rows(key), schema)
