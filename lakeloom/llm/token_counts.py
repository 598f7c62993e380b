"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

1. Each block of documents (a run of rows of one input partition, up to a bounded number of characters) is cut into
   pre-tokens. The block's frequencies go out inverted: one row per distinct pre-token, with the packed list of
   (document in the block, frequency).
2. Blocks are dealt to groups by a hash, and the rows of a group by pre-token to the GROUP_TASKS tasks or so that are
   the group's own. Each task sees all rows that its group has of its pre-tokens, counts the pieces of each distinct one
   once, and multiplies them into the frequencies, so ids are never held. Sums leave it per (block, document).
3. Sums are dealt by block and added up, block after block.

Only packed lists of small integers travel, never texts or ids. A very frequent pre-token has one row per block, and
these rows are spread over the groups, whose number grows with the tasks: no task gets more of it than its group has
blocks, and no block's sums come from more than its group's tasks. Special strings inside a text are one token each, as
the library's default has it.

Cases: a null text counts as empty and has 0 tokens; repeated rows and repeated or null keys are counted row by row;
an empty table gives an empty table; other columns of the input are never looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, parallelism, quoted
from .pretokens import splitter

#: Characters of one block of documents, about.
BLOCK_CHARS = 24_000_000
#: Documents of one block at most, and the largest frequency of one entry; both fit in 16 bits.
BLOCK_DOCS, MOST_TIMES = 50_000, 65_535
#: Rows of pre-tokens whose frequencies a task holds before it sums them up, and pre-tokens whose counts it remembers.
HELD_ROWS, REMEMBERED = 300_000, 200_000
#: Tasks among which the pre-tokens of one group of blocks are dealt, about.
GROUP_TASKS = 64


@cache
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    """The added tokens of a tokenizer file, longest first."""
    with open(path) as f:
        return sorted((x["content"] for x in json.load(f)["added_tokens"]), key=lambda x: (-len(x), x))


def count_pieces(path: str, pretokens: list[str]) -> list[int]:
    """Pieces of each pre-token, by the library itself."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return [len(x.ids) for x in library_tokenizer(path).encode_batch_fast(pretokens, add_special_tokens=False)]


def _inverted(path: str, pattern: str):
    """Documents to rows (block, keys, sizes, pretoken, docs, times): a head with the keys and sizes of a block's
    documents, then the block's pre-tokens with packed 16-bit lists of documents and frequencies."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, special = splitter(pattern), special_strings(path)
        marks = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        part, number = TaskContext.get().partitionId(), 0
        kind = pa.int64()

        def pieces(text: str) -> list[str]:
            if not any(mark in text for mark in special):
                return split(text)
            out = []
            for k, piece in enumerate(marks.split(text)):  # every second one is a special string
                if k % 2:
                    out.append(piece)
                else:
                    out += split(piece)
            return out

        def batch_of(block: int, keys: list, sizes: list, texts: list, docs: list, times: list) -> pa.RecordBatch:
            columns = [pa.array([block] * len(texts), pa.int64()), pa.array(keys, pa.list_(kind)), pa.array(sizes, pa.list_(pa.int64()))]
            columns += [pa.array(texts, pa.string()), pa.array(docs, pa.binary()), pa.array(times, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "keys", "sizes", "pretoken", "docs", "times"])

        def flush() -> Iterator[pa.RecordBatch]:
            block, n = part << 32 | number, len(keys)
            yield batch_of(block, [keys], [sizes], [None], [None], [None])
            if not codes:
                return
            token, doc = np.concatenate(found), np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in found])
            both, times = np.unique(token * n + doc, return_counts=True)
            if times.max() > MOST_TIMES:  # more often than fits is listed more than once
                pieces_of = -(-times // MOST_TIMES)
                both, rest = np.repeat(both, pieces_of), times - (pieces_of - 1) * MOST_TIMES
                last = np.cumsum(pieces_of) - 1
                times = np.full(len(both), MOST_TIMES)
                times[last] = rest
            token, doc, times = both // n, (both % n).astype("<u2").tobytes(), times.astype("<u2").tobytes()
            ends = np.append(np.flatnonzero(np.diff(token)) + 1, len(token)) * 2
            starts = np.append(0, ends[:-1])
            texts = list(codes)  # in order of their codes
            for k in range(0, len(texts), 10_000):
                spans = list(zip(starts[k : k + 10_000].tolist(), ends[k : k + 10_000].tolist(), strict=True))
                none = [None] * len(spans)
                yield batch_of(block, none, none, texts[k : k + 10_000], [doc[a:b] for a, b in spans], [times[a:b] for a, b in spans])

        codes: dict[str, int] = {}
        found, keys, sizes, chars = [], [], [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = pieces(text := text or "")
                for x in set(row).difference(codes):
                    codes[x] = len(codes)
                found.append(np.fromiter(map(codes.__getitem__, row), np.int64, len(row)))
                keys.append(key)
                sizes.append(len(text.encode()))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(keys) >= BLOCK_DOCS:
                    yield from flush()
                    number += 1
                    codes, found, keys, sizes, chars = {}, [], [], [], 0
        if keys:
            yield from flush()

    return invert


def _sums(path: str):
    """Rows of pre-tokens, all of one pre-token in one partition, to packed sums of tokens by (block, document)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = special_strings(path)
        known = dict.fromkeys(special, 1)
        totals: dict[int, tuple[list, list]] = {}
        held = 0
        names = ["block", "keys", "sizes", "docs", "sums"]

        def flush(keys: pa.DataType, sizes: pa.DataType) -> Iterator[pa.RecordBatch]:
            for block, (docs, sums) in totals.items():
                which, where = np.unique(np.concatenate(docs), return_inverse=True)
                total = np.bincount(where, weights=np.concatenate(sums)).astype("<i8")
                packed = [pa.array([which.astype("<u2").tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, keys), pa.nulls(1, sizes), *packed], names)
            totals.clear()

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(1).type, batch.schema.field(2).type
            heads = batch.filter(batch.column(3).is_null())
            if len(heads):
                yield pa.RecordBatch.from_arrays([*heads.columns[:3], pa.nulls(len(heads), pa.binary()), pa.nulls(len(heads), pa.binary())], names)
            batch = batch.filter(batch.column(3).is_valid())
            blocks, texts = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            fresh = list(set(texts).difference(known))
            if len(known) + len(fresh) > REMEMBERED:
                known = dict.fromkeys(special, 1)
                fresh = list(set(texts).difference(known))
            known.update(zip(fresh, count_pieces(path, fresh), strict=True))
            for block, text, docs, times in zip(blocks, texts, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                into = totals.setdefault(block, ([], []))
                into[0].append(np.frombuffer(docs, "<u2"))
                into[1].append(np.frombuffer(times, "<u2").astype(np.int64) * known[text])
            held += len(texts)
            if held > HELD_ROWS:
                yield from flush(*kinds)
                held = 0
        if kinds:
            yield from flush(*kinds)

    return add


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums in order of their blocks, all of a block in one partition, to one row per document."""
    block, head, have = None, None, np.zeros(0, np.int64)

    def ended() -> Iterator[pa.RecordBatch]:
        if head:
            total = np.zeros(len(head[0]), np.int64)
            total[: min(len(have), len(total))] = have[: len(total)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(total)], ["key", "n_bytes", "n_tokens"])

    for batch in batches:
        for k, now in enumerate(batch.column(0).to_pylist()):
            if now != block:
                yield from ended()
                block, head, have = now, None, np.zeros(0, np.int64)
            if batch.column(1)[k].is_valid:
                head = batch.column(1)[k].values, batch.column(2)[k].values
                continue
            docs, more = np.frombuffer(batch.column(3)[k].as_py(), "<u2").astype(np.int64), np.frombuffer(batch.column(4)[k].as_py(), "<i8")
            if len(have) <= docs[-1]:
                have = np.append(have, np.zeros(max(docs[-1] + 1, 2 * len(have)) - len(have), np.int64))
            have[docs] += more
    yield from ended()


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and n_tokens of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()
    parts = parallelism(docs.sparkSession)
    groups = max(1, parts // GROUP_TASKS)
    narrow = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    rows = in_arrow(narrow, _inverted(path, pattern), f"block long, keys array<{kind}>, sizes array<long>, pretoken string, docs binary, times binary")
    within = F.pmod(F.xxhash64(F.coalesce("pretoken", F.col("block").cast("string"))), F.lit(parts // groups))
    task = F.pmod(F.xxhash64("block"), F.lit(groups)) * (parts // groups) + within
    sums = in_arrow(rows.repartitionById(parts, task.cast("int")), _sums(path), f"block long, keys array<{kind}>, sizes array<long>, docs binary, sums binary")
    out = in_arrow(sums.repartition(parts, "block").sortWithinPartitions("block"), _gathered, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens")
