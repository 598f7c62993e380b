"""Byte-level BPE encoding and decoding through a sentencepiece model serialised straight from the vocabulary.

The ranks of a byte-level vocabulary become a sentencepiece BPE model without any training: each byte string is spelled
with 256 printable stand-in characters, its score is its negative rank, and normalisation is the identity. Every
pre-token is encoded on its own; ids decode through the inverse mapping to the very bytes of the text.

Cases: a null text counts as empty; an empty text has no ids; repeated rows repeat; an empty table gives an empty table;
other columns of the input are never looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, quoted
from .pretokens import splitter

#: Distinct pre-tokens whose ids a task remembers before it starts afresh.
REMEMBERED = 100_000
#: Characters of the texts that are cut into pre-tokens together, about.
TOGETHER = 500_000


def stand_ins() -> list[str]:
    """A character for each byte: printable ones stand for themselves, the rest follow U+0100 in order of the byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited, by the value's type."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto with one piece per rank, after the mandatory unknown piece with id 0."""
    spell = stand_ins()
    # Fixed values of sentencepiece's model format: SentencePiece piece 1, score 2, type 3 (2 is unknown);
    # ModelProto pieces 1, trainer_spec 2, normalizer_spec 3; TrainerSpec model_type 3 (2 is BPE), vocab_size 4;
    # NormalizerSpec name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5.
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, _field(1, "".join(map(spell.__getitem__, raw)).encode()) + _field(2, -float(rank))))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder for the ranks of one vocabulary file."""

    def __init__(self, vocabulary: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(vocabulary)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        self._rank_of_piece = np.array([0, *(rank for _, rank in ordered)], dtype="<u4")
        self._bytes_of = {rank: raw for raw, rank in ordered}
        self._spell = dict(enumerate(stand_ins()))
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self._split = splitter(pattern)
        self._known: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        """Encode pre-tokens not seen before; their ids are kept as little-endian 32-bit integers."""
        known, ranks, odd, spelled = self._known, self.ranks, [], []
        for token in fresh:
            raw = token.encode()
            if raw in ranks:  # an entry of the vocabulary is one token, whatever merges would lead to it
                known[token] = struct.pack("<I", ranks[raw])
            else:
                odd.append(token)
                spelled.append(raw.decode("latin-1").translate(self._spell))
        pieces = self._model.encode(spelled, num_threads=1)
        ids = self._rank_of_piece[np.fromiter(chain.from_iterable(pieces), np.int64)].tobytes()
        end = 0
        for token, own in zip(odd, pieces, strict=True):
            start, end = end, end + 4 * len(own)
            known[token] = ids[start:end]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        rows: list[list[str]] = []
        chars = 0
        for k, text in enumerate(texts):
            rows.append(self._split(text or ""))
            chars += len(text or "")
            if chars >= TOGETHER or k + 1 == len(texts):
                out += self._joined(rows)
                rows, chars = [], 0
        return out

    def _joined(self, rows: list[list[str]]) -> list[bytes]:
        known = self._known
        fresh = set().union(*rows).difference(known)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = set().union(*rows)
        self._learn(list(fresh))
        return [b"".join([known[x] for x in row]) for row in rows]

    def forget(self) -> None:
        """Let go of the pre-tokens seen so far."""
        self._known.clear()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self._bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def codec(vocabulary: str, pattern: str) -> ByteBpe:
    """One codec for each worker process and vocabulary."""
    return ByteBpe(vocabulary, pattern)


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, 4 bytes each) of every row's whole text."""
    kind = docs.schema[key].dataType
    narrow = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        try:
            for batch in batches:
                rows = bpe.encode(batch.column(1).to_pylist())
                columns = [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in rows], pa.string()),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(rows, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            bpe.forget()  # the codec outlives the task in its worker

    schema = f"{quoted(key)} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return in_arrow(narrow, encode, schema)
