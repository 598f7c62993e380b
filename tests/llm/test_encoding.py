"""Byte-level BPE, token counts and media against the libraries and plain recomputation."""

import base64
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakeloom.llm import byte_bpe, media, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(docs, texts, library):
    want = dict(texts)
    rows = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = want[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_random_strings(library):
    rng, codec = random.Random(5), byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    parts = ["a", "'s", "'", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "²", "字", "\U0001f600", "_", "​", "12", "\t", "\x00", "▁", "<unk>", "<|endoftext|>", "ß", "́"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(2000)]
    for text, ids in zip(samples, codec.encode(samples), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_token_counts_equal_library(docs, texts):
    t, want = Tokenizer.from_file(COUNTED), dict(texts)
    rows = token_counts.token_counts(docs, COUNTED, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = want[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids))


def test_token_counts_of_many_special_strings(spark):
    text = "one <|endoftext|>" * 5000
    want = len(Tokenizer.from_file(COUNTED).encode(text, add_special_tokens=False).ids)
    assert token_counts.token_counts(spark.createDataFrame([(0, text)], "doc_id long, text string"), COUNTED, public_tokenizers.PATTERN).head().n_tokens == want


def test_token_counts_in_small_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 2)
    assert token_counts.token_counts(docs.coalesce(1), COUNTED, public_tokenizers.PATTERN).count() == len(texts) + 2


def test_token_counts_of_a_frequent_pretoken(spark):
    rows = spark.createDataFrame([(0, " xyzzy" * 150_001), (1, " xyzzy b")], "doc_id long, text string")
    t = Tokenizer.from_file(COUNTED)
    want = {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in ((0, " xyzzy" * 150_001), (1, " xyzzy b"))}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, COUNTED, public_tokenizers.PATTERN).collect()} == want


def test_media_round_trip(docs, texts):
    want = dict(texts)
    rows = media.read_media(media.with_media(docs)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        raw = (want[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.feature) == 16
    by_text = {want[r.doc_id]: (r.media_sha256, r.feature) for r in rows}
    assert all(by_text[want[r.doc_id]] == (r.media_sha256, r.feature) for r in rows)


def plain_feature(raw):
    """The hash by definition: a 32 x 32 shrunk image, its 8 x 8 lowest frequencies as sums of cosines, signs against their median."""
    rows = [raw[k : k + 192] for k in range(0, len(raw), 192)]
    tall = rows if len(rows) >= 32 else [rows[k * len(rows) // 32] for k in range(32)]
    cuts = [k * len(tall) // 32 for k in range(33)]
    small = [[sum(tall[y][x] for y in range(cuts[i], cuts[i + 1]) for x in range(6 * j, 6 * j + 6)) / (cuts[i + 1] - cuts[i]) for j in range(32)] for i in range(32)]
    wave = lambda u, k: math.cos(math.pi / 32 * (k + 0.5) * u)
    low = [round(sum(small[i][j] * wave(u, i) * wave(v, j) for i in range(32) for j in range(32)), 3) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('01'[x > middle] for x in low), 2):016x}"


def test_features_by_definition():
    rng = random.Random(6)
    for size in (1, 191, 192, 5000, 192 * 32, 9001):
        raw = media.padded(bytes(rng.choice(b"abc defgh.,\n") for _ in range(size)))
        assert media.low_frequency_hash(media.samples(media.png(raw))) == plain_feature(raw)


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (5, 7), dtype=np.uint8).astype(int)
    lines = []
    for y in range(5):
        line = []
        for x in range(7):
            a, b, c = (rows[y, x - 1] if x else 0), (rows[y - 1, x] if y else 0), (rows[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            best = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            line.append((rows[y, x] - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        lines.append(bytes([kind, *line]))
    image = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.samples(image) == rows).all()


def test_damaged_images_are_refused():
    image = bytearray(media.png(b"x" * 192))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.samples(bytes(image))
    with pytest.raises(ValueError):
        media.samples(b"nothing")


def test_empty_tables(empty):
    assert byte_bpe.encoded(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.token_counts(empty, COUNTED, public_tokenizers.PATTERN).count() == 0
    assert media.read_media(media.with_media(empty)).count() == 0
