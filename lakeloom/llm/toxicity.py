"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained jointly in numpy.

A word is a bag of its character n-grams (with marks at both ends) and of itself, hashed into BUCKETS rows of an
embedding table; its vector is their mean, so a misspelling never seen in training shares most of its rows with the
word it distorts. The vectors of WINDOW words in a row are averaged and go through a linear softmax; a document is as
toxic as its worst window, so one insult in a long text isn't averaged away. Training alternates between picking each
document's worst window under the current model and a gradient step on embeddings and softmax together; the final slope
and offset of the score are fitted on the same documents.

The classifier is fitted on the driver on a bounded sample: at most SAMPLE_ROWS labelled documents of each class, in
order of a hash of their text, and SAMPLE_CHARS characters in all; texts that don't fit are passed over. Scoring takes every word of every text: since
average and softmax layer are linear, a word contributes one number, computed once per distinct word of a task.

Cases: a null or empty text, or one without words, has the score of an empty window, which is below that of any
training document's; equal texts get equal scores; several labels of one document count as toxic if any is; labels that
are null are ignored; without labels of both classes every score is 0; an empty table gives an empty table; other
columns of the input are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, quoted

BUCKETS = 1 << 16
DIMENSIONS = 8
WINDOW = 2
#: Characters of a word; longer ones are taken as runs that overlap by half.
MOST_CHARS = 40
#: Words whose numbers a task remembers before it starts afresh.
REMEMBERED = 100_000
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 5_000_000
#: Rounds of picking windows, gradient steps in each, and their rate.
ROUNDS, STEPS, RATE = 8, 15, 0.1
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The words of a text; one longer than MOST_CHARS, as in scripts without spaces, as overlapping runs of that length."""
    words = _WORD.findall((text or "").lower())
    if not words or len(max(words, key=len)) <= MOST_CHARS:
        return words
    return [w[k : k + MOST_CHARS] for w in words for k in range(0, max(1, len(w) - MOST_CHARS // 2), MOST_CHARS // 2)]


def subwords(word: str) -> list[int]:
    """Rows of the embedding table: of the word itself and of its n-grams of 3 to 5 characters, with end marks."""
    marked = f"<{word}>"
    grams = [marked, *(marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1))]
    return [zlib.crc32(x.encode()) % BUCKETS for x in grams]


@dataclass
class Model:
    """What scoring needs: each embedding row seen through the softmax layer, its offset, and the final slope and offset."""

    rows: list[float]
    offset: float
    slope: float
    shift: float

    def word(self, word: str) -> float:
        own = subwords(word)
        return sum(map(self.rows.__getitem__, own)) / len(own)

    def logit(self, scores: np.ndarray) -> float:
        """Of the worst window; a text shorter than a window is one window, an empty one counts as a harmless word."""
        if not len(scores):
            return self.offset + min(self.rows)
        if len(scores) <= WINDOW:
            return self.offset + float(scores.sum()) / WINDOW
        sums = np.cumsum(scores)
        return self.offset + float(max(sums[WINDOW - 1], (sums[WINDOW:] - sums[:-WINDOW]).max())) / WINDOW

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40))))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Train on whole texts; without both classes, the model that scores 0 everywhere."""
    y = np.array(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        return Model([0.0] * BUCKETS, 0.0, 0.0, -40.0)
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
    keep = [k for k, d in enumerate(docs) if len(d)]
    docs, y = [docs[k] for k in keep], y[keep] > 0
    if y.all() or not y.any():
        return Model([0.0] * BUCKETS, 0.0, 0.0, -40.0)
    bags = [subwords(w) for w in index]
    sizes = np.array([len(x) for x in bags])
    flat = np.concatenate([np.array(x) for x in bags])
    starts = np.cumsum(sizes) - sizes
    every, length = np.concatenate(docs), np.array([len(d) for d in docs])
    begin = np.cumsum(length) - length
    doc_of = np.repeat(np.arange(len(docs)), length)
    # A window starts at each word and stays inside its document; a document shorter than a window has one.
    window_at = np.flatnonzero(np.arange(len(every)) <= (begin + np.maximum(length - WINDOW, 0))[doc_of])
    window_of = doc_of[window_at]
    first_window = np.searchsorted(window_of, np.arange(len(docs)))
    reach = np.minimum(WINDOW, length)[window_of]

    def worst(scores: np.ndarray) -> np.ndarray:
        """The window of each document with the largest sum of scores."""
        sums = np.append(0.0, np.cumsum(scores[every]))
        sums = sums[window_at + reach] - sums[window_at]
        at = np.flatnonzero(sums == np.maximum.reduceat(sums, first_window)[window_of])
        return at[np.unique(window_of[at], return_index=True)[1]]

    pair = np.unique(doc_of * len(index) + every)
    seen = [np.bincount(pair[y[pair // len(index)] == k] % len(index), minlength=len(index)) for k in (True, False)]
    scores = np.log((seen[0] + 1) / (y.sum() + 2)) - np.log((seen[1] + 1) / ((~y).sum() + 2))  # only to pick the first windows
    embed, layer, offset = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (embed, layer, offset)]
    pool, step = np.zeros(0, np.int64), 0
    clean_low, clean_high = first_window[~y], np.append(first_window[1:], len(window_at))[~y]
    for _ in range(ROUNDS):
        now = worst(scores)
        pool = np.unique(np.concatenate([pool, now[~y], rng.integers(clean_low, clean_high)]))  # clean windows stay once they have misled
        chosen = np.concatenate([now[y], pool])
        label = y[window_of[chosen]].astype(int)
        weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (label == 0).sum())
        of = np.repeat(np.arange(len(chosen)), reach[chosen])
        token = every[np.repeat(window_at[chosen], reach[chosen]) + np.arange(len(of)) - np.repeat(np.cumsum(reach[chosen]) - reach[chosen], reach[chosen])]
        words, token = np.unique(token, return_inverse=True)
        n_rows = sizes[words]
        row_at = np.cumsum(n_rows) - n_rows
        owner = np.repeat(np.arange(len(words)), n_rows)
        rows = flat[np.repeat(starts[words], n_rows) + np.arange(n_rows.sum()) - np.repeat(row_at, n_rows)]
        for _ in range(STEPS):
            step += 1
            vectors = np.add.reduceat(embed[rows], row_at) / n_rows[:, None]
            mean = np.stack([np.bincount(of, vectors[token, d], len(chosen)) for d in range(DIMENSIONS)], axis=1) / WINDOW
            logits = mean @ layer + offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), label] -= 1
            p *= weight[:, None]
            back = p @ layer.T / WINDOW
            per_word = np.stack([np.bincount(token, back[of, d], len(words)) for d in range(DIMENSIONS)], axis=1) / n_rows[:, None]
            grads = [np.stack([np.bincount(rows, per_word[owner, d], BUCKETS) for d in range(DIMENSIONS)], axis=1), mean.T @ p, p.sum(axis=0)]
            for x, g, (m, v) in zip((embed, layer, offset), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        scores = np.add.reduceat((embed @ (layer[:, 1] - layer[:, 0]))[flat], starts) / sizes
    used = np.bincount(flat, minlength=BUCKETS) > 0  # a row that no training word uses says nothing
    model = Model(np.where(used, embed @ (layer[:, 1] - layer[:, 0]), 0.0).tolist(), float(offset[1] - offset[0]), 1.0, 0.0)
    known = np.array([model.word(x) for x in index])
    z = np.array([model.logit(known[d]) for d in docs])
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    scale = max(z.std(), 1e-6)
    a, b = 1.0 / scale, -z.mean() / scale
    for _ in range(500):  # logistic regression on one number, each class weighing half
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        e = (q - (0.02 + 0.96 * y)) * weight
        a, b = a - 5 * (e * z).sum() / scale**2, b - 5 * e.sum()
    # The score of the cut that errs least on these documents, midway between its neighbours, becomes THRESHOLD.
    order = np.argsort(-z, kind="stable")
    wrong = y.sum() - np.cumsum(y[order]) + np.cumsum(~y[order])
    k = int(np.argmin(wrong))
    cut = (z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2
    model.slope = float(max(a, 0.1))
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * cut)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Whole texts of a bounded sample of labelled documents: in order of a hash, up to rows of each class and chars in all."""
    marks = labels.select(labels["doc_id"].alias("key"), labels["toxic"].alias("toxic")).where("key is not null and toxic is not null")
    marks = marks.groupBy("key").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(docs["doc_id"].alias("key"), docs["text"].cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    if allowed is not None:
        marks = marks.where(allowed)
    sized = texts.select("key", "h", F.length("text").alias("n")).join(marks, "key").groupBy("h", "n").agg(F.max("toxic").alias("toxic"))  # texts stay where they are
    label: dict[int, int] = {}
    for sign in (">", "="):
        room = chars // 2
        for x in sized.where(f"toxic {sign} 0 and n <= {room}").orderBy("h", "n").limit(rows).collect():
            if x["n"] > room:
                continue  # a shorter one may fit
            room -= x["n"]
            label[x["h"]] = int(x["toxic"] > 0)
    if not label:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(x,) for x in label], "h long")  # at most 2 * rows
    out = sorted((x["h"], x["text"]) for x in texts.join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text")).collect())
    return [x[1] for x in out], [label[x[0]] for x in out]


def _score(model: Model, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                row = words_of(text)
                for w in set(row).difference(known):
                    known[w] = model.word(w)
                out.append(model.probability(model.logit(np.fromiter(map(known.__getitem__, row), float, len(row)))))
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names)

    return score


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score of every row."""
    narrow = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    return in_arrow(narrow, _score(model, [key, "score"]), f"{quoted(key)} {docs.schema[key].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            (scores,) = _score(model, ["score"])(iter([texts]))
            yield batch.filter(pa.array(np.asarray(scores.column(0)) < threshold))

    return in_arrow(docs, keep, docs.schema)


def remainder(key: Column) -> Column:
    """crc32 of the key as text, modulo 3."""
    return F.crc32(key.cast("string")) % 3
