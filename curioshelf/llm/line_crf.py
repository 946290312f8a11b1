"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  What speaks for either is the line's own make-up (symbols, capitals,
repeated words and the like) and that of the lines before and after it; the chain adds how likely a
good line follows a bad one, and so on.  Forward and backward sums give each line's chance of being
good.  Their mean, weighted by the lines' lengths, is the document's quality, which one logistic
curve turns into a calibrated score.

Only documents are labelled; in training a document's lines all carry its label.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curioshelf.llm.shingles import chunks, slices, word_hashes

TRAINING_ROWS = 6_000
THRESHOLD = 0.3
ROUNDS = 200

_CLASSES = [
    b"#$%&*|@^~<>{}[]\\/=+_",
    b"!?",
    b".,;:",
    b"0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    bytes(range(128, 256)),
    b" \t\r",
]
_TABLE = np.array([[i in c for i in range(256)] for c in _CLASSES])
_OWN = 13
_NEIGHBOURS = [1, 2, 4, 7, 8]
WIDTH = _OWN + 2 * len(_NEIGHBOURS) + 2


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features, for good against bad
    follow: np.ndarray  # [from, to], 1 is good
    curve: tuple[float, float]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, bytes of each line, features of each line) of all texts.

    A text has a line more than line feeds; an empty text has one empty line."""
    counts, lengths, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, WIDTH))]
    for _, _, data, offsets in chunks(texts):
        feeds = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
        number = np.diff(np.searchsorted(feeds, offsets)) + 1
        first = np.zeros(len(starts), bool)
        first[np.cumsum(number) - number] = True
        last = np.concatenate((first[1:], [True]))
        ends = np.concatenate((starts[1:], [len(data)])) - ~last
        size = ends - starts
        sums = np.concatenate((np.zeros((len(_CLASSES), 1), np.int64), np.cumsum(_TABLE[:, data], axis=1)), axis=1)
        share = (sums[:, ends] - sums[:, starts]).T / np.maximum(size, 1)[:, None]
        words, _, at, _, _ = word_hashes(data, offsets)
        line = np.searchsorted(starts, at, "right") - 1
        total = np.bincount(line, minlength=len(starts))
        again = np.concatenate(([False], (words[1:] == words[:-1]) & (line[1:] == line[:-1])))[: len(words)]
        order = np.lexsort((words, line))
        w, n = words[order], line[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (n[1:] != n[:-1])))[: len(words)]
        kinds = np.bincount(n[new], minlength=len(starts))
        some = np.maximum(total, 1)
        symbols, marks, stops, digits, upper, lower, high, _ = share.T
        own = np.stack(
            [
                np.log1p(size),
                np.sqrt(symbols),
                np.sqrt(marks),
                stops,
                upper / np.maximum(upper + lower, 0.01),
                np.sqrt(digits),
                high,
                np.bincount(line, weights=again, minlength=len(starts)) / some,
                1 - kinds / some,
                size / some / 10,
                np.log1p(total),
                total == 0,
                total > 40,
            ],
            axis=1,
        )
        own[:, 9] = np.minimum(own[:, 9], 5)
        near = own[:, _NEIGHBOURS]
        before = np.concatenate((np.zeros((1, near.shape[1])), near[:-1])) * ~first[:, None]
        after = np.concatenate((near[1:], np.zeros((1, near.shape[1])))) * ~last[:, None]
        counts.append(number)
        lengths.append(size)
        features.append(np.concatenate((own, before, after, first[:, None], last[:, None]), axis=1))
    return np.concatenate(counts), np.concatenate(lengths), np.concatenate(features)


def forward_backward(pull: np.ndarray, counts: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of good for each line, expected number of steps [from, to] in all).

    pull: each line's evidence for good, as log odds.  The chains of all documents are walked side by
    side, longest first."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    good = 1 / (1 + np.exp(-np.clip(pull, -30, 30)))
    fit = np.stack((1 - good, good), axis=1)
    step = np.exp(follow - follow.max())
    ahead, back, scale = np.empty_like(fit), np.ones_like(fit), np.ones(len(fit))
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = starts[order[: going[t]]] + t
        a = fit[at] if t == 0 else fit[at] * (ahead[at - 1] @ step)
        scale[at] = a.sum(1)
        ahead[at] = a / scale[at][:, None]
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = starts[order[: going[t]]] + t
        part = fit[at] * back[at] / scale[at][:, None]
        back[at - 1] = part @ step.T
        expected += step * (ahead[at - 1].T @ part)
    both = ahead * back
    return both[:, 1] / both.sum(1), expected


def _mean(chance: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Chance of good weighted by length, for each text with any line."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(chance * lengths, starts) / np.maximum(np.add.reduceat(lengths, starts), 1) if len(counts) else np.zeros(0)


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-6, 1 - 1e-6)
    return np.log(x / (1 - x))


def fit(counts: np.ndarray, lengths: np.ndarray, features: np.ndarray, labels: np.ndarray) -> Model:
    """Conditional likelihood by gradient steps, then the curve on the weighted means."""
    mean, spread = features.mean(0), features.std(0) + 1e-6
    x = np.concatenate(((features - mean) / spread, np.ones((len(features), 1))), axis=1)
    y = np.repeat(labels.astype(float), counts)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (counts[labels == label] - 1).sum()
    weights, follow = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(follow), np.zeros_like(weights), np.zeros_like(follow)]
    for n in range(1, ROUNDS + 1):
        chance, expected = forward_backward(x @ weights, counts, follow)
        slopes = [x.T @ (y - chance) / len(x) - 1e-3 * weights, (seen - expected) / len(x) - 1e-2 * follow]
        for k, (value, slope) in enumerate(zip((weights, follow), slopes, strict=True)):
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * slope**2
            value += 0.1 * (moments[k] / (1 - 0.9**n)) / (np.sqrt(moments[k + 2] / (1 - 0.99**n)) + 1e-8)
    z = _logit(_mean(forward_backward(x @ weights, counts, follow)[0], lengths, counts))
    a, b = 1.0, 0.0
    for _ in range(2000):
        error = 1 / (1 + np.exp(-(a * z + b))) - labels
        a, b = a - 0.05 * float((error * z).mean()), b - 0.2 * float(error.mean())
    return Model(mean, spread, weights, follow, (a, b))


def scores_of(model: Model, texts: pa.Array) -> np.ndarray:
    counts, lengths, features = line_features(texts)
    pull = (features - model.mean) / model.spread @ model.weights[:-1] + model.weights[-1]
    chance, _ = forward_backward(pull, counts, model.follow)
    score = 1 / (1 + np.exp(-(model.curve[0] * _logit(_mean(chance, lengths, counts)) + model.curve[1])))
    starts = np.cumsum(counts) - counts
    words = np.add.reduceat(features[:, 10], starts) if len(counts) else np.zeros(0)
    return np.where(words > 0, score, 0.0)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, lengths, features = line_features(batch.column(0))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        packed = lambda a, k: pa.array([a[i:j].astype(k).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(1), packed(lengths, np.int64), packed(features, np.float32)], ["quality", "lengths", "features"])


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Model from ``documents`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    At most TRAINING_ROWS labelled documents are used, taken by hash of doc_id, with all their lines.
    Labels with nulls are left out; of several labels of a document the lowest counts.  Without
    labels of both classes there is no model (None)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    sample = documents.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", "quality")
    rows = sample.mapInArrow(_samples, "quality int, lengths binary, features binary").collect()
    quality = np.array([r["quality"] for r in rows])
    if len(set(quality.tolist())) < 2:
        return None
    lengths = [np.frombuffer(r["lengths"], np.int64) for r in rows]
    features = np.concatenate([np.frombuffer(r["features"], np.float32) for r in rows]).reshape(-1, WIDTH).astype(float)
    return fit(np.array([len(x) for x in lengths]), np.concatenate(lengths), features, quality)


def score(documents: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row of ``documents`` and quality_score: the chance that its quality is 1.

    Null texts, empty ones and those without a word score 0; without a model every other text scores
    1.  Repeated rows are scored each, other columns are not looked at."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            if model is None:
                found = np.array([float(bool(t and t.strip())) for t in texts.to_pylist()])
            else:
                found = scores_of(model, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "quality_score"])

    given = documents.select(*columns, F.col("text").alias("scored_text"))
    schema = T.StructType([*documents.select(*columns).schema.fields, T.StructField("quality_score", T.DoubleType())])
    return given.mapInArrow(run, schema)
