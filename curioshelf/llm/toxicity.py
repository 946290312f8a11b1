"""Toxicity by weak supervision.

1. Lexicons are read off labelled documents: words and word beginnings that stand out in toxic ones.
2. Voters vote on each document: parts of the lexicons, a short list of common insults, patterns.
3. A generative label model, fitted by expectation maximisation, estimates how often each voter votes
   how, given the hidden class.  Voters that agree beyond that are correlated; each counts for the
   less, the more others repeat it.  Its posteriors are soft labels.
4. A linear classifier is trained on them; it sees lexicon terms and patterns, not the votes.

Labels serve the lexicons and the expected share of toxic documents, from a bounded sample.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curioshelf.llm.shingles import LETTERS, chunks, mix, slices, word_hashes

TRAINING_ROWS = 16_000
LEAST_DOCUMENTS = 3
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3

# Common insults in the languages of the corpus.
INSULTS = """
idiot moron stupid loser trash scum pathetic disgusting worthless clown fool dumb jerk creep
idiote imbecile stupide ordure minable degueulasse salaud connard
idiota estupido basura escoria patetico asqueroso imbecil
idiotisch dumm abschaum widerlich wertlos trottel versager
""".split()
_PATTERNS = [re.compile(p) for p in (r"!{2,}", r"\b[A-Z]{4,}\b", r"\?{2,}", r"(?i)\b(?:shut up|go away|get lost|hate you|such an?|you are an?|only \w+ from)\b")]
VOTERS = 16
NEAR = 0.6


@dataclass
class Model:
    """Everything a task needs to score a text; of bounded size."""

    terms: np.ndarray  # sorted hashes, no more than the labelled sample has words
    weights: np.ndarray  # of the terms, then of the patterns
    intercept: float


def _hashes(words: Iterable[str]) -> np.ndarray:
    return np.sort(np.concatenate([word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), LETTERS)[0] for w in words]))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and each beginning of a longer word, kinds told apart."""
    words, bounds, starts, ends, heads = word_hashes(data, offsets, LETTERS, PREFIXES)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    longer = [ends - starts > p for p in PREFIXES]
    hashes = [words, *(mix(h[keep] + np.uint64(k + 1)) for k, (h, keep) in enumerate(zip(heads, longer, strict=True)))]
    return np.concatenate([rows, *(rows[keep] for keep in longer)]), np.concatenate(hashes)


def _lexicon_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to (term, toxic documents, other documents), per batch."""
    for batch in slices(batches):
        toxic = np.array(batch.column(1).to_pylist(), bool)
        for at, rows, data, offsets in chunks(batch.column(0)):
            row, term = _terms(data, offsets)
            order = np.lexsort((row, term))
            row, term = row[order], term[order]
            once = np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))[: len(term)]
            names, index = np.unique(term[once], return_inverse=True)
            bad = np.bincount(index, weights=toxic[at : at + rows][row[once]], minlength=len(names)).astype(np.int64)
            everything = np.bincount(index, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(everything - bad)], ["term", "bad", "good"])


def _found(texts: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows: first row, then the row, the place in ``terms`` and the count of each term."""
    for at, rows, data, offsets in chunks(texts):
        row, term = _terms(data, offsets)
        if len(terms):
            place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            keep = terms[place] == term
            key, count = np.unique(row[keep] * len(terms) + place[keep], return_counts=True)
            yield at, key // len(terms), key % len(terms), count
        else:
            yield at, *(np.zeros(0, np.int64),) * 3


def _patterns(texts: list) -> np.ndarray:
    """Matches of each pattern per 1,000 characters, on a logarithmic scale."""
    out = np.zeros((len(texts), len(_PATTERNS)))
    for n, text in enumerate(texts):
        if text:
            for k, p in enumerate(_PATTERNS):
                out[n, k] = sum(1 for _ in p.finditer(text)) * 1000 / (len(text) + 200)
    return np.log1p(out)


def _training_rows(terms: np.ndarray):
    def run(batches):
        for batch in slices(batches):
            texts = batch.column(0)
            places, counts = [[] for _ in texts], [[] for _ in texts]
            for at, row, place, count in _found(texts, terms):
                for r, p, c in zip(row.tolist(), place.tolist(), count.tolist(), strict=True):
                    places[at + r].append(p)
                    counts[at + r].append(c)
            pattern = _patterns(texts.to_pylist()).tolist()
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
            arrays = [pa.array(x, k) for x, k in zip((places, counts, pattern), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], ["toxic", "places", "counts", "patterns"])

    return run


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for rows of ``votes`` (1, 0, or -1 to abstain), the accuracy table
    [class, voter, vote] and the weight of each voter.

    Expectation maximisation of a model in which voters are independent given the class but for
    their correlations: a voter's weight is the inverse of one plus its correlations with others.
    These are first what of their plain correlation is beyond NEAR, as for voters that repeat each
    other, then also what is left of it within the classes.  ``prior`` is the expected share of
    class 1.
    """
    signed = np.where(votes == 1, 1.0, np.where(votes == 0, -1.0, 0.0))

    def correlation(rows: np.ndarray) -> np.ndarray:
        spread = np.sqrt((rows**2).sum(0)) + 1e-9
        found = np.clip(rows.T @ rows / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(found, 0)
        return found

    beyond = np.maximum(0, correlation(signed - signed.mean(0)) - NEAR) / (1 - NEAR)
    weights = 1 / (1 + beyond.sum(1))
    said = (votes == 1).sum(1) + 0.0
    against = (votes == 0).sum(1)
    p = np.where(said + against > 0, (said + prior) / (said + against + 1), prior)
    onehot = np.stack([votes == v for v in (1, 0, -1)], axis=2).astype(float)
    for stage in range(2):
        for _ in range(rounds):
            both = np.stack((1 - p, p))
            table = np.einsum("cn,nvk->cvk", both, onehot) + np.array([0.5, 0.5, 0.5])
            table /= table.sum(2, keepdims=True)
            # A vote never counts against what it says.
            table[1, :, 0] = np.maximum(table[1, :, 0], table[0, :, 0])
            share = np.clip(p.mean(), prior / 4, min(0.9, prior * 4))
            logit = np.log(share / (1 - share)) + np.einsum("nvk,v,vk->n", onehot, weights, np.log(table[1] / table[0]))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if stage == 0:
            rest = [(signed - np.average(signed, axis=0, weights=w + 1e-9)) * np.sqrt(w)[:, None] for w in (p, 1 - p)]
            weights = 1 / (1 + np.maximum(beyond, correlation(np.concatenate(rest))).sum(1))
    return p, table, weights


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, target: np.ndarray, width: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets; sparse entries (row, column, value) and dense columns."""
    n = len(target)
    w, b = np.zeros(width + dense.shape[1]), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    seen = np.concatenate((np.bincount(columns, weights=values**2, minlength=width), (dense**2).sum(0))) + 1.0
    step = n / seen  # larger steps for rare columns
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = np.bincount(rows, weights=values * w[columns], minlength=n) + dense @ w[width:] + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.concatenate((np.bincount(columns, weights=values * error[rows], minlength=width), dense.T @ error)) / n + 1e-5 * w
        speed = 0.8 * speed - 0.2 * np.minimum(step, 40) * slope
        w += speed
        b -= 0.5 * error.mean()
    return w, b


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Lexicons and classifier come from at most TRAINING_ROWS labelled documents, taken by hash of
    doc_id.  Labels with nulls are left out; of several labels of a document the highest counts.
    Without labels of both classes the model finds nothing toxic."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    sample = documents.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", "toxic")
    counts = sample.mapInArrow(_lexicon_counts, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    shares = bounded.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, n = int(shares["bad"] or 0), int(shares["n"])
    if not bad or bad == n:
        return Model(np.zeros(0, np.uint64), np.zeros(len(_PATTERNS)), -4.0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (n - bad + 1))
    chosen = counts.where(f"bad >= {LEAST_DOCUMENTS}").withColumn("odds", odds).where("odds > 2.5 and bad >= 4 * good")
    # Every term that passes counts; TRAINING_ROWS bounds how many there can be.
    learned = np.array([r["term"] for r in chosen.select("term").collect()], np.int64).view(np.uint64)
    insults = _hashes(INSULTS)
    terms = np.unique(np.concatenate((learned, insults)))

    rows = sample.mapInArrow(_training_rows(terms), "toxic int, places array<int>, counts array<int>, patterns array<double>").collect()
    if not rows:  # labels, but of none of these documents
        return Model(np.zeros(0, np.uint64), np.zeros(len(_PATTERNS)), -4.0)
    lengths = [len(r["places"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    place = np.array([p for r in rows for p in r["places"]], np.int64)
    value = np.log1p(np.array([c for r in rows for c in r["counts"]], float))
    dense = np.array([r["patterns"] for r in rows]).reshape(len(rows), -1)

    # Voters: the insults, parts of the learned lexicon by hash, patterns, and one for their absence.
    part = np.where(np.isin(terms, insults), 0, 1 + (mix(terms) % np.uint64(VOTERS)).astype(np.int64))
    hits = np.zeros((len(rows), VOTERS + 1))
    np.add.at(hits, (row, part[place]), 1)
    votes = np.where(hits > 0, 1, -1)
    high = dense > np.quantile(dense, 0.98, axis=0) + 1e-9
    votes = np.concatenate((votes, np.where(high, 1, -1), np.where(hits.sum(1) == 0, 0, -1)[:, None]), axis=1)
    posterior, _, _ = label_model(votes, bad / n)
    weights, intercept = fit_linear(row, place, value, dense, posterior, len(terms))
    return Model(terms, weights, intercept)


def _scores(model: Model):
    width = len(model.terms)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            z = _patterns(texts.to_pylist()) @ model.weights[width:] + model.intercept
            for at, row, place, count in _found(texts, model.terms):
                np.add.at(z, at + row, np.log1p(count) * model.weights[place])
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], [*batch.schema.names[:-1], "toxicity_score"])

    return run


def score(documents: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row of ``documents`` and toxicity_score: the chance that its text is toxic.

    Null and empty texts score low, each repeated row is scored, other columns are not looked at."""
    given = documents.select(*columns, F.col("text").alias("scored_text"))
    schema = T.StructType([*documents.select(*columns).schema.fields, T.StructField("toxicity_score", T.DoubleType())])
    return given.mapInArrow(_scores(model), schema)
