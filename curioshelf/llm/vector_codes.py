"""Compact codes of vectors, learned exactly in whole numbers, with fixed pivots to save distances.

Vectors are cut into parts, and each part position has a codebook of a few entries.  A round gives
every part the nearest entry of its codebook and then moves each entry to the mean of its parts.

Nearest entries are found as LAESA does.  Each position has a few fixed pivots, the first entries of
its first codebook.  The distances of every part to its pivots are computed once and stored with the
vector.  In each round only the entries' distances to the pivots are new; by the triangle inequality
``|d(part, pivot) - d(pivot, entry)|`` is a lower bound of ``d(part, entry)``.  A part looks at the
entries in order of their bounds, computes exact whole-number distances, and stops as soon as a bound
is above the best distance so far.  Bounds carry a margin for rounding, so no nearest entry and no tie
is missed.

A round is one pass over the stored vectors.  Tasks add up their parts by entry, and the driver gets
one row for each position and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.session import kept

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4
_ROWS = 4096
_MARGIN = 1e-5  # relative error of a stored distance (32 bits) and of the bound, with room to spare


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x); shorter vectors are filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _laid(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each of ``points``."""
    return ((x[:, None].astype(np.int64) - points[None]) ** 2).sum(2)


def nearest(x: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part of one position: its nearest entry, the lower index on a tie, the squared
    distance, and how many exact distances were computed for all of them."""
    between = np.sqrt(_distances(pivots, entries).astype(np.float64))
    bounds = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        own, other = to_pivots[:, p, None].astype(np.float64), between[None, p]
        np.maximum(bounds, np.abs(own - other) - _MARGIN * (own + other) - _MARGIN, out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1) ** 2 * (np.take_along_axis(bounds, order, axis=1) > 0)
    best, found = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    going, computed = np.arange(len(x)), 0
    for k in range(len(entries)):
        going = going[bounds[going, k] <= best[going]]
        if not len(going):
            break
        entry = order[going, k]
        distance = ((x[going].astype(np.int64) - entries[entry]) ** 2).sum(1)
        computed += len(going)
        better = (distance < best[going]) | ((distance == best[going]) & (entry < found[going]))
        best[going[better]], found[going[better]] = distance[better], entry[better]
    return found, best, computed


def _assigned(batch: pa.RecordBatch, pivots: np.ndarray, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Slices of a batch (values, pivots, ...), their values, and what ``nearest`` says of each position."""
    for at in range(0, len(batch), _ROWS):
        part = batch.slice(at, _ROWS)
        x = _laid(part["values"], PARTS, books.shape[2])
        stored = _laid(part["pivots"], PARTS, pivots.shape[1])
        yield part, x, [nearest(x[:, p], stored[:, p], pivots[p], books[p]) for p in range(PARTS)]


def _sums(pivots: np.ndarray, books: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each position and entry: the sum and number of its parts."""
        entries, width = books.shape[1:]
        total, number = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            for _, x, found in _assigned(batch, pivots, books):
                for p, (entry, _, _) in enumerate(found):
                    np.add.at(total[p], entry, x[:, p])
                    number[p] += np.bincount(entry, minlength=entries)
        position, entry = np.nonzero(number)
        sums = pa.array(list(total[position, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(position, pa.int32()), pa.array(entry, pa.int32()), sums, pa.array(number[position, entry])], ["position", "entry", "sums", "number"])

    return run


def _codes(pivots: np.ndarray, books: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, found in _assigned(batch, pivots, books):
                raw = np.stack([entry for entry, _, _ in found], axis=1).astype(np.uint8)
                error = np.sum([best for _, best, _ in found], axis=0)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], pa.array([r.tobytes().hex() for r in raw]), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _moved(stored: DataFrame, pivots: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round; an entry without parts stays."""
    rows = stored.select("values", "pivots").mapInArrow(_sums(pivots, books), "position int, entry int, sums array<bigint>, number long")
    exact = lambda i: F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}")
    sums = rows.groupBy("position", "entry").agg(*[exact(i) for i in range(books.shape[2])], F.sum("number").alias("number"))
    out = books.copy()
    for row in sums.collect():  # at most PARTS * ENTRIES
        out[row["position"], row["entry"]] = [int(row[f"s{i}"]) // row["number"] for i in range(books.shape[2])]
    return out


def codebook_digest(books: np.ndarray) -> str:
    """sha256 of the components as text, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(stored vectors, pivots, codebooks) for ``codes``.  Stored vectors have vec_id, label, values
    (whole numbers) and pivots (distances); pivots and codebooks are by position, number and place."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & F.forall("embedding", good))
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    seen = sound.agg(F.max(F.size("embedding")).alias("width"), F.max(most).alias("most")).first()
    width = -(-max(seen["width"] or 1, 1) // PARTS)  # of a part
    largest = SCALE * (seen["most"] or 0.0) + 1
    if 4 * PARTS * width * largest * largest >= 2**62:
        raise ValueError("components are too large for whole-number distances of 64 bits")
    first = sound.orderBy(F.col("vec_id").asc_nulls_last(), "embedding", F.col("label")).limit(ENTRIES).select("embedding").collect()
    rows = [np.floor(SCALE * np.array(r["embedding"], np.float64)).astype(np.int64) for r in first]
    books = np.zeros((PARTS, len(rows), width), np.int64)
    for k, row in enumerate(rows):
        books[:, k] = np.pad(row, (0, PARTS * width - len(row))).reshape(PARTS, width)
    pivots = books[:, :PIVOTS].copy()
    small = largest < 2**31

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                x = _whole(part["embedding"], PARTS * width)
                own = x.reshape(-1, PARTS, width)
                far = np.stack([np.sqrt(_distances(own[:, p], pivots[p])) for p in range(PARTS)], axis=1).astype(np.float32)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).astype(np.int32 if small else np.int64)), PARTS * width)
                stored = pa.FixedSizeListArray.from_arrays(pa.array(far.reshape(-1)), far[0].size)
                lists = [values.cast(pa.list_(values.type.value_type)), stored.cast(pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], *lists], ["vec_id", "label", "values", "pivots"])

    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    number = "int" if small else "bigint"
    stored = sound.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, values array<{number}>, pivots array<float>")
    stored = kept(stored)
    if len(rows):
        for _ in range(rounds):
            books = _moved(stored, pivots, books)
    return stored, pivots, books


def codes(stored: DataFrame, pivots: np.ndarray, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances added up)."""
    kind = {c: stored.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return stored.mapInArrow(_codes(pivots, books), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector, in whole numbers, that a code stands for."""
    return np.concatenate([books[p, entry] for p, entry in enumerate(bytes.fromhex(code))])


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding, label) with their errors.

    Returns vec_id, code, error, label_error (errors of all rows of one label, nulls together) and
    codebooks_sha256.  Rows whose vector is null or holds a null, a NaN or an infinity take no part.
    Codebooks start with the vectors of the ENTRIES smallest vec_ids, null ids last, equal ids by
    vector; with fewer vectors there are fewer entries.  Vectors of different lengths meet as if
    filled up with zeros, to a length that PARTS divides.  Rows that repeat count each.  Components
    whose squared distances may pass 64 bits are an error.  An empty table gives no rows; other
    columns are not looked at.
    """
    stored, pivots, books = train(vectors)
    coded = kept(codes(stored, pivots, books))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
