"""Document fingerprints: the smallest hashes of a text's 5-word shingles (bottom-k sketch).

A fingerprint is text: the k smallest shingle hashes, 48 bits each, ascending, in base64.  It needs
no parameter to be read, and fingerprints of parts merge to that of the whole.  From two of them
follow estimates of resemblance and containment, from one that of the number of distinct shingles;
all are exact where the sets have fewer than k shingles.
"""

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.llm.shingles import shingle_sets, slices

K = 128
BITS = 48
BUCKET_ROWS = 4096


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Of sorted distinct 64-bit hashes."""
    return shingles[:k] >> np.uint64(64 - BITS)


def encode(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the sets."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of the union, and which of its values both have."""
    both = np.sort(np.concatenate((a, b)))
    if not len(both):
        return both, np.zeros(0, bool)
    change = both[1:] != both[:-1]
    first = np.concatenate(([True], change))
    return both[first][:k], np.concatenate((~change, [False]))[first][:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity of the sets; two empty sets are alike."""
    union, shared = _common(a, b, k)
    return float(shared.mean()) if len(union) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's set that b's set has too; 1 if a is empty."""
    union, shared = _common(a, b, k)
    own = np.isin(union, a).sum()
    return float(shared.sum() / own) if own else 1.0 if not len(a) else 0.0


def distinct(values: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles."""
    return float(len(values)) if len(values) < k else (k - 1) / (float(values[-1]) / 2.0**BITS)


def _pair(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, sketch, next text, next sketch)."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, _, n, _ in rows]
    changed = [sketch(s) for s in shingle_sets(pa.array(edited, pa.large_string()))]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [encode(r[2]) for r in rows],
            "edited_fingerprint": [encode(s) for s in changed],
            "near_edited": [resemblance(r[2], s) for r, s in zip(rows, changed, strict=True)],
            "near_next": [resemblance(r[2], r[4]) for r in rows],
        }
    )


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows (doc_id, text, bucket, tail) in order; a tail row is the next document of the
    bucket's last row and belongs to the following bucket."""
    held = None
    for batch in slices(batches):
        ids, texts, buckets, tails = (c.to_pylist() for c in batch.columns)
        sketches = [sketch(s) for s in shingle_sets(batch.column(1))]
        rows = []
        for row in zip(ids, texts, sketches, buckets, tails, strict=True):
            if held is not None and held[3] == row[3] and not held[4]:
                rows.append((*held[:3], row[1], row[2]))
            held = row
        if rows:
            yield _pair(rows)


def in_ranges(documents: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, key, bucket) in ranges of doc_id of about BUCKET_ROWS rows, and their number.

    Rows with one doc_id are in one range; null doc_ids are in the first, null texts are empty.  Only
    the ends of the ranges come to the driver."""
    least = F.lit(-(2**63)).cast("long")
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), least))
    rows = docs.count()
    if not rows:
        cuts = np.zeros(0, np.int64)
    else:
        parts = -(-rows // BUCKET_ROWS)
        shares = [i / parts for i in range(1, parts)] or [1.0]
        cuts = np.unique(docs.agg(F.percentile_approx("key", shares, max(10_000, 4 * parts))).first()[0]).astype(np.int64)
        if parts == 1:
            cuts = cuts[:0]

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    return docs.withColumn("bucket", bucket_of("key")), len(cuts) + 1


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of ``documents`` (doc_id, text) and of their edited texts, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by as many from the
    start of the next document's text, or all of it; the next document is that with the next higher
    doc_id, after the last the first.  Null texts are empty; null doc_ids come first; rows with one
    doc_id follow each other by text, so each row has a result.  A lone document is its own next.
    An empty table gives no rows.  Other columns are not looked at.

    Texts are shuffled once, in ranges of doc_id; each range is streamed through with one row held.
    """
    docs, _ = in_ranges(documents)
    # The first document of each bucket also ends the bucket before it, the very first the last one.
    firsts = docs.groupBy("bucket").agg(F.min("key").alias("key"))
    numbers = [r["bucket"] for r in firsts.select("bucket").orderBy("bucket").collect()]
    before = dict(zip(numbers, numbers[-1:] + numbers[:-1], strict=True)) if numbers else {}
    pairs = documents.sparkSession.createDataFrame(list(before.items()), "bucket int, to int")
    # Firsts are as few as the ranges.
    heads = docs.join(F.broadcast(firsts), ["bucket", "key"]).groupBy("bucket", "key").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    heads = heads.join(pairs, "bucket").select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("tail"), "key")
    given = docs.select("doc_id", "text", "bucket", F.lit(0).alias("tail"), "key").unionByName(heads)
    ordered = given.repartition(max(1, len(numbers)), "bucket").sortWithinPartitions("bucket", "tail", "key", "text")
    return ordered.select(F.col("doc_id").cast("long"), "text", "bucket", "tail").mapInArrow(
        _walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, None
    for batch in batches:
        out = []
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and key != at:
                out.append((at, encode(held)))
                held = None
            at, held = key, merge([decode(text)] if held is None else [held, decode(text)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([v for _, v in out])], ["key", "fingerprint"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], batch.schema.field(0).type), pa.array([encode(held)])], ["key", "fingerprint"])


def merged(fingerprints: DataFrame, key: str) -> DataFrame:
    """The fingerprint of each key's whole text (key, fingerprint), from rows (``key``, fingerprint).

    Merged within each partition first, then by key; both times as a stream that holds one sketch,
    so a key with any share of the rows is no burden.  Null fingerprints are left out."""
    kind = fingerprints.schema[key].dataType.simpleString()
    parts = fingerprints.select(F.col(key).alias("key"), "fingerprint").where(F.col("fingerprint").isNotNull())
    for deal in (lambda d: d, lambda d: d.repartition("key")):
        parts = deal(parts).sortWithinPartitions("key").mapInArrow(_runs, f"key {kind}, fingerprint string")
    return parts
