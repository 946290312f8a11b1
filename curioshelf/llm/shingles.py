"""Word and shingle hashes of whole Arrow batches, without a loop over words.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered.  A shingle is five words
in a row, or the whole text if it has one to four words.  Hashes are 64 bits wide and mean the same
in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK_BYTES = 1 << 18
SLICE_ROWS = 512

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(WIDTH)], np.uint64)
_LENGTH = np.uint64(0xA0761D6478BD642F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Parts words at all ASCII characters but letters and digits.
LETTERS = np.zeros(256, bool)
LETTERS[:128] = True
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)

_powers = [np.ones(0, np.uint64)] * 2


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that all their bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets) of runs of rows with about CHUNK_BYTES of text.

    Null texts have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of SLICE_ROWS rows, so that what is made of a piece stays small."""
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        pa.default_memory_pool().release_unused()


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hash of each word, words before each row, start and end byte of each word, hashes of each
    word's first bytes, for each number in ``prefixes``).  ``gaps``: by byte, whether it parts words."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none, [none.astype(np.uint64) for _ in prefixes]
    inside = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _power_tables(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_LOWER[data] * power, dtype=np.uint64)))

    def hashed(to):
        return mix((sums[to] - sums[starts]) * inverse[starts] + (to - starts).astype(np.uint64) * _LENGTH)

    heads = [hashed(np.minimum(starts + p, ends)) for p in prefixes]
    return hashed(ends), np.searchsorted(starts, offsets), starts, ends, heads


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in row order."""
    for _, rows, data, offsets in chunks(texts):
        words, bounds, *_ = word_hashes(data, offsets)
        n = len(words) - WIDTH + 1
        if n > 0:
            full = np.zeros(n, np.uint64)
            for i in range(WIDTH):
                full += words[i : i + n] * _PLACES[i]
            full = mix(full)
        for row in range(rows):
            a, b = int(bounds[row]), int(bounds[row + 1])
            if b - a >= WIDTH:
                found = np.sort(full[a : b - WIDTH + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mix(short + np.full(1, b - a, np.uint64) * _LENGTH)
            else:
                yield np.zeros(0, np.uint64)
