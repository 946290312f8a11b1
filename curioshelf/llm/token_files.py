"""Token ids in compressed blocks: a context mixture of three orders and a range coder.

A block holds the ids of whole documents.  Its ids are dealt to lanes, runs of equal length that are
coded side by side, so that one step codes an id of every lane with array operations.  All lanes of
a block learn one model; it starts anew with each block, so blocks are read independently.

The model has three predictions of the next id: counts of the ids that followed the two ids before
(order 2) and of those that followed the one before (order 1), both for a few ids a context, and the
frequencies of the block so far (order 0).  The probability of an id is the weighted sum of what the
three give it, and ids have disjoint intervals in ascending order, so one step of 30 bits codes any
id.  The weights are learned for each class of confidence of orders 2 and 1, by the part that each
order had in the probability of the ids seen: of all of the first 64 steps, and of each fourth step
after them.  All numbers are whole, and quotients are floors of exact ones, the same on every machine.
Where lanes share a context the last counts.

Block format, little endian: magic, checksum of all that follows (crc32), then five counts
(documents, ids, size of the vocabulary, lanes, words), document ids, ids per document, words per
lane (two bytes each, or four for lanes of over 16,000 ids), words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curioshelf.llm.fingerprints import in_ranges
from curioshelf.llm.tokens import runs, tokenizer
from curioshelf.session import scratch

MAGIC = b"CMT3"
HEADER = struct.Struct("<4sIqqqqq")
BLOCK_IDS = 1 << 20
LANES = 4096
END_ID = 1
SHELF = 4096  # buckets

_SLOTS = 19  # bits of order-0 frequencies
_GATE = 11  # bits of the weights
_KEPT = (1, 4)  # followers counted in a context of order 2 and of order 1
_PLACES = 17  # bits of contexts of order 2
_MOST = 250  # count at which the counts of a context are halved
_LEVEL = np.array([0, 1, 1, *[2] * 6, *[3] * (_MOST * 5)], np.int8)  # class of a context's total
_SHARE = ((1 << _SLOTS) // np.maximum(np.arange(len(_LEVEL)), 1)).astype(np.int32)  # of a count of one in a total
_ORDER = [(0, 3), (1, 4), (0, 2), (1, 3), (0, 1), (2, 4), (1, 2), (3, 4), (2, 3)]  # exchanges that sort five
_U = np.uint64
_STATE, _LOW = _U((1 << 56) - 1), _U(1 << 40)
_UNIT, _WHOLE = _U(_SLOTS + _GATE), _U(1 << (_SLOTS + _GATE))


def _total(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of each lane, and the greatest."""
    total = most = count[0]
    for row in count[1:]:
        total, most = total + row, np.maximum(most, row)
    return total, most


class _Followers:
    """For every context the ids that followed it most, each in one number with its count."""

    def __init__(self, contexts: int, kept: int):
        self.kept, self.table = kept, np.zeros((contexts, kept), np.int32)
        self.each = np.arange(kept, dtype=np.int32)[:, None]

    def look(self, at: np.ndarray, out: np.ndarray) -> None:
        """What is kept in the contexts, a row for each follower."""
        self.at, self.both = at, out
        out[:] = self.table.take(at, axis=0).T

    def learn(self, ids: np.ndarray, hit: np.ndarray, count: np.ndarray) -> None:
        """A follower that is kept gains; another one wears the rarest down and then takes its place.
        Of lanes that share a context and a place in it the last counts."""
        had, known, at, new = count[0], hit[0], self.at, self.both[0]
        flat = self.table.reshape(-1)
        if self.kept > 1:
            # Count and place of each, with what is known far below all counts.
            rarest = np.minimum.reduce((count << 3) + self.each - hit * np.int32(1 << 12))
            known, had = rarest < 0, (rarest >> 3) & 255
            at = at * np.int64(self.kept) + (rarest & 7)
            new = flat.take(at)
        new = new + (known * np.int32(3) - np.int32(1))
        np.copyto(new, (ids << 8) + 2, where=~known & (had <= 2))
        flat[at] = new
        full = known & (had >= _MOST)
        if full.any():
            full = np.unique(self.at[full])
            both = self.table[full]
            self.table[full] = (both & ~255) | ((both & 255) >> 1)


class _Model:
    """Predicts the next id of each lane from the ids so far; the same in coder and decoder."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.one, self.two = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.second, self.first = _Followers(1 << _PLACES, _KEPT[0]), _Followers(vocabulary, _KEPT[1])
        self.votes = np.full((3, 64), 256, np.int64)
        self.counts, self.recent, self.seen, self.due, self.turn = np.zeros(vocabulary, np.int64), [], 0, 0, 0
        self._weigh()
        self._rank()

    def _weigh(self) -> None:
        """Weights of orders 0, 1 and 2 by gate; none is zero, so every id can be coded."""
        w1, w2 = self.votes[1:] * ((1 << _GATE) - 3) // self.votes.sum(0) + 1
        self.weights = (w2 << 16 | w1).astype(np.int32)

    def _rank(self) -> None:
        """Order-0 frequencies from all ids so far; each id keeps at least one slot."""
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary)
            self.recent = []
        total = int(self.counts.sum())
        slots = np.ones(self.vocabulary, np.int64)
        if total:
            slots += self.counts * ((1 << _SLOTS) - self.vocabulary) // total
        slots[int(slots.argmax())] += (1 << _SLOTS) - int(slots.sum())
        self.before = np.concatenate(([0], np.cumsum(slots))).astype(np.int32)
        self.slots = slots.astype(np.int32)
        self.slot_id = np.repeat(np.arange(self.vocabulary, dtype=np.int32), slots)
        self.due = self.seen + max(LANES, self.seen // 4)

    def predict(self) -> None:
        """The ids that orders 2 and 1 know for each lane, and what they add to order 0 for each."""
        kept, both = _KEPT[0], np.empty((sum(_KEPT), len(self.one)), np.int32)
        self.second.look((self.one * np.int64(40503) + self.two * np.int64(60493)) & ((1 << _PLACES) - 1), both[:kept])
        self.first.look(self.one, both[kept:])
        self.found, self.count = both >> 8, both & 255
        (two, most_two), (one, most_one) = _total(self.count[:kept]), _total(self.count[kept:])
        gate = _LEVEL.take(two) * np.int8(4) + _LEVEL.take(one)
        self.gate = (gate * np.int8(4) + (most_one * 2 > one) * np.int8(2) + (most_two > 6)).astype(np.int64)
        weights = self.weights.take(self.gate)
        w1, w2 = weights & 0xFFFF, weights >> 16
        self.w0 = (1 << _GATE) - w1 - w2
        self.mass = np.empty_like(both)
        np.multiply(self.count[:kept], w2 * _SHARE.take(two), out=self.mass[:kept])
        np.multiply(self.count[kept:], w1 * _SHARE.take(one), out=self.mass[kept:])

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id, of 2**30: what the three orders give to the ids below
        it, and to the id itself."""
        self.hit = self.found == ids
        self.part = self.hit * self.mass
        self.own = self.w0 * self.slots.take(ids)
        below = np.add.reduce((self.found < ids) * self.mass, 0, np.int32)
        return self.w0 * self.before.take(ids) + below, self.own + np.add.reduce(self.part, 0, np.int32)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id of each lane whose interval holds the value."""
        # Known ids in ascending order, each in one number with what is added to it.
        both = list((self.found.astype(np.int64) << 32) | self.mass)
        for i, j in _ORDER:
            both[i], both[j] = np.minimum(both[i], both[j]), np.maximum(both[i], both[j])
        both, w0 = np.stack(both), self.w0
        found, mass = both >> 32, both.astype(np.int32)
        # Without what known ids below have added, the value is a place in order 0, unless it lies in
        # the first known id that ends behind it.
        rest, passed = value, np.zeros(len(value), np.int64)
        below, ends = 0, w0 * self.before.take(found + 1)
        for k in range(len(found)):
            below = below + mass[k]
            over = value >= ends[k] + below
            rest = rest - over * mass[k]
            passed += over
        lanes = len(value)
        first = found.reshape(-1).take(np.minimum(passed, len(found) - 1) * lanes + np.arange(lanes))
        inside = (passed < len(found)) & (rest >= w0 * self.before.take(first))
        out = self.slot_id.take((rest / w0).astype(np.int64), mode="clip")
        np.copyto(out, first, where=inside, casting="same_kind")
        return out

    def learn(self, ids: np.ndarray) -> None:
        """Learns the ids of the last :meth:`interval`."""
        kept = _KEPT[0]
        if self.turn < 64 or not self.turn % 4:
            two, one = self.part[0].astype(np.float64), np.add.reduce(self.part[kept:], 0, np.float64)
            for part in self.part[1:kept]:
                two += part
            all_three = self.own + one + two
            two, one = np.floor(two * 256 / all_three), np.floor(one * 256 / all_three)
            for order, part in enumerate((256 - one - two, one, two)):
                self.votes[order] += np.bincount(self.gate, part, 64).astype(np.int64)
            high = self.votes.sum(0) > 1 << 24
            self.votes[:, high] = self.votes[:, high] // 2 + 1
            self._weigh()
        self.second.learn(ids, self.hit[:kept], self.count[:kept])
        self.first.learn(ids, self.hit[kept:], self.count[kept:])
        self.turn += 1
        self.two, self.one = self.one, ids
        self.recent.append(ids)
        self.seen += len(ids)
        if self.seen >= self.due:
            self._rank()


def _normal(low: np.ndarray, size: np.ndarray, shift) -> None:
    """Moves 16 bits out of every lane whose interval has become small; ``shift`` deals with them."""
    at = np.flatnonzero(size < _LOW)
    while len(at):
        a, s = low.take(at), size.take(at)
        split = (a ^ (a + s - _U(1))) >= _LOW
        if split.any():
            np.copyto(s, _LOW - (a & (_LOW - _U(1))), where=split)
        shift(at, a)
        low[at] = (a << _U(16)) & _STATE
        size[at] = s << _U(16)
        at = at[s < _U(1 << 24)]


def _ends(steps: int) -> str:
    """Kind of number that holds the words of a lane."""
    return "<u2" if 4 * steps + 8 < 1 << 16 else "<i4"


def encode_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a block of documents: their ids, the number of token ids of each, all token ids."""
    n = len(ids)
    vocabulary = int(ids.max(initial=0)) + 1
    if vocabulary > 1 << (_SLOTS - 1):
        raise ValueError(f"token ids must be below {1 << (_SLOTS - 1)}")
    lanes = max(1, min(LANES, n // 256))
    steps = -(-n // lanes)
    laid = np.zeros(lanes * steps, np.int32)
    laid[:n] = ids
    laid = np.ascontiguousarray(laid.reshape(lanes, steps).T)
    model = _Model(vocabulary, lanes)
    low, size = np.zeros(lanes, _U), np.full(lanes, _STATE, _U)
    words, ends = np.zeros((lanes, 4 * steps + 8), np.uint16), np.zeros(lanes, np.int64)

    def shift(at, a):
        words.reshape(-1)[at * words.shape[1] + ends[at]] = a >> _U(40)
        ends[at] += 1

    for now in laid:
        model.predict()
        start, width = model.interval(now)
        unit = size >> _UNIT
        low += unit * start.astype(_U)
        size = unit * width.astype(_U)
        _normal(low, size, shift)
        model.learn(now)
    shift(np.arange(lanes), (low + _LOW - _U(1)) & ~(_LOW - _U(1)))
    taken = words[np.arange(words.shape[1])[None] < ends[:, None]]
    body = b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), counts.astype("<i8"), ends.astype(_ends(steps)), taken.astype("<u2")))
    counts_of = struct.pack("<5q", len(doc_ids), n, vocabulary, lanes, len(taken))
    return MAGIC + struct.pack("<I", zlib.crc32(counts_of + body)) + counts_of + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token ids per document, all token ids) of a block; ValueError if it is damaged."""
    if block[:4] != MAGIC or len(block) < HEADER.size or zlib.crc32(block[8:]) != struct.unpack("<I", block[4:8])[0]:
        raise ValueError("not a whole token block")
    _, _, docs, n, vocabulary, lanes, total = HEADER.unpack_from(block)
    at, steps = HEADER.size, -(-n // lanes)
    fields = []
    for kind, number in (("<i8", docs), ("<i8", docs), (_ends(steps), lanes), ("<u2", total)):
        fields.append(np.frombuffer(block, kind, number, at))
        at += np.dtype(kind).itemsize * number
    doc_ids, counts, ends, taken = fields
    # The state has seven bytes: after the first seven, 16 bits at a time are moved in.
    words = np.zeros((lanes, max(int(ends.max(initial=0)), 4) + 6), ">u2")
    words[np.arange(words.shape[1])[None] < ends[:, None]] = taken
    raw = words.view(np.uint8)
    code = np.zeros(lanes, _U)
    for k in range(7):
        code = (code << _U(8)) | raw[:, k]
    stream = np.ascontiguousarray(raw[:, 7:-1]).view(">u2").astype(_U)
    model = _Model(vocabulary, lanes)
    low, size, place = np.zeros(lanes, _U), np.full(lanes, _STATE, _U), np.zeros(lanes, np.int64)
    out = np.empty((steps, lanes), np.int32)

    def shift(at, a):
        code[at] = ((code[at] << _U(16)) & _STATE) | stream[at, np.minimum(place[at], stream.shape[1] - 1)]
        place[at] += 1

    for step in range(steps):
        model.predict()
        unit = size >> _UNIT
        now = model.find(np.minimum((code - low) // unit, _WHOLE - _U(1)).astype(np.int32))
        start, width = model.interval(now)
        low += unit * start.astype(_U)
        size = unit * width.astype(_U)
        _normal(low, size, shift)
        out[step] = now
        model.learn(now)
    return doc_ids, counts, np.ascontiguousarray(out.T).reshape(-1)[:n]


def _blocks(path: str, end_id: int | None):
    """Rows (doc_id, text, bucket) in order to rows (bucket, block, ids, data)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        bucket, number, held, docs, sizes, total = None, 0, [], [], [], 0

        def block():
            ids = np.concatenate(held)
            data = encode_block(np.array(docs, np.int64), np.array(sizes, np.int64), ids)
            names = ["bucket", "block", "ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names)

        for batch in batches:
            for at, n in runs(batch.column(1)):
                ids, buckets = (batch.column(c).slice(at, n).to_pylist() for c in (0, 2))
                flat, counts = encoder.encode(batch.column(1).slice(at, n))
                bounds = np.concatenate(([0], np.cumsum(counts)))
                for k, (doc, to) in enumerate(zip(ids, buckets, strict=True)):
                    if docs and (to != bucket or total >= BLOCK_IDS):
                        yield block()
                        number, held, docs, sizes, total = (number + 1 if to == bucket else 0), [], [], [], 0
                    bucket = to
                    own = flat[bounds[k] : bounds[k + 1]]
                    held.append(own if end_id is None else np.append(own, np.int32(end_id)))
                    docs.append(doc)
                    sizes.append(len(held[-1]))
                    total += sizes[-1]
        if docs:
            yield block()

    return run


def write_tokens(documents: DataFrame, path: str, folder: str, end_id: int | None = END_ID) -> None:
    """Writes the ids of ``documents`` (doc_id, text) to ``folder``, in order of doc_id.

    The folder is a Parquet table of blocks: bucket and block give the order, ids the number of ids,
    data the block.  ``end_id`` closes each document, empty and null texts included.  Rows with one
    doc_id follow each other by text.  A null doc_id comes first and is stored as the least long.
    """
    docs, buckets = in_ranges(documents)
    key = F.col("key").alias("doc_id")
    # A bucket is a partition: by hash some partitions would get several, and others none.
    ordered = docs.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "key", "text").select(key, "text", "bucket")
    ordered.mapInArrow(_blocks(path, end_id), "bucket int, block int, ids long, data binary").write.parquet(folder)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs, counts, ids = decode_block(data)
            raw = ids.astype("<u4")
            bounds = np.concatenate(([0], np.cumsum(counts)))
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            starts = pa.array(start + bounds[:-1])
            lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(ids.astype(np.int32)))
            arrays = [pa.array(docs, pa.int64()), starts, pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), lists.cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _documents(batches):
        yield batch.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, folder: str, ids: bool = True) -> DataFrame:
    """Documents of ``write_tokens``: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32, and the ids themselves unless ``ids`` is false.  A block that fails its checksum is
    an error."""
    blocks = spark.read.schema("bucket int, block int, ids long, data binary").parquet(folder)
    sums = blocks.groupBy("bucket").agg(F.sum("ids").alias("ids"))
    # Ids before a bucket: those of the shelves before its own, and of the buckets before it on that.
    sums = sums.withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    shelves = sums.groupBy("shelf").agg(F.sum("ids").alias("held"))
    shelves = shelves.select("shelf", (F.sum("held").over(Window.orderBy("shelf")) - F.col("held")).alias("earlier"))
    on_shelf = F.sum("ids").over(Window.partitionBy("shelf").orderBy("bucket")) - F.col("ids")
    before = sums.withColumn("on_shelf", on_shelf).join(shelves, "shelf").select("bucket", (F.col("earlier") + F.col("on_shelf")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("bucket").orderBy("block")) - F.col("ids")
    starts = blocks.select("bucket", "block", "ids").withColumn("inside", inside).join(before, "bucket")
    placed = blocks.join(starts.select("bucket", "block", (F.col("before") + F.col("inside")).alias("start")), ["bucket", "block"])
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if ids:
        return placed.select("start", "data").mapInArrow(_documents, kind + ", ids array<int>")
    return placed.select("start", "data").mapInArrow(_digests, kind)


def token_file(documents: DataFrame, path: str) -> DataFrame:
    """Writes the tokens of ``documents`` to the shared folder and reads their digests back.

    An empty table has no blocks and no rows; other columns are not looked at."""
    folder = scratch(documents.sparkSession)
    write_tokens(documents, path, folder)
    return read_tokens(documents.sparkSession, folder, ids=False)
