"""Best-fit packing of documents into sequences of fixed length, with conflicts.

Documents go into bins of ``capacity`` tokens, the longest first, each into the fullest bin it fits
in and does not conflict with: no bin holds two documents of one source or of one cluster of copies.
Bins are ordered by what is left in them and carry a bitmap of their sources and clusters.  A tree
over the room left keeps, for each range, the bits that all its bins have; the search for the next
larger bin skips ranges whose every bin conflicts and goes on until one is compatible.

Documents are dealt to shards by hash, so a source or cluster with a third of all rows is spread
evenly, and each shard is packed by itself; a shard's size does not depend on the input's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.llm.ngram_join import set_roots, sets_of
from curioshelf.llm.tokens import runs, tokenizer
from curioshelf.session import kept

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
SHARD_ITEMS = 16_384


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()  # room left 0 .. capacity
        self.shared = [-1] * (2 * self.leaves)  # bits that all bins of a range have; -1: no bin
        self.at: dict[int, list[tuple[int, int]]] = {}  # room left: (bin, bits)
        self.capacity, self.number = capacity, 0

    def _raise(self, room: int, bits: int) -> None:
        node = self.leaves + room
        self.shared[node] = bits
        while node > 1:
            node //= 2
            bits = self.shared[2 * node] & self.shared[2 * node + 1]
            if self.shared[node] == bits:
                break
            self.shared[node] = bits

    def _take(self, room: int, bits: int) -> tuple[int, int] | None:
        """A bin with just this room that does not conflict."""
        held = self.at[room]
        for n, (_, other) in enumerate(held):
            if not other & bits:
                found = held[n]
                held[n] = held[-1]
                held.pop()
                if not held:
                    del self.at[room]
                    self._raise(room, -1)
                return found
        # What all bins share may have grown as others left.
        common = -1
        for _, other in held:
            common &= other
        self._raise(room, common)
        return None

    def _next(self, room: int, bits: int) -> int | None:
        """The least room, from ``room`` on, where not every bin is known to share one of the bits."""
        node = self.leaves + room
        if not self.shared[node] & bits:
            return room
        while node > 1:
            if not node & 1 and not self.shared[node + 1] & bits:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if self.shared[node] & bits:
                        node += 1
                        if self.shared[node] & bits:  # one bit in the left half, another in the right
                            break
                if node >= self.leaves and not self.shared[node] & bits:
                    return node - self.leaves
                continue
            node //= 2
        return None

    def place(self, size: int, bits: int) -> tuple[int, int]:
        """(bin, place in it) of a new document."""
        probe = bits | 1  # bit 0 is set in no bin, so that ranges without bins (-1) conflict
        room: int | None = size
        while room is not None and (room := self._next(room, probe)) is not None:
            found = self._take(room, bits)
            if found is not None:
                break
            room = room + 1 if room < self.capacity else None
        else:
            found = None
        if found is None or room is None:
            found, room = (self.number, 0), self.capacity
            self.number += 1
        left = room - size
        if left:
            self.at.setdefault(left, []).append((found[0], found[1] | bits))
            self._raise(left, self.shared[self.leaves + left] & (found[1] | bits))
        return found[0], self.capacity - room


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each document; ``sizes`` in descending order, none above ``capacity``.

    Only sources and clusters that occur twice need a bit.  None conflicts with nothing."""
    bins, names = Bins(capacity), {}
    for kind, values in (("source", sources), ("cluster", clusters)):
        for value, n in Counter(values).items():
            if value is not None and n > 1:
                names[kind, value] = 2 << len(names)
    return [
        bins.place(size, names.get(("source", source), 0) | names.get(("cluster", cluster), 0))
        for size, source, cluster in zip(sizes, sources, clusters, strict=True)
    ]


def _pack(capacity: int):
    def done(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        ids, chunks, sizes, sources, clusters, shards = (list(x) for x in zip(*rows, strict=True))
        placed = pack_shard(sizes, sources, clusters, capacity)
        arrays = [
            pa.array(ids, schema.field(0).type),
            pa.array(chunks, pa.int64()),
            pa.array(sizes, pa.int32()),
            pa.array([(s << 32) + b for s, (b, _) in zip(shards, placed, strict=True)], pa.int64()),
            pa.array([at for _, at in placed], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "chunk", "size", "bin_id", "start"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][-1] != row[-1]:
                    yield done(held, batch.schema)
                    held = []
                held.append(row)
        if held:
            yield done(held, batch.schema)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs ``items`` (doc_id, length, source, cluster): doc_id, chunk, size, bin_id, start.

    A document longer than ``capacity`` is cut into chunks of that size and a rest, numbered from 0;
    its chunks have its source and cluster.  start is the place in the bin.  A null or negative
    length counts as 0 and still has a row.  Null sources and clusters conflict with nothing.  Each
    repeated row is packed; an empty table gives no rows; other columns are not looked at.
    """
    items = kept(items.select("doc_id", "length", "source", "cluster"))
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0)).cast("long")
    rows = items.select("doc_id", length.alias("length"), "source", "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.col("length") - F.col("chunk") * capacity, F.lit(capacity)).cast("int")
    rows = rows.withColumn("size", size)
    chunks = items.select(length.alias("length")).agg(F.sum(F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(chunks) // SHARD_ITEMS))
    shard = F.pmod(F.xxhash64("doc_id", "chunk", "size", "cluster"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard).select("doc_id", "chunk", "size", "source", "cluster", "shard")
    ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "chunk", "source", "cluster")
    kind = items.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(_pack(capacity), f"doc_id {kind}, chunk long, size int, bin_id long, start int")


def _measured(documents: DataFrame, path: str | None, sets: bool) -> DataFrame:
    """(doc_id, length, source, cluster) and, with ``sets``, (n_shingles, node)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    names = ["doc_id", "length", "source", "cluster", *(["n_shingles", "node"] if sets else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            doc, text, source, cluster = batch.columns
            lengths = [encoder.lengths(text.slice(at, n)) + 1 for at, n in runs(text)]
            length = pa.array(np.concatenate(lengths) if lengths else [], pa.int64())
            yield pa.RecordBatch.from_arrays([doc, length, source, cluster, *(sets_of(text) if sets else [])], names)

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = documents.select("doc_id", text, "source", F.xxhash64(text).alias("cluster"))
    doc, source = (documents.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    return rows.mapInArrow(run, ", ".join(f"{n} {({'doc_id': doc, 'source': source}).get(n, 'long')}" for n in names))


def as_items(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Items of ``documents`` (doc_id, text, source): as many tokens as the tokenizer file ``path``
    (that of op3, if none is given) gives ids, and one for the end; documents with equal texts are
    one cluster."""
    return _measured(documents, path, False)


def near_items(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The items of ``as_items``, but the near-duplicate classes of ``ngram_join`` are the clusters,
    null for classes of one.  Classes are known row by row, so doc_id may be null or repeat.  Texts
    without shingles are in no class: equal ones are one cluster."""
    rows = kept(_measured(documents, path, True))
    roots = set_roots(documents, rows.agg(F.sum("n_shingles")).first()[0] or 0)
    sets = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"))
    known = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = known.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1")
    named = known.select("node", "root").join(classes.select("root"), "root")
    cluster = F.coalesce("root", F.when(F.col("node").isNull(), F.col("cluster"))).alias("cluster")
    return rows.join(named, "node", "left").select("doc_id", "length", "source", cluster)
