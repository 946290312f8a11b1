"""Files of one JSON array each, of any layout and any size, read in many tasks.

Spark's text source cuts the files in blocks, and each block in fragments that end with a ``}``.  What
a fragment means depends on all before it: whether it starts inside a string, behind a backslash, and
how deep.  So each block is first read for every state it could start in: where such a start would end
and how much deeper.  Put together block after block, that gives the true start of each.  Then the
blocks are read again, and cut into elements.  An element that lies in several blocks comes in pieces,
at most two a block, which are joined up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUTSIDE, INSIDE, ESCAPED = range(3)
_REST = r'[^"\\]*(?:\\.[^"\\]*)*'
_CLOSE = re.compile(_REST + '"', re.DOTALL)
_STRING = re.compile(f'"{_REST}"', re.DOTALL)
# A string, one that the text ends in, or a bracket.
_TOKEN = re.compile(f'"{_REST}(?:"|\\\\?\\Z)|[{{}}\\[\\]]', re.DOTALL)
_FILLING = re.compile(r"[\s,]*")
_BACKSLASHES = re.compile(r"\\*\Z")


def _in_string(text: str) -> int:
    return ESCAPED if len(_BACKSLASHES.search(text).group()) % 2 else INSIDE


def advance(state: int, text: str) -> tuple[int, int]:
    """(state after ``text``, how much deeper it ends)."""
    if not text:
        return state, 0
    if state != OUTSIDE:
        found = _CLOSE.match(text, int(state == ESCAPED))
        if not found:
            return _in_string(text[int(state == ESCAPED) :]), 0
        text = text[found.end() :]
    bare = _STRING.sub("", text)
    quote = bare.find('"')
    outside = bare if quote < 0 else bare[:quote]
    deeper = outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
    return OUTSIDE if quote < 0 else _in_string(bare[quote + 1 :]), deeper


class Cutter:
    """Cuts the text of a block into elements of the array, given how the block starts."""

    def __init__(self, state: int, depth: int):
        self.state, self.depth = state, depth
        self.within = depth > 1 or state != OUTSIDE  # of an element
        self.own = False  # it began in this block
        self.begun: list[str] = []
        self.left = ""

    def feed(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether it began in this block, text) of each element that ends in ``text``."""
        text, self.left = self.left + text, ""
        at, begin = 0, 0
        if self.state != OUTSIDE:
            found = _CLOSE.match(text, int(self.state == ESCAPED))
            if not found:
                self.left = text
                return
            self.state, at = OUTSIDE, found.end()
        end = len(text)
        for token in _TOKEN.finditer(text, at):
            kind = token.group()[0]
            if kind == '"':
                if not self.within:
                    self._filling(text, begin, token.end())
                if not _STRING.fullmatch(token.group()):  # goes on in what is fed next
                    end = token.start()
                    self.left = text[end:]
            elif kind in "{[":
                if self.depth == (1 if kind == "{" else 0) and not self.within:
                    self._filling(text, begin, token.start())
                    self.within = self.own = kind == "{"
                    begin = token.start() if kind == "{" else token.end()
                elif not self.within:
                    raise ValueError("not an array of objects")
                self.depth += 1
            elif self.depth > 0:
                self.depth -= 1
                if self.within and self.depth == 1:
                    yield self.own, "".join([*self.begun, text[begin : token.end()]])
                    self.begun, self.within, self.own, begin = [], False, False, token.end()
                elif self.depth == 0:
                    self._filling(text, begin, token.start())
                    begin = token.end()
        if self.within:
            self.begun.append(text[begin:end])
        elif self.depth == 1:
            self._filling(text, begin, end)

    def _filling(self, text: str, begin: int, end: int) -> None:
        if not _FILLING.fullmatch(text, begin, end):
            raise ValueError(f"not an array of objects: {text[begin : begin + 80]!r}")

    def finish(self) -> tuple[bool, str] | None:
        """The element that goes on in the next block, if there is one."""
        return (self.own, "".join([*self.begun, self.left])) if self.within else None


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """(key, text) of runs of fragments of one block; the key is all columns after the text."""
    for batch in batches:
        values, *keys = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(values):
            key, to = tuple(k[at] for k in keys), at
            while to < len(values) and all(k[to] == v for k, v in zip(keys, key, strict=True)):
                to += 1
            yield key, "}".join([*values[at:to], ""])
            at = to


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list] = {}
    for key, text in _blocks(batches):
        ends = found.setdefault(key, [(s, 0) for s in (OUTSIDE, INSIDE, ESCAPED)])
        for k, (state, depth) in enumerate(ends):
            after, deeper = advance(state, text)
            ends[k] = (after, depth + deeper)
    rows = [(*key, [s for s, _ in ends], [d for _, d in ends]) for key, ends in found.items()]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "block", "states", "depths"])


def _starts(table: pa.Table) -> pa.Table:
    """How each block of one file starts: a row for each block of the input."""
    state, depth, rows = OUTSIDE, 0, []
    for file, block, states, depths in sorted(zip(*(table[c].to_pylist() for c in ("file", "block", "states", "depths")), strict=True)):
        rows.append((file, block, state, depth))
        state, depth = states[state], depth + depths[state]
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate((("file", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("depth", pa.int64())))})


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, at, kind, text): elements, and pieces that start one or go on with it."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "block", "at", "kind", "text"])

    now, cutter, number = None, None, 0

    def last() -> list[tuple]:
        rest = cutter.finish() if cutter else None
        return [(*now, number, "starts" if rest[0] else "goes on", rest[1])] if rest else []

    for (file, block, state, depth), text in _blocks(batches):
        rows = []
        if now != (file, block):
            rows += last()
            now, cutter, number = (file, block), Cutter(state, depth), 0
        for own, element in cutter.feed(text):
            rows.append((file, block, number, "whole" if own else "goes on", element))
            number += 1
        if rows:
            yield told(rows)
    rows = last()
    if rows:
        yield told(rows)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of JSON arrays of objects: text, and seq (file, block, at), their order.

    Each file under ``path`` holds one array, in any layout, or nothing.  Something other than an
    object in the array, or before it, is an error; what follows the array is not looked at.  The files are read twice; beside them a task holds
    a batch of fragments and one element, and Spark broadcasts a row for each block.
    """
    fragments = spark.read.option("lineSep", "}").text(path)
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    fragments = fragments.select("value", *where)
    ends = fragments.mapInArrow(_ends, "file string, block long, states array<int>, depths array<bigint>")
    starts = ends.groupBy("file").applyInArrow(_starts, "file string, block long, state int, depth long")
    # One row for each block, which has spark.sql.files.maxPartitionBytes: a millionth of the input.
    known = fragments.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "state", "depth")
    pieces = known.mapInArrow(_cut, "file string, block long, at long, kind string, text string")
    whole = pieces.filter("kind = 'whole'").select("text", F.struct("file", "block", "at").alias("seq"))
    # Of a file's pieces, those from one that starts an element up to the next are one element.
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "starts")
    parts = pieces.filter("kind <> 'whole'").withColumn("element", F.sum((F.col("kind") == "starts").cast("int")).over(order))
    held = F.array_sort(F.collect_list(F.struct("block", F.col("kind") == "starts", "at", "text")))
    first = lambda a: a[0]
    joined = parts.groupBy("file", "element").agg(held.alias("p")).select(
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"),
        F.struct("file", first(F.col("p"))["block"].alias("block"), first(F.col("p"))["at"].alias("at")).alias("seq"),
    )
    return whole.unionByName(joined)
