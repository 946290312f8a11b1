"""Deck requests carried out one after another, exactly.

Requests of one column depend on each other: an index counts in the column as all earlier requests
have left it.  What they depend on is small.  A column's cards enter as one run of ranks, however many
they are, and only its requests are replayed, on pieces: runs of ranks and single cards put in.  The
replay gives each card that was put in its place relative to the cards that were there before; keys
between the neighbours' then put it there without the rest being written again.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curioshelf.operators import arrangement as A
from curioshelf.operators.order_keys import keys_between
from curioshelf.operators.ranking import grouped_rank
from curioshelf.session import kept, settled

REQUESTS = 1_000_000  # of one replay
PIECES = 256  # in one block


class Pieces:
    """A list of ``n`` unnamed things, ranks 0 to n - 1, in which named things come and go."""

    def __init__(self, n: int):
        self.blocks: list[list] = [[(0, n)] if n else []]
        self.sizes = [n]
        self.lows = [0]  # of each block, a rank that no earlier block reaches and no own piece is below
        self.block_of: dict[str, list] = {}

    @staticmethod
    def _size(piece) -> int:
        return 1 if isinstance(piece, str) else piece[1] - piece[0]

    def _number(self, block: list) -> int:
        return next(k for k, b in enumerate(self.blocks) if b is block)

    def insert(self, index: int | None, name: str) -> None:
        """Before what is at ``index`` now; at the end with None or an index beyond it."""
        index = None if index is None else max(index, 0)
        if index is None or index >= sum(self.sizes):
            k, left = len(self.blocks) - 1, self.sizes[-1]
        else:
            k, left = 0, index
            while left >= self.sizes[k]:
                left -= self.sizes[k]
                k += 1
        block, at = self.blocks[k], 0
        while at < len(block) and left >= self._size(block[at]):
            left -= self._size(block[at])
            at += 1
        if left:
            a, b = block[at]
            block[at : at + 1] = [(a, a + left), name, (a + left, b)]
        else:
            block.insert(at, name)
        self.sizes[k] += 1
        self.block_of[name] = block
        if len(block) > PIECES:
            self._split(k)

    def _split(self, k: int) -> None:
        block = self.blocks[k]
        more = block[PIECES // 2 :]
        del block[PIECES // 2 :]
        reached = max((p[1] for p in block if not isinstance(p, str)), default=self.lows[k])
        self.blocks.insert(k + 1, more)
        self.sizes[k : k + 1] = [sum(map(self._size, block)), sum(map(self._size, more))]
        self.lows.insert(k + 1, reached)
        self.block_of.update((p, more) for p in more if isinstance(p, str))

    def remove(self, name: str) -> None:
        block = self.block_of.pop(name)
        block.remove(name)
        self.sizes[self._number(block)] -= 1

    def remove_rank(self, rank: int) -> None:
        k = bisect.bisect_right(self.lows, rank) - 1
        for k in range(k, -1, -1):  # a block without ranks shares its bound with the one before
            for at, piece in enumerate(self.blocks[k]):
                if not isinstance(piece, str) and piece[0] <= rank < piece[1]:
                    self.blocks[k][at : at + 1] = [p for p in ((piece[0], rank), (rank + 1, piece[1])) if p[0] < p[1]]
                    self.sizes[k] -= 1
                    return
        raise KeyError(rank)

    def named(self) -> list[tuple[str, int]]:
        """Named things in order, and how many ranks end before each."""
        out, after = [], 0
        for block in self.blocks:
            for piece in block:
                if isinstance(piece, str):
                    out.append((piece, after))
                else:
                    after = piece[1]
        return out


def _replayed(table: pa.Table) -> pa.Table:
    """Of one column: where the cards put in stand after all its events."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("seq", "copy_id", "comes", "index", "rank")), strict=True), key=lambda r: r[:3])
    pieces = Pieces(table["held"][0].as_py())
    for _, copy, comes, index, rank in rows:
        if comes:
            pieces.insert(index, copy)
        elif rank is None:
            pieces.remove(copy)
        else:
            pieces.remove_rank(rank - 1)
    found = pieces.named()
    columns = {c: pa.array([table[c][0].as_py()] * len(found), pa.string()) for c in A.COLUMN}
    columns |= {"copy_id": pa.array([c for c, _ in found], pa.string()), "after": pa.array([a for _, a in found], pa.int64()), "turn": pa.array(range(len(found)), pa.int32())}
    return pa.table(columns)


def replay_rows(placements: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placements to write, placements to take away) that carry out ``resolved`` requests (deck_id,
    section_id, column_id, copy_id, index, seq) one after another."""
    flat = placements.select(*A.PLACEMENT)
    # A request takes its copy away from where the one before has put it, the first from everywhere.
    turns = settled(resolved.withColumn("_before", F.lag(F.struct(*A.COLUMN)).over(Window.partitionBy("copy_id").orderBy("seq"))))
    first = turns.filter("_before is null").select("copy_id", "seq")
    stale = settled(flat.join(first, "copy_id"))
    touched = turns.select(*A.COLUMN).unionByName(stale.select(*A.COLUMN)).distinct()
    ranked = grouped_rank(flat.join(touched, A.COLUMN, "left_semi"), A.COLUMN, [("pos", "asc"), ("copy_id", "asc")], "rank")
    held = kept(ranked.select(*A.COLUMN, "copy_id", "rank", F.col("pos").cast("long").alias("key")))
    none = lambda kind: F.lit(None).cast(kind)
    comes = turns.select(*A.COLUMN, "seq", F.lit(True).alias("comes"), "copy_id", F.col("index").cast("int").alias("index"), none("long").alias("rank"))
    leaves = turns.filter("_before is not null").select("_before.*", "seq", F.lit(False).alias("comes"), "copy_id", none("int").alias("index"), none("long").alias("rank"))
    stays = held.join(first, "copy_id").select(*A.COLUMN, "seq", F.lit(False).alias("comes"), "copy_id", none("int").alias("index"), "rank")
    counts = held.groupBy(*A.COLUMN).agg(F.count("*").alias("held"))
    events = comes.unionByName(leaves).unionByName(stays).join(counts, A.COLUMN, "left").withColumn("held", F.coalesce("held", F.lit(0)).cast("long"))
    kind = "deck_id string, section_id string, column_id string, copy_id string, after long, turn int"
    named = [*[F.col(c).cast("string").alias(c) for c in A.COLUMN], F.col("copy_id").cast("string").alias("copy_id"), "seq", "comes", "index", "rank", "held"]
    new = events.select(*named).groupBy(*A.COLUMN).applyInArrow(_replayed, kind)
    types = placements.schema
    new = settled(new.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in [*A.COLUMN, "copy_id"]], "after", "turn"))
    gone = stale.select(*A.COLUMN, "copy_id")
    keys = settled(keys_between(held, new, gone, A.COLUMN, "copy_id").select(*A.COLUMN, F.col("key").alias("pos"), "copy_id"))
    # Cards numbered afresh give up the row they had.
    moved = keys.join(new.select(*A.COLUMN, "copy_id"), [*A.COLUMN, "copy_id"], "left_anti").select(*A.COLUMN, "copy_id")
    return keys, gone.unionByName(moved)


def deck_replay(
    placements: DataFrame,
    columns: DataFrame,
    copies: DataFrame,
    decks: DataFrame,
    requests: DataFrame,
    at_once: int = REQUESTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put copies into columns, one request after another; the new placements, columns and copies.

    ``requests``: copy_id, deck_id, section_id, column_id, index, seq, carried out by seq; a copy may
    be asked for any number of times, but no seq twice for one copy.  Each request takes the copy out
    of wherever it is and puts it before what is then at ``index``, clamped to the column; NULL
    appends.  Which column that is, and which requests are valid, is as for ``deck_place``.

    A column's requests are replayed in one task, in memory that grows with them and not with the
    column; beyond ``at_once`` requests in all the batch is cut by seq and replayed part by part.
    Positions are keys with gaps: rows are written for the copies asked for, and for others only
    where a gap is used up.
    """
    resolved = settled(A.resolve_requests(columns, copies, decks, requests))
    flat = placements.select(*A.COLUMN, F.col("pos").cast("long").alias("pos"), "copy_id")
    total = resolved.count()
    if total <= at_once:
        parts = [resolved]
    else:
        numbered = kept(grouped_rank(resolved, [], [("seq", "asc"), ("copy_id", "asc")], "_n"))
        cuts = range(0, total, at_once)
        parts = [numbered.filter((F.col("_n") > at) & (F.col("_n") <= at + at_once)).drop("_n") for at in cuts]
    for n, part in enumerate(parts):
        written, taken = replay_rows(flat, part)
        flat = flat.join(taken, [*A.COLUMN, "copy_id"], "left_anti").select(*A.PLACEMENT).unionByName(written.select(*A.PLACEMENT))
        flat = kept(flat) if n + 1 < len(parts) else flat
    last = A.latest(resolved, "copy_id", "seq")
    return flat, A.place_columns(columns, resolved), A.place_copies(copies, last)
