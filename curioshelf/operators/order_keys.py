"""Keys that keep an order under insertions.

The rows of a list are ordered by a whole number with gaps.  A row that is put in takes a number
between its neighbours, so nothing else is written.  Where a gap has become too small, the smallest
stretch around it that has room is numbered afresh: 64 rows, 4,096 rows, and so on to the whole list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curioshelf.operators.ranking import grouped_rank
from curioshelf.session import settled

SPACE = 1 << 16
# Rows between two posts, rows that keep their key while what is between them is numbered afresh.
# With 1 every old row is a post; 0 stands for a list without posts.
STRETCHES = (1, 64, 64**2, 64**3, 0)


def _posts(gaps: DataFrame, held: DataFrame, group: list[str], size: int) -> DataFrame:
    """Stretches of ``size`` that hold one of ``gaps`` (after, n): block, rows to be put in, rows
    that are there at most, and the keys of the posts around them."""
    block = F.floor(F.col("after") / size) if size else F.lit(0)
    stretches = gaps.groupBy(*group, block.cast("long").alias("block")).agg(F.sum("n").alias("n"))
    if not size:
        return stretches.select(*group, "block", *[F.lit(None).cast("long").alias(c) for c in ("low", "high")], F.lit(True).alias("room"))
    posts = held.filter(F.col("rank") % size == 0).select(*group, (F.col("rank") / size).cast("long").alias("block"), "key")
    low = posts.withColumnRenamed("key", "low")
    high = posts.select(*group, (F.col("block") - 1).alias("block"), F.col("key").alias("high"))
    found = stretches.join(low, [*group, "block"], "left").join(high, [*group, "block"], "left")
    room = F.col("low").isNull() | F.col("high").isNull() | (F.col("high") - F.col("low") > F.col("n") + size - 1)
    return found.select(*group, "block", "low", "high", room.alias("room"))


def _spread() -> Column:
    """Key of the ``at``-th of ``n`` rows between the posts: evenly, or in steps beyond one post."""
    even = F.expr("low + cast(cast(high - low as decimal(38, 0)) * at div (n + 1) as bigint)")
    return F.coalesce(even, F.col("low") + F.col("at") * SPACE, F.col("high") - (F.col("n") + 1 - F.col("at")) * SPACE, F.col("at") * SPACE)


def keys_between(held: DataFrame, new: DataFrame, gone: DataFrame, group: list[str], id: str) -> DataFrame:
    """Rows to be written so that ``new`` stand where they should: group, ``id``, key.

    ``held``: group, ``id``, rank (from 1, in order) and key (ascending with rank).  ``new``: group,
    ``id``, after (the rank of the row before it, 0 for none) and turn (order of new rows after the
    same one).  ``gone``: group and ``id`` of held rows that are not to be numbered again.  What is
    returned are the new rows, and held ones only of stretches that had no room.
    """
    held, new = held.select(*group, id, "rank", F.col("key").cast("long").alias("key")), new.select(*group, id, "after", "turn")
    open_gaps = gaps = settled(new.groupBy(*group, "after").agg(F.count("*").alias("n")))
    chosen = []
    for size in STRETCHES:
        # A larger stretch has to hold all that is put into it, not only what found no room so far.
        block = (F.floor(F.col("after") / size) if size else F.lit(0)).cast("long")
        wanted = open_gaps.select(*group, block.alias("block")).distinct()
        stretches = _posts(gaps.withColumn("block", block).join(wanted, [*group, "block"], "left_semi").drop("block"), held, group, size)
        found = settled(stretches)
        chosen.append(found.filter("room").select(*group, F.lit(size).alias("size"), "block", "low", "high"))
        full = found.filter("not room").select(*group, "block")
        open_gaps = settled(open_gaps.withColumn("block", block).join(full, [*group, "block"], "left_semi").drop("block"))
        if open_gaps.isEmpty():
            break
    sizes = STRETCHES[: len(chosen)]
    picked = settled(reduce(DataFrame.unionByName, chosen))
    inside = held.join(gone.select(*group, id), [*group, id], "left_anti").select(*group, id, F.col("rank").alias("after"), F.lit(0).alias("turn"), F.lit(True).alias("old"))
    rows = inside.filter(F.lit(len(sizes) > 1)).unionByName(new.withColumn("old", F.lit(False)))
    # Each row belongs to the largest chosen stretch that it lies in.
    taken = []
    for size in reversed(sizes):
        block = (F.floor(F.col("after") / size) if size else F.lit(0)).cast("long")
        post = F.col("old") & (F.col("after") % size == 0) if size else F.lit(False)
        blocks = picked.filter(F.col("size") == size)
        at = rows.withColumn("block", block)
        taken.append(at.filter(~post).join(blocks, [*group, "block"]))
        rows = at.join(blocks.select(*group, "block"), [*group, "block"], "left_anti").select(*rows.columns)
    placed = settled(reduce(DataFrame.unionByName, taken))
    own = [*group, "size", "block"]
    ranked = grouped_rank(placed, own, [("after", "asc"), ("old", "desc"), ("turn", "asc"), (id, "asc")], "at")
    counts = placed.groupBy(*own).agg(F.count("*").alias("n"))
    return ranked.join(counts, own).select(*group, id, _spread().alias("key"))
