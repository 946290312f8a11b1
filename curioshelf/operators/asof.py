"""What was known at a time: the last row of a log before it, unless that is too old.

Both sides are merged into one stream in order of key and time, dealt out in ranges, so a key that
holds a third of all rows is many ranges.  Each range carries the last log row forward by itself.  A
range starts with the rest of one key at most; what was last known of that key is handed over from the
ranges before, one row a range.  No row meets more than one row of the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curioshelf.session import settled


def as_of(asked: DataFrame, log: DataFrame, key: str, time: str, at: str, within: str) -> DataFrame:
    """``asked`` with ``known``: the newest row of ``log``, as a struct, that has its ``key``, is not
    after its ``time`` and is younger than the interval ``within`` (such as ``INTERVAL '24' HOUR``) by
    then; null without one.

    ``key`` is a column of both, ``time`` one of ``asked`` and ``at`` one of ``log``.  Of log rows of one
    key and time always the same counts, by a hash of its other columns.  Rows of ``asked`` with a null
    key or time stay and know nothing; such log rows are not looked at.  Repeated rows stay repeated.
    """
    rest = [c for c in log.columns if c not in (key, at)]
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    none = lambda df: F.lit(None).cast(df.schema.simpleString())
    row, known = F.struct(*asked.columns), F.struct(*log.columns)
    rows = asked.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), row.alias("_row"), none(log).alias("_known"))
    news = log.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), none(asked).alias("_row"), known.alias("_known")
    )
    ranged = rows.unionByName(news).repartitionByRange("_k", "_t")
    sliced = settled(ranged.withColumn("_slice", F.spark_partition_id()))
    # What each range knows last of its last key, and the first later range that starts with that key.
    ends = sliced.groupBy("_slice").agg(F.min("_k").alias("_first"), F.max("_k").alias("_k"))
    order = F.struct("_t", "_tie")
    told = sliced.where("_side = 0").join(ends.select("_slice", "_k"), ["_slice", "_k"], "left_semi")
    told = told.groupBy("_slice", "_k").agg(F.max_by("_known", order).alias("_told"))
    last = ends.select("_slice", "_k").join(told, ["_slice", "_k"], "left")
    starts = ends.select("_slice", F.col("_first").alias("_k"))
    edges = last.select("_slice", "_k", F.lit(1).alias("_end"), "_told").unionByName(starts.select("_slice", "_k", F.lit(0).alias("_end"), none(log).alias("_told")))
    before = Window.partitionBy("_k").orderBy("_slice", "_end").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    carried = edges.withColumn("_carried", F.last("_told", True).over(before)).where("_end = 0 and _carried is not null").select("_slice", "_k", "_carried")
    so_far = Window.partitionBy("_slice", "_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = sliced.withColumn("_seen", F.last("_known", True).over(so_far)).where("_side = 1")
    found = seen.join(F.broadcast(carried), ["_slice", "_k"], "left").withColumn("_seen", F.coalesce("_seen", "_carried"))
    fresh = F.coalesce(F.col("_seen")[at] > F.col("_t") - F.expr(within), F.lit(False))
    return found.select("_row.*", F.when(fresh, F.col("_seen")).alias("known"))
