"""Row numbers that stay distributed when one group holds most of the rows.

A window numbers a group in a single task.  Here the rows are dealt out in ranges of (group, order),
so that a large group is many ranges; each range is numbered on its own and shifted by the rows of
its group in the ranges before.  The ranges are kept in the shared folder, so every later step and
every retry of a task sees the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curioshelf.functions.keys import ordered
from curioshelf.session import settled


def grouped_rank(
    df: DataFrame,
    group: list[str],
    order: list[tuple[str, str]],
    name: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``name``: the 1-based place of each row in its group.

    ``order`` is a list of (column, "asc" | "desc"); together with the group columns it must
    identify a row.  NULL and NaN are placed as in any sort, NULL group columns form a group.  The
    number of ranges is that of shuffle partitions, as for any other shuffle, unless it is given.
    ``df`` is read once.
    """
    sort = [ordered(F.col(c), d) for c, d in order]
    spread = [*[F.col(g).asc() for g in group], *sort]
    ranged = df.repartitionByRange(ranges, *spread) if ranges else df.repartitionByRange(*spread)
    sliced = settled(ranged.withColumn("_slice", F.spark_partition_id()))
    by_group = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sliced.groupBy(*group, "_slice").count().withColumn("_shift", F.sum("count").over(earlier))
    # A range begins with the rest of one group at most, so this has a row for each range at most.
    shift = shift.filter("_shift > 0").select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_slice").alias("_slice_at"), "_shift")
    in_slice = Window.partitionBy(*group, "_slice").orderBy(*sort)
    numbered = sliced.withColumn("_local", F.row_number().over(in_slice))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_slice") == F.col("_slice_at")]
    placed = numbered.join(F.broadcast(shift), reduce(lambda p, q: p & q, same), "left")
    return placed.select(*df.columns, (F.col("_local") + F.coalesce("_shift", F.lit(0))).alias(name))
