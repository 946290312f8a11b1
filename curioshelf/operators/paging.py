"""Pages of a sorted catalogue, page totals, and simple listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.keys import ordered, sort_key
from curioshelf.operators.ranking import grouped_rank

# Up to here Spark's own top-k, which gathers the rows before the page, is the shorter way to the
# same rows; further in only sort keys are numbered, in a distributed way.
TOP_K_ROWS = 100_000


def page(
    df: DataFrame, order: str = "name", direction: str = "asc", page: int = 1, page_len: int = 100
) -> DataFrame:
    """Rows of one page, in order."""
    if page < 1 or page_len < 1:
        raise ValueError("page and page_len start at 1")
    sort = [ordered(sort_key(order, direction), direction), F.col("id").asc()]
    if page * page_len <= TOP_K_ROWS:
        return df.orderBy(*sort).offset((page - 1) * page_len).limit(page_len)
    keys = df.select("id", sort_key(order, direction).alias("_sort"))
    place = grouped_rank(keys, [], [("_sort", direction), ("id", "asc")], "_place")
    first = (page - 1) * page_len
    inside = place.filter((F.col("_place") > first) & (F.col("_place") <= first + page_len))
    # At most ``page_len`` ids.
    return df.join(F.broadcast(inside.select("id")), "id", "left_semi").orderBy(*sort)


def page_info(df: DataFrame, page: int = 1, page_len: int = 100) -> DataFrame:
    """One row: total, page, page_len, total_pages and whether more pages follow."""
    pages = F.ceil(F.col("total") / page_len).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_len).alias("page_len"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_more"),
    )


def assign_pages(
    df: DataFrame, order: str = "name", direction: str = "asc", page_len: int = 100
) -> DataFrame:
    """Every row with its place in the order (``row_no``) and its ``page``."""
    keyed = df.withColumn("_sort", sort_key(order, direction))
    ranked = grouped_rank(keyed, [], [("_sort", direction), ("id", "asc")], "row_no")
    return ranked.drop("_sort").withColumn("page", F.ceil(F.col("row_no") / page_len).cast("bigint"))


def merge_pages_dedupe(*pages: DataFrame) -> DataFrame:
    """All pages as one list: one row per id, the last version at the first position.

    Each page carries ``id`` and its place in the page (``row_no``).  The result's order is
    (``at_page``, ``at_row``).
    """
    tagged = [p.withColumn("_page", F.lit(i)) for i, p in enumerate(pages, 1)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    place = F.struct("_page", "row_no")
    fields = [c for c in pages[0].columns if c not in ("id", "row_no")]
    return (
        every.groupBy("id")
        .agg(F.min(place).alias("_first"), F.max_by(F.struct(*fields), place).alias("_last"))
        .select(
            "id",
            *[F.col("_last")[f].alias(f) for f in fields],
            F.col("_first._page").alias("at_page"),
            F.col("_first.row_no").alias("at_row"),
        )
    )


def list_recent(table: DataFrame, owner=None) -> DataFrame:
    """Collections or decks, most recently updated first; one owner's when ``owner`` is given."""
    mine = table if owner is None else table.filter(F.col("owner") == owner)
    listed = mine.select("id", "name", "is_active", "owner", "updated_at")
    return listed.orderBy(F.col("updated_at").desc(), F.col("id").asc()).drop("updated_at")


def list_tags(library: DataFrame) -> DataFrame:
    return library.select("label").orderBy("label")
