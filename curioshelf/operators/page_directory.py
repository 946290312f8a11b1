"""Pages of a stored order, found in a directory of its ranges.

The rows are stored in the order, cut in ranges of bounded size, each row with its place in its range.
Small ranges share a file, sorted by range, so that files grow with the rows and not with the ranges.
The directory has a row for each range: the first key, the number of rows, the folder and the file in
it.  A page is found by the counts, on two levels, and read from its ranges alone, by
a filter on the place that reaches the scan.  Changes rewrite only the ranges that they fall in.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curioshelf.functions.keys import ordered, sort_key
from curioshelf.operators.ranking import grouped_rank
from curioshelf.session import settled
from curioshelf.sources.ingest import catalog_current, catalog_overwrite

RANGE_ROWS = 1 << 20
SHELF = 4096  # ranges


def _write_ranges(rows: DataFrame, owner: list[str], path: str, direction: str, range_rows: int) -> DataFrame:
    """Stores ``rows`` (with _sort) in new ranges, none across two owners; returns their entries."""
    placed = grouped_rank(rows, owner, [("_sort", direction), ("id", "asc")], "_place")
    piece = F.floor((F.col("_place") - 1) / range_rows).cast("string")
    # A letter first: a name must not read as a number or a date.
    name = F.concat_ws("-", F.lit("r"), *[F.col(c).cast("string") for c in owner], piece)
    cut = settled(placed.withColumn("range", name).withColumn("_at", (F.col("_place") - 1) % range_rows).drop("_place", *owner))
    folder = f"{path}/rows-{uuid.uuid4().hex}"
    file = F.pmod(F.hash("range"), F.lit(cut.count() // RANGE_ROWS + 1)).cast("int").alias("file")
    filed = cut.select("*", file).repartition("file").sortWithinPartitions("file", "range", "_at")
    filed.write.partitionBy("file").parquet(folder)
    first = F.min_by(F.struct("_sort", "id"), "_at")
    entries = cut.groupBy("range").agg(first.alias("low"), F.count("*").alias("n"))
    return entries.select(F.lit(folder).alias("folder"), file, "range", F.col("low._sort").alias("_sort"), F.col("low.id").alias("id"), "n")


def _numbered(entries: DataFrame, path: str, direction: str) -> None:
    ranked = grouped_rank(entries, [], [("_sort", direction), ("id", "asc")], "no")
    catalog_overwrite(ranked, f"{path}/directory")


def write_directory(rows: DataFrame, path: str, order: str = "name", direction: str = "asc", range_rows: int = RANGE_ROWS) -> None:
    """Stores ``rows``, with distinct ids, in an order of the catalogue.  An empty table has no ranges."""
    keyed = rows.withColumn("_sort", sort_key(order, direction))
    keyed.limit(0).withColumn("range", F.lit("")).withColumn("_at", F.lit(0).cast("bigint")).write.parquet(f"{path}/schema")
    _numbered(_write_ranges(keyed, [], path, direction, range_rows), path, direction)


def _owners(directory: DataFrame, keys: DataFrame, direction: str) -> DataFrame:
    """``keys`` (_sort, id, gone) with ``no``, the range that each falls in: the last that starts at the
    key or before it.  Both are dealt out in the order; a slice hands its last range on to the next."""
    starts = directory.select("_sort", "id", F.lit(None).cast("boolean").alias("gone"), "no")
    both = starts.unionByName(keys.select("_sort", "id", "gone", F.lit(None).cast("bigint").alias("no")))
    sort = [ordered(F.col("_sort"), direction), F.col("id").asc()]
    sliced = settled(both.repartitionByRange(*sort).withColumn("_slice", F.spark_partition_id()))
    # A row for each slice.
    last = sliced.groupBy("_slice").agg(F.max("no").alias("_last"))
    handed = last.select("_slice", F.max("_last").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_handed"))
    so_far = F.max("no").over(Window.partitionBy("_slice").orderBy(*sort, F.col("no").asc_nulls_last()))
    inside = sliced.withColumn("_own", so_far).filter("gone is not null").join(handed, "_slice")
    # What comes before the first range belongs to it.
    return inside.select("_sort", "id", "gone", F.coalesce("_own", "_handed", F.lit(1).cast("bigint")).alias("no"))


def update_directory(spark: SparkSession, path: str, before: DataFrame, after: DataFrame, order: str = "name", direction: str = "asc", range_rows: int = RANGE_ROWS) -> int:
    """Takes the rows ``before`` out and puts ``after`` in; a changed row is in both, as it was and as it
    is.  Only ranges that one of them falls in are read and written, and cut where they have grown too
    long; the directory is written anew and switched over.  Returns the number of ranges rewritten."""
    directory = settled(catalog_current(spark, f"{path}/directory"))
    key = sort_key(order, direction).alias("_sort")
    keys = before.select(key, "id", F.lit(True).alias("gone")).unionByName(after.select(key, "id", F.lit(False).alias("gone")))
    owned = settled(_owners(directory, keys, direction))
    touched = settled(directory.join(owned.select("no").distinct(), "no", "left_semi"))
    schema = spark.read.parquet(f"{path}/schema").schema
    fields = [f for f in schema.names if f not in ("range", "_at")]
    came = after.withColumn("_sort", sort_key(order, direction)).join(owned.filter("not gone").select("id", "no"), "id").select(*fields, "no")
    held = []
    # One folder for each update that has left a range.
    for (folder,) in touched.select("folder").distinct().collect():
        wanted = touched.filter(F.col("folder") == folder).select("file", "range", "no")
        stored = spark.read.schema(schema).parquet(folder)
        held.append(stored.join(wanted, ["file", "range"]).select(*fields, "no"))
    gone = owned.filter("gone").select("id")
    rows = reduce(DataFrame.unionByName, held).join(gone, "id", "left_anti").unionByName(came) if held else came
    written = _write_ranges(rows, ["no"], path, direction, range_rows)
    kept = directory.join(touched.select("no"), "no", "left_anti").select(*written.columns)
    _numbered(kept.unionByName(written), path, direction)
    return touched.count()


def _before(directory: DataFrame, inside) -> DataFrame:
    """Entries with ``before``, the rows of all ranges before each; ``inside(before, n)`` picks shelves
    and entries, so that only shelves that hold what is wanted are looked through."""
    shelved = directory.withColumn("shelf", F.floor((F.col("no") - 1) / SHELF))
    shelves = shelved.groupBy("shelf").agg(F.sum("n").alias("_n"))
    earlier = shelves.withColumn("_before", F.sum("_n").over(Window.orderBy("shelf")) - F.col("_n"))
    near = earlier.filter(inside(F.col("_before"), F.col("_n"))).drop("_n")
    so_far = F.sum("n").over(Window.partitionBy("shelf").orderBy("no")) - F.col("n")
    placed = shelved.join(near, "shelf").withColumn("before", F.col("_before") + so_far)
    return placed.filter(inside(F.col("before"), F.col("n"))).drop("shelf", "_before")


def page_ranges(spark: SparkSession, path: str, page: int, page_len: int) -> list[tuple[str, str, int, int]]:
    """(folder of a range, the range, rows before it, its rows) for the ranges that hold a page, at most one for
    each of its rows."""
    if page < 1 or page_len < 1:
        raise ValueError("page and page_len start at 1")
    first, last = (page - 1) * page_len, page * page_len
    found = _before(catalog_current(spark, f"{path}/directory"), lambda before, n: (before < last) & (before + n > first))
    place = F.concat_ws("/", "folder", F.concat(F.lit("file="), F.col("file").cast("string"))).alias("place")
    return [tuple(r) for r in found.orderBy("no").select(place, "range", "before", "n").collect()]


def stored_page(spark: SparkSession, path: str, page: int = 1, page_len: int = 100) -> DataFrame:
    """Rows of one page, in order, with ``row_no``; none beyond the last page."""
    empty = spark.read.parquet(f"{path}/schema")
    first = (page - 1) * page_len
    parts = []
    for place, name, before, _ in page_ranges(spark, path, page, page_len):
        rows = spark.read.schema(empty.schema).parquet(place).filter(F.col("range") == name)
        part = rows.filter((F.col("_at") >= first - before) & (F.col("_at") < first - before + page_len))
        parts.append(part.withColumn("row_no", F.col("_at") + before + 1))
    every = reduce(DataFrame.unionByName, parts) if parts else empty.withColumn("row_no", F.col("_at"))
    return every.drop("_at", "_sort", "range").orderBy("row_no")


def stored_page_info(spark: SparkSession, path: str, page: int = 1, page_len: int = 100) -> DataFrame:
    """One row: total, page, page_len, total_pages and whether more pages follow, by the directory."""
    total = catalog_current(spark, f"{path}/directory").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    pages = F.ceil(F.col("total") / page_len).cast("bigint")
    more = (F.lit(page) < pages).alias("has_more")
    return total.select("total", F.lit(page).alias("page"), F.lit(page_len).alias("page_len"), pages.alias("total_pages"), more)
