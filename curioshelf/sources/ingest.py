"""Bulk import of the catalogue: read, check, filter, dedupe, report, store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curioshelf.sources.json_array import read_elements
from curioshelf.sources.schema import (
    CARD,
    IMPORT,
    IMPORT_FLAGS,
    REQUIRED,
    REQUIRED_IN_FACE,
    REQUIRED_IN_PART,
)

POINTER = "CURRENT"
# Type lines that mark a record as no playable card.
NOT_A_CARD = ["Card", "Card // Card"]


def catalog_read_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Card records from JSON lines, or with ``array`` from files that hold one JSON array each.

    An array may be laid out in any way, and a large file is read in many tasks; see ``json_array``.
    Fields that the schema does not name are dropped.  The record's place in the input is kept in
    ``seq``.
    """
    if not array:
        return spark.read.schema(IMPORT).json(path).withColumn("seq", record_place())
    parsed = read_elements(spark, path).select(F.from_json("text", IMPORT).alias("record"), "seq")
    return parsed.select("record.*", "seq")


def record_place() -> Column:
    """File, block of the file, and place in the block that a record was read from."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _missing(field: str) -> Column:
    """NULL, or an empty text."""
    return F.col(field).isNull() | (F.col(field).cast("string") == "")


def _incomplete(array: str, fields: list[str]) -> Column:
    """Whether some element of an array of structs lacks a required field."""
    lacks = F.exists(array, lambda e: F.greatest(*[e[f].isNull() for f in fields], F.lit(False)))
    return F.coalesce(lacks, F.lit(False))


def reject_reason() -> Column:
    """Why a record is not imported, or NULL.  The import filter comes before the schema check."""
    flags = [F.when(F.col(f), F.lit(f)) for f in IMPORT_FLAGS]
    missing = [F.when(_missing(f), F.lit(f"missing {f}")) for f in REQUIRED]
    return F.coalesce(
        *flags,
        F.when(_missing("type_line"), F.lit("no type_line")),
        F.when(F.col("type_line").isin(NOT_A_CARD), F.lit("not a card")),
        *missing,
        F.when(_incomplete("all_parts", REQUIRED_IN_PART), F.lit("incomplete part")),
        F.when(_incomplete("card_faces", REQUIRED_IN_FACE), F.lit("incomplete face")),
    )


def catalog_import_filter(records: DataFrame) -> DataFrame:
    """Without variations, digital-only and oversized records, and without non-cards."""
    for flag in IMPORT_FLAGS:
        records = records.filter(F.col(flag).isNull() | ~F.col(flag))
    type_line = F.col("type_line")
    return records.filter(~_missing("type_line") & ~type_line.isin(NOT_A_CARD))


def catalog_schema_enforce(records: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Declared fields only, cast to their types, and only records with all required fields; an
    empty text does not fill a required field."""
    names = records.columns
    cast = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CARD.fields if f.name in names]
    complete = records.select(*cast, *[c for c in ("seq",) if c in names])
    for name in required:
        complete = complete.filter(~_missing(name))
    if "all_parts" in names:
        complete = complete.filter(~_incomplete("all_parts", REQUIRED_IN_PART))
    if "card_faces" in names:
        complete = complete.filter(~_incomplete("card_faces", REQUIRED_IN_FACE))
    return complete


def catalog_dedupe(records: DataFrame) -> DataFrame:
    """The first record of every id, by ``seq``.  The rank filter also runs before the shuffle, so
    an id with very many records costs one row per task."""
    first = Window.partitionBy("id").orderBy("seq")
    ranked = records.withColumn("_rn", F.row_number().over(first))
    return ranked.filter(F.col("_rn") == 1).drop("_rn", "seq")


def catalog_import_report(records: DataFrame) -> DataFrame:
    """Records per outcome: imported, duplicate, or the reason for rejecting them."""
    # Ids only matter among accepted records, so a rejected one counts under its reason alone.
    reason = reject_reason()
    keyed = records.select(reason.alias("reason"), F.when(reason.isNull(), F.col("id")).alias("id"))
    counts = keyed.groupBy("reason", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.coalesce("reason", F.lit("imported")).alias("outcome"), F.when(F.col("reason").isNull(), 1).otherwise(F.col("n")).alias("n"))
    more = F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - 1).alias("n"))
    parts = F.when(F.col("reason").isNull(), F.array(first, more)).otherwise(F.array(first))
    told = counts.select(F.inline(parts)).groupBy("outcome").agg(F.sum("n").alias("n"))
    # Both outcomes of accepted records are told even when there is none.
    always = records.sparkSession.createDataFrame([("imported", 0), ("duplicate", 0)], "outcome string, n bigint")
    return told.unionByName(always).groupBy("outcome").agg(F.sum("n").alias("n"))


def catalog_lookup(cards: DataFrame, ids) -> DataFrame:
    """Cards by id: a list of a few ids, or a DataFrame with an ``id`` column."""
    if isinstance(ids, DataFrame):
        return cards.join(ids.select("id").distinct(), "id", "left_semi")
    return cards.filter(F.col("id").isin(list(ids)))


def catalog_refresh(base: DataFrame, updates: DataFrame, by: str = "seq") -> DataFrame:
    """The catalogue with every updated card replaced; the last update per id counts.

    ``updates`` has the columns of ``base`` and ``by``.
    """
    last = Window.partitionBy("id").orderBy(F.col(by).desc())
    newest = updates.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") == 1)
    fresh = newest.select(*base.columns)
    return base.join(fresh, "id", "left_anti").select(*base.columns).unionByName(fresh)


# -- storing ----------------------------------------------------------------------------------


def _pointer(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def catalog_overwrite(df: DataFrame, path: str) -> str:
    """Replace the stored catalogue.  A new snapshot is written in full before a small pointer file
    is switched over to it, so readers never see half a catalogue and the old snapshot stays
    readable.  Returns the path of the snapshot."""
    snapshot = f"{path}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(snapshot)
    jvm = df.sparkSession._jvm
    fs, pointer = _pointer(df.sparkSession, path)
    written = jvm.org.apache.hadoop.fs.Path(f"{snapshot}.pointer")
    out = fs.create(written, True)
    out.write(bytearray(snapshot.encode()))
    out.close()
    # One rename that replaces the old pointer: a reader finds the old text or the new, never none.
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), df.sparkSession._jsc.hadoopConfiguration())
    overwrite = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(written, files.makeQualified(pointer), overwrite)
    return snapshot


def catalog_current(spark: SparkSession, path: str) -> DataFrame:
    """The stored catalogue that the pointer names."""
    snapshot = spark.read.text(f"{path}/{POINTER}").first()[0]
    return spark.read.parquet(snapshot)
