"""Streaming import of card files and streaming upkeep of the price cache.

All sinks append one directory per micro-batch (``batch=<id>``).  A batch that is run again after a
failure overwrites its own directory, so nothing is stored twice and nothing is rewritten.  What a
stream has to remember (ids seen, prices that will be stale) is keyed state of the query, kept with its
checkpoint and never read back from a sink.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from curioshelf.operators.prices import latest
from curioshelf.sources.ingest import catalog_dedupe, catalog_import_filter, catalog_schema_enforce
from curioshelf.sources.schema import CARD, IMPORT, REQUIRED


ONCE = {"availableNow": True}
# The time to live of a price, as the length of a pause.
STALE_AFTER = "24 hours"


# Fixed value: what a file name must not be taken for when a file is named again.
GLOB = re.compile(r"[\\{}\[\]*?]")
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'", "timestamp'1970-01-01 00:00:00Z'"


def _accepted(records: DataFrame, place: Column, required: list[str]) -> DataFrame:
    return catalog_schema_enforce(catalog_import_filter(records.withColumn("seq", place)), required)


def _named(spark: SparkSession, file: str) -> str:
    """A path to read, from the encoded address of a file."""
    return GLOB.sub(r"\\\g<0>", spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).toString())


def ingest_stream(
    spark: SparkSession,
    path: str,
    sink: str,
    checkpoint: str,
    files_per_batch: int = 16,
    required: list[str] = REQUIRED,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Import JSON-lines files as they appear, by the same rules as the bulk import.  A card that an
    earlier batch stored is not stored again.  ``trigger`` is that of ``writeStream``; as it stands,
    what is there is read and the stream ends.

    The query's state has the ids seen, each with the times of the first and the last batch that held
    it and the file it came in first: an id is new when the two times are the same.  A batch stores the
    cards of its new ids, from the files that hold them.  As the times belong to the batch, not to the
    run of it, a batch that runs again finds the same."""
    records = (
        spark.readStream.schema(IMPORT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .select("*", "_metadata.file_path")
    )
    came = F.struct("file_path", F.current_timestamp().alias("now"))
    seen = (
        _accepted(records, came, required)
        .groupBy("id")
        .agg(F.min("seq.now").alias("first"), F.max("seq.now").alias("last"), F.min("seq.file_path").alias("file"))
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        new = batch.filter(F.col("first") == F.col("last")).select("id", "file").persist()
        # No more than the files of a batch.
        files = [_named(here, r[0]) for r in new.select("file").distinct().collect()]
        cards = here.createDataFrame([], CARD)
        if files:
            again = here.read.schema(IMPORT).json(files).select("*", "_metadata.file_path", "_metadata.file_block_start")
            place = F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("at"))
            cards = catalog_dedupe(_accepted(again, place, required).join(new, "id", "left_semi"))
        cards.select(*CARD.names).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        new.unpersist()

    return (
        seen.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**trigger)
        .foreachBatch(store)
        .start()
    )


def price_upsert_stream(
    updates: DataFrame, sink: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Store the last price of every card of each micro-batch.  :func:`stored_prices` reads the
    cache; :func:`compact_prices` shortens it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, "card_id", "updated_at")
        newest.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        updates.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(store)
        .start()
    )


def stored_prices(spark: SparkSession, sink: str) -> DataFrame:
    """The last price of every card over all stored batches."""
    return latest(spark.read.parquet(sink), "card_id", "updated_at", "batch").drop("batch")


def compact_prices(spark: SparkSession, sink: str, compacted: str) -> None:
    """Write the last price of every card to a new cache, to which further batches can be added."""
    stored_prices(spark, sink).write.parquet(f"{compacted}/batch=-1")


def price_stale_stream(
    updates: DataFrame, sink: str, checkpoint: str, delay: str = "1 hour", trigger: dict = ONCE
) -> StreamingQuery:
    """Tell the prices (card_id, updated_at) that have become stale: those that no update of the card
    followed within their time to live.

    A card's updates are a session that ends a time to live after the last of them, so its state is one
    row and its end is a timer.  The clock is the latest ``updated_at`` seen less ``delay``; updates that
    come later than that are not timed, undated ones never.  A refresh begins a new session."""
    time = F.col("updated_at")
    if isinstance(updates.schema["updated_at"].dataType, TimestampNTZType):
        time = F.expr(f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, {EPOCH[0]}, updated_at), {EPOCH[1]})")
    dated = updates.filter("updated_at is not null").select("card_id", "updated_at", time.alias("_time"))
    ended = (
        dated.withWatermark("_time", delay)
        .groupBy(F.session_window("_time", STALE_AFTER), "card_id")
        .agg(F.max("updated_at").alias("updated_at"))
        .select("card_id", "updated_at")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        ended.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(store)
        .start()
    )


def stale_now(spark: SparkSession, sink: str, cache: DataFrame) -> DataFrame:
    """Cards told as stale that have not been refreshed since, by the rows of ``cache`` (card_id,
    updated_at)."""
    told = spark.read.parquet(sink).groupBy("card_id").agg(F.max("updated_at").alias("updated_at"))
    newer = cache.select("card_id", F.col("updated_at").alias("_at"))
    return told.join(newer, "card_id", "left").filter("_at is null or _at <= updated_at").select("card_id", "updated_at")
