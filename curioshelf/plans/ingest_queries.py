"""Bulk import and the streams, over files that Spark writes from the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from curioshelf.plans.registry import query
from curioshelf.session import scratch
from curioshelf.sources import ingest
from curioshelf.streaming import streams


def _bulk_files(v) -> str:
    """The bulk records as JSON lines, the first take before the second; returns the folder."""
    folder = scratch(v.spark)
    records = v.bulk.withColumnRenamed("set_code", "set").withColumn("unknown_field", F.lit(1))
    for take in (1, 2):
        records.filter(F.col("take") == take).drop("take").write.json(f"{folder}/take{take}")
    return folder


def _bulk(v):
    return ingest.catalog_read_json(v.spark, f"{_bulk_files(v)}/*")


FLAGS = "coalesce(variation, false) or coalesce(digital, false) or coalesce(oversized, false)"
PASSES = f"not ({FLAGS}) and type_line <> '' and type_line not in ('Card', 'Card // Card')"
COMPLETE = """type_line <> '' and border_color <> '' and image_status <> '' and name <> '' and lang <> ''
 and layout <> '' and cmc is not null and collector_number <> '' and rarity <> '' and set_code <> ''"""
FIRST = f"""(select * from (select *, row_number() over (partition by id order by take) rn from bulk
 where {PASSES} and {COMPLETE}) t where rn = 1) f"""


@query("catalog_read_json", 'select id, name, type_line, set_code as "set", variation from bulk')
def catalog_read_json(v):
    return _bulk(v).select("id", "name", "type_line", "set", "variation")


def _as_array(batches):
    """The rows of a partition with brackets and commas, which make one array of them."""
    before = "["
    for batch in batches:
        values = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"value": [(", " if n else before) + value for n, value in enumerate(values)]})
        before = ", " if values else before
    yield pa.RecordBatch.from_pydict({"value": ["]" if before != "[" else "[]"]})


@query("catalog_read_array", 'select id, name, type_line, set_code as "set", variation from bulk where take = 1')
def catalog_read_array(v):
    """The same records as JSON arrays, one to a file, several elements to a line."""
    folder = scratch(v.spark)
    records = v.bulk.filter("take = 1").withColumnRenamed("set_code", "set")
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).mapInArrow(_as_array, "value string").write.option("lineSep", "  ").text(folder)
    return ingest.catalog_read_json(v.spark, folder, array=True).select("id", "name", "type_line", "set", "variation")


@query("catalog_schema_enforce", f"select id, name, cmc, border_color from bulk where {COMPLETE}")
def catalog_schema_enforce(v):
    return ingest.catalog_schema_enforce(_bulk(v)).select("id", "name", "cmc", "border_color")


@query("catalog_import_filter", f"select id, name from bulk where {PASSES}")
def catalog_import_filter(v):
    return ingest.catalog_import_filter(_bulk(v)).select("id", "name")


def _imported(v):
    good = ingest.catalog_schema_enforce(ingest.catalog_import_filter(_bulk(v)))
    return ingest.catalog_dedupe(good)


@query("catalog_dedupe", f"select id, name, cmc from {FIRST}")
def catalog_dedupe(v):
    return _imported(v).select("id", "name", "cmc")


@query(
    "catalog_import_report",
    f"""with judged as (select id, CASE WHEN variation THEN 'variation' WHEN digital THEN 'digital'
      WHEN oversized THEN 'oversized' WHEN coalesce(type_line, '') = '' THEN 'no type_line'
      WHEN type_line in ('Card', 'Card // Card') THEN 'not a card'
      WHEN border_color is null THEN 'missing border_color'
      WHEN image_status = '' THEN 'missing image_status' END outcome from bulk)
    select outcome, count(*) n from judged where outcome is not null group by outcome
    union all select 'imported', count(distinct id) from judged where outcome is null
    union all select 'duplicate', count(*) - count(distinct id) from judged where outcome is null""",
)
def catalog_import_report(v):
    return ingest.catalog_import_report(_bulk(v))


@query("catalog_overwrite", f"select id, name, cmc from {FIRST}")
def catalog_overwrite(v):
    """The stored catalogue after a first version has been replaced by the import."""
    path = scratch(v.spark)
    imported = _imported(v).select("id", "name", "cmc")
    ingest.catalog_overwrite(imported.limit(0), path)
    ingest.catalog_overwrite(imported, path)
    return ingest.catalog_current(v.spark, path)


@query(
    "catalog_refresh",
    """with u as (select *, row_number() over (partition by id order by take desc) rn from bulk
      where border_color <> 'black' or cmc > 6)
    select id, name, cmc from u where rn = 1 union all
    select CAST(id AS STRING), name, cmc from cards where CAST(id AS STRING) not in (select id from u)""",
)
def catalog_refresh(v):
    updates = v.bulk.filter("border_color <> 'black' or cmc > 6").select("id", "name", "cmc", "take")
    base = v.cards.select(F.col("id").cast("string").alias("id"), "name", "cmc")
    return ingest.catalog_refresh(base, updates, by="take")


@query(
    "catalog_lookup",
    "select id, name from cards where id in (select card_id from copies where owner = 2 and qty > 40)",
)
def catalog_lookup(v):
    wanted = v.copies.filter("owner = 2 and qty > 40").select(F.col("card_id").alias("id"))
    return ingest.catalog_lookup(v.cards, wanted).select("id", "name")


@query("ingest_stream", f"select id, name, cmc from {FIRST}")
def ingest_stream(v):
    sink, checkpoint = scratch(v.spark), scratch(v.spark)
    stream = streams.ingest_stream(v.spark, f"{_bulk_files(v)}/*", sink, checkpoint, 1)
    stream.awaitTermination()
    return v.spark.read.parquet(sink).select("id", "name", "cmc")


@query(
    "price_upsert_stream",
    """select card_id, CAST(usd AS DOUBLE) usd from (select *, row_number() over
    (partition by card_id order by updated_at desc) rn from price_log) t where rn = 1""",
)
def price_upsert_stream(v):
    source, sink, checkpoint = scratch(v.spark), scratch(v.spark), scratch(v.spark)
    v.price_log.repartition(3, "updated_at").write.parquet(source)
    updates = (
        v.spark.readStream.schema(v.price_log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    streams.price_upsert_stream(updates, sink, checkpoint).awaitTermination()
    return streams.stored_prices(v.spark, sink).select(
        "card_id", F.col("usd").cast("double").alias("usd")
    )


@query(
    "price_stale_stream",
    """select card_id, updated_at from (select card_id, max(updated_at) updated_at from price_log group by card_id) t
    where updated_at <= (select max(updated_at) from price_log) - INTERVAL '24' HOUR""",
)
def price_stale_stream(v):
    """Cards that are stale when the last update of the log comes in."""
    source, sink, checkpoint = scratch(v.spark), scratch(v.spark), scratch(v.spark)
    v.price_log.write.parquet(source)
    updates = v.spark.readStream.schema(v.price_log.schema).parquet(source)
    streams.price_stale_stream(updates, sink, checkpoint, delay="0 seconds").awaitTermination()
    return streams.stale_now(v.spark, sink, streams.latest(v.price_log, "card_id", "updated_at"))
