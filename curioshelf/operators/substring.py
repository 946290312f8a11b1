"""A stored index for substring search: which rows hold which three characters in a row.

Lists of ids, one for each run of three characters (gram) of the lower-cased text, are stored sorted by
gram and id, in folders by the hash of the gram.  A search reads the lists of the rarest grams of what
is looked for, keeps the ids that are in all of them, and checks the texts of these rows alone.  As the
texts are checked as they are now, a list may name rows that have changed since or are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.predicates import has_text
from curioshelf.session import kept

GRAM = 3
# Lists that one search intersects: the rarest ones.
LISTS = 3
_LIST = "gram string, id {}, bucket int"
_COUNT = "gram string, n bigint, bucket int"


def _bucket(buckets: int):
    return F.pmod(F.hash("gram"), F.lit(buckets)).cast("int")


def grams(rows: DataFrame, field: str) -> DataFrame:
    """(gram, id) for every different gram of a row's lower-cased text; rows with a null text or with
    fewer than three characters have none."""
    # A match is empty and looks ahead, so the next one starts a character later; none starts inside a
    # pair of surrogates.
    runs = F.regexp_extract_all(F.lower(F.col(field)), F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{GRAM}}}))"), F.lit(1))
    return rows.select(F.explode(F.array_distinct(runs)).alias("gram"), "id")


def add_grams(rows: DataFrame, field: str, folder: str, buckets: int = 256) -> None:
    """Files the texts of new and changed rows (id and ``field``).  The first call makes the index; all
    calls have the same number of buckets.  A gram that very many rows hold is cut by id."""
    # Texts are cut once: counting, the bounds of the ranges and the lists read what is stored here.
    listed = kept(grams(rows, field)).withColumn("bucket", _bucket(buckets))
    counts = listed.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{folder}/counts")
    order = ["bucket", "gram", "id"]
    ranged = listed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("append").partitionBy("bucket").parquet(f"{folder}/lists")


def rarest_grams(spark, folder: str, text: str, buckets: int = 256) -> list[tuple[str, int, int]]:
    """(gram, bucket, rows at most) of ``text`` for the lists that are read, rarest first.  A gram that no
    row holds has 0 and is then the only one.  No more rows than the text has grams come here."""
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    asked = spark.createDataFrame([(g,) for g in wanted], "gram string").withColumn("bucket", _bucket(buckets))
    places = dict(map(tuple, asked.collect()))
    stored = spark.read.schema(_COUNT).parquet(f"{folder}/counts")
    near = stored.filter(F.col("bucket").isin(sorted(set(places.values()))) & F.col("gram").isin(wanted))
    counts = dict(map(tuple, near.groupBy("gram").agg(F.sum("n")).collect()))
    found = sorted(((g, b, counts.get(g, 0)) for g, b in places.items()), key=lambda x: (x[2], x[0]))
    return found[:1] if found[0][2] == 0 else found[:LISTS]


def search_grams(rows: DataFrame, field: str, folder: str, text: str, buckets: int = 256) -> DataFrame:
    """The rows of ``rows`` whose ``field`` contains ``text``, regardless of case: what a filter with
    :func:`has_text` keeps, found through the index.  A text of fewer than three characters has no gram
    and every row is looked at; rows with a null id are not filed and must not be asked for."""
    holds = has_text(F.col(field), text)
    if len(text.lower()) < GRAM:
        return rows.filter(holds)
    spark = rows.sparkSession
    lists = spark.read.schema(_LIST.format(rows.schema["id"].dataType.simpleString())).parquet(f"{folder}/lists")
    ids = None
    for gram, bucket, _ in rarest_grams(spark, folder, text, buckets):
        held = lists.filter((F.col("bucket") == bucket) & (F.col("gram") == gram)).select("id")
        ids = held if ids is None else ids.join(held, "id", "left_semi")
    return rows.join(ids, "id", "left_semi").filter(holds)
