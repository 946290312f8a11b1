"""One key holds a large part of the rows: plans must split it, and results must stay whole."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from curioshelf.operators import joins, prices, rollups, searches
from curioshelf.operators.maintenance import remove_group
from tests.helpers import cards_of, rows

ROWS = 60_000


@contextmanager
def settings(spark, **values):
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, value in values.items():
        spark.conf.set(names[k], value)
    yield
    for k, value in before.items():
        spark.conf.set(names[k], value) if value is not None else spark.conf.unset(names[k])


@pytest.fixture(scope="module")
def copies(spark):
    """Two thirds of the copies are of one card, in one collection and one deck."""
    hot = F.col("id") % 3 < 2
    return spark.range(0, ROWS, 1, 6).select(
        F.format_string("p%06d", "id").alias("copy_id"),
        F.lit("u").alias("owner"),
        F.when(hot, "c1").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("card_id"),
        F.when(hot, "k1").otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("collection_id"),
        F.when(hot, "d1").alias("deck_id"),
        F.lit(None).cast("string").alias("notes"),
        F.array(F.lit("b"), F.lit("a")).alias("tags"),
    )


@pytest.fixture(scope="module")
def cards(spark):
    return cards_of(spark, *[{"name": f"n{i % 7}"} for i in range(500)])


@pytest.fixture(scope="module")
def names(spark):
    return (
        spark.range(100).select(F.concat(F.lit("k"), "id").alias("id"), F.concat(F.lit("Box "), "id").alias("name")),
        spark.range(3).select(F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("Deck "), "id").alias("name")),
    )


def test_a_hot_card_is_split_in_look_up_joins(spark, copies, cards, names):
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="64k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__coalescePartitions__minPartitionSize="1k",
        shuffle__partitions="8",
    ):
        detailed = joins.detail_copies(copies, cards, *names)
        slim = detailed.select("copy_id", F.col("card.name").alias("n"), "collection_name")
        got = slim.collect()
        plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert len(got) == ROWS * 2 // 3 + copies.filter("card_id <> 'c1' and card_id <> 'c0'").count() + copies.filter(
        "card_id = 'c1' and deck_id is null"
    ).count()


def test_groups_combine_before_the_shuffle(copies, cards, names):
    groups = rollups.group_copies(copies, cards, names[1])
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    hot = groups.filter("deck_id = 'd1'").collect()
    assert [r.quantity for r in hot] == [ROWS * 2 // 3]


def test_owned_cards_shuffles_distinct_ids(copies, cards):
    plan = joins.owned_cards(cards, copies)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("HashAggregate")
    assert joins.owned_cards(cards, copies).count() == 499


def test_latest_ranks_before_the_shuffle(spark):
    log = spark.range(ROWS).select(
        F.when(F.col("id") == 7, "cold").otherwise("hot").alias("card_id"), F.col("id").cast("string").alias("usd"), F.col("id").alias("updated_at")
    )
    newest = prices.latest(log, "card_id", "updated_at")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert rows(newest, "card_id", "usd") == [("cold", "7"), ("hot", str(ROWS - 1))]


def test_most_of_a_hot_group_is_removed(spark, copies):
    asked = spark.createDataFrame(
        [("u", "k1", "c1", "d1", "", ["a", "b"], 30_000)],
        "owner string, collection_id string, card_id string, deck_id string, notes string, tags array<string>, quantity int",
    )
    decks = spark.createDataFrame([("d1", "u")], "id string, owner string")
    flat = copies.select("deck_id", F.lit("s").alias("section_id"), F.lit("c").alias("column_id"), F.lit(0).alias("pos"), "copy_id")
    left, _ = remove_group(copies, flat, decks, asked)
    assert left.count() == ROWS - 30_000
    gone = copies.join(left, "copy_id", "left_anti").agg(F.max("copy_id")).first()[0]
    kept = left.filter("deck_id = 'd1'").agg(F.min("copy_id")).first()[0]
    assert gone < kept


def test_saved_searches_with_a_hot_key(spark):
    """Every card has the same language, rarity and colours.  Searches without text are counted by
    cells, and one with text meets only the cards that have its rarest trigram."""
    named = cards_of(spark, *[{"id": str(i), "name": "Needle" if i % 1000 == 7 else "Haystack"} for i in range(4000)])
    stored = spark.createDataFrame(
        [(1, "en", 0, None, None, ["R"], None), (2, None, None, 9, None, None, None), (3, "en", 0, None, None, ["R"], "needle"), (4, None, None, None, None, None, None)],
        "search_id int, lang string, rarity_min int, cmc_min int, cmc_max int, colors array<string>, name_part string",
    )
    counts = {r.search_id: r.total for r in searches.saved_search_counts(stored, named).collect()}
    assert counts == {1: 4000, 2: 0, 3: 4, 4: 4000}
    only_text = stored.where("search_id = 3")
    grams = [F.transform(searches._grams("name", F.lower("name_part")), lambda g: F.array(g))]
    met = searches.candidates(only_text, named, [F.array(F.lit("lang:en"))], grams, {"lang", "name"})
    assert met.count() == 4


def test_counts_of_searches_without_text_meet_no_card(spark):
    """The join of the plan has a row for each combination of what cards are counted by."""
    cards = cards_of(spark, *[{"id": str(i), "cmc": float(i % 5)} for i in range(3000)])
    stored = spark.createDataFrame([(i, None, 0, i % 4, None, None, None) for i in range(50)], "search_id int, lang string, rarity_min int, cmc_min int, cmc_max int, colors array<string>, name_part string")
    counts = {r.search_id: r.total for r in searches.saved_search_counts(stored, cards).collect()}
    assert counts == {i: 600 * (5 - i % 4) for i in range(50)}
    pairs = searches.saved_search_match(stored, cards).groupBy("search_id").count()
    assert {r.search_id: r["count"] for r in pairs.collect()} == counts
