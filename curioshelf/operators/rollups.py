"""Grouping and counting of copies.  Copies are counted first and named afterwards, so that what is
shuffled and joined is one row per group, not one per copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.keys import collector_key, notes_key, tags_key


def _keyed(copies: DataFrame) -> DataFrame:
    return copies.withColumn("notes", notes_key()).withColumn("tags", tags_key())


def _known_cards(groups: DataFrame, cards: DataFrame) -> DataFrame:
    named = cards.select(F.col("id").alias("_card"), F.col("name").alias("card_name"))
    return groups.join(named, groups["card_id"] == F.col("_card")).drop("_card")


def group_copies(copies: DataFrame, cards: DataFrame, decks: DataFrame) -> DataFrame:
    """Display rows: quantity per (collection, card, notes, tags, deck).

    Which copies make up a row is answered by :func:`group_members`, one row per copy: a group may
    be too large for an array.
    """
    groups = (
        _keyed(copies)
        .groupBy("collection_id", "card_id", "notes", "tags", "deck_id")
        .agg(F.count(F.lit(1)).alias("quantity"))
    )
    deck = decks.select(F.col("id").alias("_deck"), F.col("name").alias("deck_name"))
    return (
        _known_cards(groups, cards)
        .join(deck, groups["deck_id"] == F.col("_deck"), "left")
        .drop("_deck")
    )


def group_members(copies: DataFrame) -> DataFrame:
    """The group key of every copy."""
    return _keyed(copies).select(
        "collection_id", "card_id", "notes", "tags", "deck_id", "copy_id"
    )


def group_copies_sorted(groups: DataFrame) -> DataFrame:
    """Groups by card name, loose copies before those in a deck, then by deck name; names compare
    as a reader would sort them."""
    reader_order = lambda name: F.collate(F.coalesce(F.col(name), F.lit("")), "UNICODE")
    return groups.orderBy(
        reader_order("card_name"),
        F.col("deck_id").isNotNull(),
        reader_order("deck_name"),
        "collection_id",
        "card_id",
        "notes",
        "tags",
        "deck_id",
    )


def collection_size(groups: DataFrame) -> DataFrame:
    return groups.groupBy("collection_id").agg(F.sum("quantity").alias("quantity"))


def locations_by_collection(copies: DataFrame, cards: DataFrame) -> DataFrame:
    """Per collection, card, notes and tags: how many copies, and how many of them in no deck."""
    groups = (
        _keyed(copies.filter(F.col("collection_id").isNotNull()))
        .groupBy("collection_id", "card_id", "notes", "tags")
        .agg(
            F.count(F.lit(1)).alias("quantity"),
            F.count_if(F.col("deck_id").isNull()).alias("free_quantity"),
        )
        .withColumnRenamed("collection_id", "location_id")
    )
    return _known_cards(groups, cards)


def locations_by_deck(copies: DataFrame, cards: DataFrame) -> DataFrame:
    """Per deck, card, notes and tags: how many collection-backed copies; none of them is free."""
    inside = F.col("collection_id").isNotNull() & F.col("deck_id").isNotNull()
    groups = (
        _keyed(copies.filter(inside))
        .groupBy("deck_id", "card_id", "notes", "tags")
        .agg(F.count(F.lit(1)).alias("quantity"))
        .withColumn("free_quantity", F.lit(0).cast("bigint"))
        .withColumnRenamed("deck_id", "location_id")
    )
    return _known_cards(groups, cards)


def locations_union(copies: DataFrame, cards: DataFrame) -> DataFrame:
    """Both roll-ups, told apart by ``type``."""
    in_collection = locations_by_collection(copies, cards).withColumn("type", F.lit("collection"))
    in_deck = locations_by_deck(copies, cards).withColumn("type", F.lit("deck"))
    return in_collection.unionByName(in_deck)


def location_totals(copies: DataFrame, cards: DataFrame) -> DataFrame:
    """Copies and free copies per card name, over collections only."""
    return (
        locations_by_collection(copies, cards)
        .groupBy("card_name")
        .agg(F.sum("quantity").alias("total"), F.sum("free_quantity").alias("free"))
    )


def section_counts(columns: DataFrame, placements: DataFrame) -> DataFrame:
    """Copies per section of every deck, 0 for an empty one."""
    return _counts(columns, placements, ["deck_id", "section_id"])


def deck_counts(decks: DataFrame, placements: DataFrame) -> DataFrame:
    """Copies per deck, 0 for an empty one."""
    return _counts(decks.select(F.col("id").alias("deck_id")), placements, ["deck_id"])


def _counts(every: DataFrame, placements: DataFrame, by: list[str]) -> DataFrame:
    held = placements.groupBy(*by).agg(F.count(F.lit(1)).alias("_held"))
    return (
        every.select(*by)
        .distinct()
        .join(held, by, "left")
        .select(*by, F.coalesce("_held", F.lit(0)).alias("quantity"))
    )


def basic_printing(cards: DataFrame, names: list[str], set_code: str) -> DataFrame:
    """Per wanted name, its printing with the lowest collector number in a set; ``place`` is the
    position of the name in the list."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int")
    wanted = cards.filter((F.col("set") == set_code) & F.col("name").isin(names))
    best = wanted.groupBy("name").agg(F.min_by("id", F.struct(*collector_key(), "id")).alias("id"))
    return best.withColumn("place", place).orderBy("place")


def basic_printings_by_set(cards: DataFrame) -> DataFrame:
    """The same choice for every name in every set."""
    return cards.groupBy("set", "name").agg(
        F.min_by("id", F.struct(*collector_key(), "id")).alias("id")
    )


def active_audit(table: DataFrame) -> DataFrame:
    """Owners with more than one active collection (or deck)."""
    return (
        table.groupBy("owner")
        .agg(F.count_if("is_active").alias("active"))
        .filter(F.col("active") > 1)
    )
