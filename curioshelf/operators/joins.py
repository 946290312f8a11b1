"""Joins between catalogue, copies, collections, decks and scans.

Look-up sides have one row per key, so a hot key can only sit on the copies side; the adaptive
skew join splits that side.  Where copies are the probed side of a semi or anti join they are cut
down to distinct keys first, which happens before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.compose import where
from curioshelf.operators.paging import page as one_page


def owned_cards(cards: DataFrame, copies: DataFrame, owner=None) -> DataFrame:
    """Cards with at least one copy: anyone's, unless ``owner`` narrows it down."""
    mine = copies if owner is None else copies.filter(F.col("owner") == owner)
    return cards.join(distinct_card_ids(mine), cards["id"] == F.col("card_id"), "left_semi")


def distinct_card_ids(copies: DataFrame) -> DataFrame:
    return copies.select("card_id").distinct()


def search_catalog(
    cards: DataFrame,
    copies: DataFrame | None,
    pred: Column | None,
    order: str = "name",
    direction: str = "asc",
    page: int = 1,
    page_len: int = 100,
    owned: bool = False,
    owner=None,
) -> DataFrame:
    """Filter, keep owned cards if asked, sort, and cut out one page."""
    found = where(cards, pred)
    if owned:
        found = owned_cards(found, copies, owner)
    return one_page(found, order, direction, page, page_len)


def search_total(
    cards: DataFrame, pred: Column | None, copies: DataFrame | None = None, owner=None
) -> DataFrame:
    """Number of matches as one row; with ``copies`` only owned cards count."""
    found = where(cards, pred).select("id")
    if copies is not None:
        found = owned_cards(found, copies, owner)
    return found.agg(F.count(F.lit(1)).alias("total"))


def search_collection(
    copies: DataFrame, cards: DataFrame, collection_id, pred: Column | None
) -> DataFrame:
    """Copies of one collection whose card matches; of every collection if the id is ``None``."""
    inside = copies.filter(
        F.col("collection_id").isNotNull()
        if collection_id is None
        else F.col("collection_id") == collection_id
    )
    found = where(cards, pred).select(F.col("id").alias("_card"))
    return inside.join(found, inside["card_id"] == F.col("_card"), "left_semi")


def detail_copies(
    copies: DataFrame, cards: DataFrame, collections: DataFrame | None = None, decks: DataFrame | None = None
) -> DataFrame:
    """Copies with their card as a struct, the names of where they are, and ``is_ephemeral``.  Without
    ``collections`` or ``decks`` there are no such names: a join that no column is read of is still made."""
    card = cards.select(F.col("id").alias("_card"), F.struct(*cards.columns).alias("card"))
    detailed = copies.join(card, copies["card_id"] == F.col("_card"))
    if collections is not None:
        collection = collections.select(
            F.col("id").alias("_collection"), F.col("name").alias("collection_name")
        )
        detailed = detailed.join(collection, copies["collection_id"] == F.col("_collection"), "left")
    if decks is not None:
        deck = decks.select(F.col("id").alias("_deck"), F.col("name").alias("deck_name"))
        detailed = detailed.join(deck, copies["deck_id"] == F.col("_deck"), "left")
    return detailed.drop("_card", "_collection", "_deck").withColumn(
        "is_ephemeral", F.col("collection_id").isNull()
    )


def dangling_copies(copies: DataFrame, cards: DataFrame) -> DataFrame:
    """Copies of a card that the catalogue does not know."""
    return copies.join(cards, copies["card_id"] == cards["id"], "left_anti")


def card_locations(
    copies: DataFrame,
    cards: DataFrame,
    collections: DataFrame,
    decks: DataFrame,
    owner=None,
    name: str | None = None,
) -> DataFrame:
    """Detailed copies that sit in a collection, one row each, so no collection is gathered.

    ``name`` is an exact, case-sensitive card name.
    """
    named = cards if name is None else cards.filter(F.col("name") == name)
    mine = copies.filter(F.col("collection_id").isNotNull())
    if owner is not None:
        mine = mine.filter(F.col("owner") == owner)
    return detail_copies(mine, named, collections, decks).withColumn(
        "collection_name", F.coalesce("collection_name", F.lit(""))
    )


def scan_matches(batches: DataFrame) -> DataFrame:
    """Scan results as flat rows (detected, rank, card_id), best match first by ``rank``; a detected
    card without matches keeps one row."""
    detected = batches.select(F.explode("cards").alias("d"))
    return detected.select(
        F.col("d.id").alias("detected"), F.posexplode_outer("d.matches").alias("rank", "m")
    ).select("detected", "rank", F.col("m.card_id").alias("card_id"))


def scan_enrich(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Ranked candidates of each detected card with their catalogue row, best first.

    ``scans``: detected, rank, card_id.  Unknown candidates are dropped; a detected card left with
    none keeps one row whose candidate fields are NULL.
    """
    card = cards.select(F.col("id").alias("_card"), F.struct(*cards.columns).alias("card"))
    found = scans.join(card, scans["card_id"] == F.col("_card")).select(*scans.columns, "card")
    # Detected cards are counted before they meet anything, so a hot one is a row a task.
    every = scans.select("card_id", "detected").join(card.select("_card"), F.col("card_id") == F.col("_card"), "left")
    lost = every.groupBy("detected").agg(F.count("_card").alias("_known")).filter("_known = 0")
    blank = [c if c == "detected" else F.lit(None).cast(scans.schema[c].dataType).alias(c) for c in scans.columns]
    return found.unionByName(lost.select(*blank, F.lit(None).cast(found.schema["card"].dataType).alias("card")))


def scan_best_match(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """The first known candidate of each detected card, NULL when there is none."""
    found = scans.join(
        cards.select(F.col("id").alias("_card")), scans["card_id"] == F.col("_card"), "left"
    )
    return found.groupBy("detected").agg(
        F.min_by("_card", F.when(F.col("_card").isNotNull(), F.col("rank"))).alias("card_id")
    )


def new_tags(copies: DataFrame, library: DataFrame) -> DataFrame:
    """Labels used on copies that the library does not have yet."""
    return tag_vocabulary(copies).join(library, "label", "left_anti")


def tag_vocabulary(copies: DataFrame) -> DataFrame:
    """Distinct labels in use.  Copies share few tag lists, so those are made distinct first."""
    return copies.select("tags").distinct().select(F.explode("tags").alias("label")).distinct()


def owners_without_collection(owners: DataFrame, collections: DataFrame) -> DataFrame:
    """The default, active collection for each owner who has none."""
    return owners.join(collections.select("owner").distinct(), "owner", "left_anti").select(
        "owner",
        # The wording of the default collection.
        F.lit("Main Collection").alias("name"),
        F.lit("My main MTG card collection").alias("description"),
        F.lit(True).alias("is_active"),
    )
