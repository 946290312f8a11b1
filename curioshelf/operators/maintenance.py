"""Batch changes to copies, collections and decks: tables and requests in, new tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.keys import notes_key, tag_set
from curioshelf.operators.arrangement import (
    LAYOUT,
    MADE_COLUMN,
    MADE_SECTION,
    MAIN_SECTION,
    deck_place,
    deck_pull,
)
from curioshelf.operators.prices import latest
from curioshelf.operators.ranking import grouped_rank

# Copies made for one request are spread over rows of this many before they are expanded.
CREATE_BLOCK = 1000


def _owned(table: DataFrame, key: str) -> DataFrame:
    """(owner, key) pairs that exist in a table of collections or decks, with a marker column."""
    return table.select("owner", F.col("id").alias(key), F.lit(1).alias(f"_{key}"))


def _stamped(df: DataFrame, changed: Column, now) -> DataFrame:
    """``updated_at`` set to ``now`` in changed rows, where a time is given and the table has one."""
    if now is None or "updated_at" not in df.columns:
        return df
    at = now if isinstance(now, Column) else F.lit(now).cast(df.schema["updated_at"].dataType)
    return df.withColumn("updated_at", F.when(changed, at).otherwise(F.col("updated_at")))


def _last_given(column: str) -> Column:
    """The value of the last change, by seq, that gives one."""
    given = F.when(F.col(column).isNotNull(), F.col("seq"))
    return F.max_by(column, given).alias(f"_{column}")


# -- copies -----------------------------------------------------------------------------------


def checked_requests(requests: DataFrame, collections: DataFrame, decks: DataFrame) -> DataFrame:
    """Creation requests with a ``status``: ok, no_card, no_deck, collection_not_found or
    deck_not_found, and with ``quantity`` a whole number of at least 1.

    ``requests``: request_id, owner, card_id, collection_id, deck_id, notes, tags, quantity.
    """
    ephemeral = F.col("collection_id").isNull()
    status = (
        F.when(F.col("card_id").isNull(), "no_card")
        .when(ephemeral & F.col("deck_id").isNull(), "no_deck")
        .when(~ephemeral & F.col("_collection_id").isNull(), "collection_not_found")
        .when(F.col("deck_id").isNotNull() & F.col("_deck_id").isNull(), "deck_not_found")
        .otherwise("ok")
    )
    wanted = F.greatest(F.floor(F.coalesce("quantity", F.lit(1))), F.lit(1)).cast("bigint")
    return (
        requests.join(_owned(collections, "collection_id"), ["owner", "collection_id"], "left")
        .join(_owned(decks, "deck_id"), ["owner", "deck_id"], "left")
        .withColumn("quantity", wanted)
        .withColumn("status", status)
        .drop("_collection_id", "_deck_id")
    )


COPY = ["copy_id", "owner", "card_id", "collection_id", "deck_id", "notes", "tags"]


def _created(requests: DataFrame, collections: DataFrame, decks: DataFrame) -> DataFrame:
    """The copies of all valid requests, with the fields of their request and their number ``_n``."""
    valid = checked_requests(requests, collections, decks).filter(F.col("status") == "ok")
    blocks = F.floor((F.col("quantity") - 1) / CREATE_BLOCK).cast("bigint")
    first = F.col("_block") * CREATE_BLOCK + 1
    last = F.least(first + (CREATE_BLOCK - 1), F.col("quantity"))
    return (
        valid.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks)))
        # The blocks of one large request are made by many tasks.
        .repartition("request_id", "_block")
        .withColumn("_n", F.explode(F.sequence(first, last)))
        .withColumn("copy_id", F.concat_ws("-", "request_id", "_n"))
    )


def copies_create(requests: DataFrame, collections: DataFrame, decks: DataFrame) -> DataFrame:
    """The new copies of all valid requests; ``copy_id`` is the request id and a number from 1."""
    return _created(requests, collections, decks).select(*COPY)


def copies_create_placed(
    requests: DataFrame,
    collections: DataFrame,
    decks: DataFrame,
    columns: DataFrame,
    placements: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New copies of all valid requests, and placements and columns with those for a deck put in:
    one drop for each request.

    ``requests`` also has section_id, column_id, index and seq, as for ``deck_place``.  The labels
    that the library lacks are ``joins.new_tags`` of the copies.
    """
    made = _created(requests, collections, decks)
    at = F.col("index") + (F.col("_n") - 1).cast("int")
    turn = F.shiftleft(F.col("seq").cast("bigint"), 32) + F.col("_n")
    asked = made.filter(F.col("deck_id").isNotNull()).select(
        "copy_id", "deck_id", "section_id", "column_id", at.alias("index"), turn.alias("seq")
    )
    copies = made.select(*COPY)
    placed, layout, _ = deck_place(placements, columns, copies, decks, asked)
    return copies, placed, layout


def copies_update(
    copies: DataFrame, changes: DataFrame, collections: DataFrame, now=None
) -> DataFrame:
    """Set notes, tags or collection of an owner's copies; NULL leaves a field as it is and the deck
    is kept.  A change whose target collection is not the owner's is dropped as a whole.

    ``changes``: owner, copy_id, notes, tags, collection_id, seq.  Each field takes its last given
    value.  With ``now``, updated_at of the copies that are given something becomes that time.
    """
    checked = changes.join(
        _owned(collections, "collection_id"), ["owner", "collection_id"], "left"
    ).filter(F.col("collection_id").isNull() | F.col("_collection_id").isNotNull())
    fields = ["notes", "tags", "collection_id"]
    fresh = checked.groupBy("owner", "copy_id").agg(*[_last_given(f) for f in fields])
    changed = copies.join(fresh, ["owner", "copy_id"], "left")
    given = reduce(lambda p, q: p | q, [F.col(f"_{f}").isNotNull() for f in fields])
    changed = _stamped(changed, given, now)
    for f in fields:
        changed = changed.withColumn(f, F.coalesce(f"_{f}", f))
    return changed.select(*copies.columns)


def copies_delete(
    copies: DataFrame, placements: DataFrame, decks: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete copies of an owner and pull them out of that owner's decks.  ``ids``: owner, copy_id."""
    gone = ids.select("owner", "copy_id").distinct()
    return copies.join(gone, ["owner", "copy_id"], "left_anti"), deck_pull(placements, decks, gone)


# What a display row shows; notes and tags as far as they differ to the eye.
GROUP = ["_owner", "_collection", "_card", "_deck", "_notes", "_tags"]


def _group() -> list[Column]:
    """The display row of a copy or a request, as typed columns."""
    values = [F.col("owner"), F.col("collection_id"), F.col("card_id"), F.col("deck_id"), notes_key(), tag_set()]
    return [v.alias(g) for v, g in zip(values, GROUP, strict=True)]


def remove_group(
    copies: DataFrame, placements: DataFrame, decks: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete up to ``quantity`` copies of a display row, lowest copy ids first, and pull them out of
    their owner's decks.  Returns the new copies and placements.

    ``requests``: owner, collection_id, card_id, deck_id, notes, tags, quantity; no deck means the
    loose copies.  Requests for the same row add up; one without a positive quantity is ignored.
    """
    wanted = (
        requests.filter(F.col("collection_id").isNotNull() & F.col("card_id").isNotNull())
        .filter(F.col("quantity") >= 1)
        .groupBy(*_group())
        .agg(F.sum("quantity").alias("_wanted"))
    )
    asked = wanted.select(*[F.col(g).alias(f"{g}2") for g in GROUP], "_wanted")
    same = reduce(lambda p, q: p & q, [F.col(g).eqNullSafe(F.col(f"{g}2")) for g in GROUP])
    some = copies.filter(F.col("collection_id").isNotNull()).select("copy_id", *_group())
    candidates = some.join(asked, same).select("copy_id", *GROUP, "_wanted")
    ranked = grouped_rank(candidates, GROUP, [("copy_id", "asc")], "_rn")
    gone = ranked.filter(F.col("_rn") <= F.col("_wanted")).select(F.col("_owner").alias("owner"), "copy_id")
    left = copies.join(gone, ["owner", "copy_id"], "left_anti").select(*copies.columns)
    return left, deck_pull(placements, decks, gone)


def bulk_move(
    copies: DataFrame, collections: DataFrame, decks: DataFrame, moves: DataFrame
) -> DataFrame:
    """What becomes of each requested move: ``action`` and the copy's new collection and deck.

    ``moves``: owner, copy_id, from_deck (dragged out of a deck rather than a collection row),
    to_collection, to_deck.  An ephemeral copy only moves inside its own deck.  A move to a deck
    places the copy there.  A move to a collection changes the collection, and takes the copy out
    of its deck only if it was dragged from there.
    """
    ephemeral = F.col("collection_id").isNull()
    to_deck = F.col("to_deck").isNotNull()
    leaves_deck = F.col("from_deck") & F.col("deck_id").isNotNull()
    same_collection = F.col("to_collection").eqNullSafe(F.col("collection_id"))
    action = (
        F.when(F.col("copy_owner").isNull(), "copy_not_found")
        .when(ephemeral & ~F.col("to_deck").eqNullSafe(F.col("deck_id")), "rejected_ephemeral")
        .when(to_deck & F.col("_deck").isNull(), "deck_not_found")
        .when(to_deck, "placed")
        .when(F.col("_collection").isNull(), "collection_not_found")
        .when(leaves_deck, "taken_out")
        .when(same_collection, "unchanged")
        .otherwise("moved")
    )
    into = F.col("action").isin("taken_out", "moved")
    collection = collections.select(
        "owner", F.col("id").alias("to_collection"), F.lit(1).alias("_collection")
    )
    deck = decks.select("owner", F.col("id").alias("to_deck"), F.lit(1).alias("_deck"))
    own = copies.select(
        "owner", "copy_id", F.col("owner").alias("copy_owner"), "collection_id", "deck_id"
    )
    return (
        moves.join(own, ["owner", "copy_id"], "left")
        .join(collection, ["owner", "to_collection"], "left")
        .join(deck, ["owner", "to_deck"], "left")
        .withColumn("action", action)
        .select(
            "copy_id",
            "action",
            F.when(into, F.col("to_collection")).otherwise(F.col("collection_id")).alias("collection_id"),
            F.when(F.col("action") == "placed", F.col("to_deck"))
            .when(F.col("action") != "taken_out", F.col("deck_id"))
            .alias("deck_id"),
        )
    )


def bulk_move_tables(
    copies: DataFrame,
    collections: DataFrame,
    decks: DataFrame,
    columns: DataFrame,
    placements: DataFrame,
    moves: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies, placements and columns after the moves of :func:`bulk_move`; of several moves of one
    copy the last by seq counts.

    ``moves`` also has section_id, column_id, index and seq, as for ``deck_place``.
    """
    last = latest(moves, ["owner", "copy_id"], "seq")
    told = bulk_move(copies, collections, decks, last).select(
        "copy_id", "action", F.col("collection_id").alias("_collection"), F.col("deck_id").alias("_deck")
    )
    done = told.filter(F.col("action").isin("placed", "taken_out", "moved"))
    asked = last.join(done.filter("action = 'placed'").select("copy_id"), "copy_id").select(
        "copy_id", F.col("to_deck").alias("deck_id"), "section_id", "column_id", "index", "seq"
    )
    out = last.join(done.filter("action = 'taken_out'").select("copy_id"), "copy_id").select("owner", "copy_id")
    moved = (
        copies.join(done, "copy_id", "left")
        .withColumn("collection_id", F.when(F.col("action").isNull(), F.col("collection_id")).otherwise(F.col("_collection")))
        .withColumn("deck_id", F.when(F.col("action").isNull(), F.col("deck_id")).otherwise(F.col("_deck")))
        .select(*copies.columns)
    )
    placed, layout, _ = deck_place(deck_pull(placements, decks, out), columns, copies, decks, asked)
    return moved, placed, layout


# -- collections and decks --------------------------------------------------------------------


def delete_collection(
    collections: DataFrame,
    copies: DataFrame,
    placements: DataFrame,
    decks: DataFrame,
    ids: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete collections with their copies, which also leave the decks.  ``ids``: owner, id.

    Returns the new collections, copies and placements.
    """
    gone = collections.join(ids, ["owner", "id"], "left_semi")
    of_gone = gone.select("owner", F.col("id").alias("collection_id"))
    doomed = copies.join(of_gone, ["owner", "collection_id"], "left_semi").select("owner", "copy_id")
    return (
        collections.join(gone, ["owner", "id"], "left_anti"),
        copies.join(of_gone, ["owner", "collection_id"], "left_anti"),
        deck_pull(placements, decks, doomed),
    )


def delete_deck(
    decks: DataFrame, copies: DataFrame, columns: DataFrame, placements: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Delete decks with their columns and placements: their ephemeral copies go too, the others lose
    their deck.  ``ids``: owner, id.

    Returns the new decks, copies, columns and placements.
    """
    gone = decks.join(ids, ["owner", "id"], "left_semi")
    marked = copies.join(
        gone.select("owner", F.col("id").alias("deck_id"), F.lit(True).alias("_gone")),
        ["owner", "deck_id"],
        "left",
    )
    kept = marked.filter(F.col("_gone").isNull() | F.col("collection_id").isNotNull())
    names = gone.select(F.col("id").alias("deck_id"))
    return (
        decks.join(gone, ["owner", "id"], "left_anti"),
        kept.withColumn("deck_id", F.when(F.col("_gone").isNull(), F.col("deck_id"))).select(
            *copies.columns
        ),
        columns.join(names, "deck_id", "left_anti").select(*columns.columns),
        placements.join(names, "deck_id", "left_anti").select(*placements.columns),
    )


def set_active(table: DataFrame, requests: DataFrame, now=None) -> DataFrame:
    """Collections or decks after switching some on or off in order of ``seq``; switching one on
    switches the owner's others off.  ``requests``: owner, id, is_active, seq.  With ``now``,
    updated_at of those that switch becomes that time."""
    real = requests.join(table.select("owner", "id"), ["owner", "id"], "left_semi")
    on = real.filter("is_active").groupBy("owner").agg(
        F.max("seq").alias("_on_seq"), F.max_by("id", "seq").alias("_on_id")
    )
    off = real.filter("not is_active").groupBy("owner", "id").agg(F.max("seq").alias("_off_seq"))
    active = (
        F.when(
            F.col("_on_seq").isNotNull(),
            F.col("id").eqNullSafe(F.col("_on_id"))
            & (F.coalesce(F.col("_off_seq") < F.col("_on_seq"), F.lit(True))),
        )
        .when(F.col("_off_seq").isNotNull(), F.lit(False))
        .otherwise(F.col("is_active"))
    )
    return (
        table.join(on, "owner", "left")
        .join(off, ["owner", "id"], "left")
        .withColumn("_active", active)
        .transform(_stamped, ~F.col("_active").eqNullSafe(F.col("is_active")), now)
        .withColumn("is_active", F.col("_active"))
        .select(*table.columns)
    )


def collections_create(requests: DataFrame, now=None) -> DataFrame:
    """New collections; a request without a name is dropped.  ``requests``: owner, id, name,
    description.  With ``now`` they have updated_at."""
    stamp = [] if now is None else [(now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")).alias("updated_at")]
    return requests.filter(F.length("name") > 0).select(
        "owner",
        "id",
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(False).alias("is_active"),
        *stamp,
    )


def decks_create(requests: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """New decks and their layout: one main section with one empty column."""
    decks = collections_create(requests, now)
    layout = decks.select(
        F.col("id").alias("deck_id"),
        F.lit(MADE_SECTION).alias("section_id"),
        F.lit(MAIN_SECTION).alias("section_name"),
        F.lit(0).alias("section_pos"),
        F.lit(MADE_COLUMN).alias("column_id"),
        F.lit(0).alias("column_pos"),
    )
    return decks, layout.select(*LAYOUT)


def entity_update(table: DataFrame, changes: DataFrame, now=None) -> DataFrame:
    """Rename or describe an owner's collections or decks; NULL leaves a field as it is.

    ``changes``: owner, id, name, description, seq.  Each field takes its last given value.  With
    ``now``, updated_at of those that are given something becomes that time.
    """
    fresh = changes.groupBy("owner", "id").agg(_last_given("name"), _last_given("description"))
    return (
        table.join(fresh, ["owner", "id"], "left")
        .transform(_stamped, F.col("_name").isNotNull() | F.col("_description").isNotNull(), now)
        .withColumn("name", F.coalesce("_name", "name"))
        .withColumn("description", F.coalesce("_description", "description"))
        .select(*table.columns)
    )
