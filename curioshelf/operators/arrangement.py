"""Ordered decks as flat tables.

The arrangement of a deck (sections of columns of copies) is kept in two flat tables, so that no
deck, however large, has to fit in one row or one task:

* ``columns``: deck_id, section_id, section_name, section_pos, column_id, column_pos; a section
  without columns has one row whose column fields are NULL.
* ``placements``: deck_id, section_id, column_id, pos, copy_id.  The order inside a column is
  (pos, copy_id); ``pos`` may have gaps and ties.

:func:`deck_explode` and :func:`deck_assemble` go between this form and nested documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curioshelf.operators.asof import as_of
from curioshelf.operators.prices import latest
from curioshelf.operators.ranking import grouped_rank
from curioshelf.session import settled

COLUMN = ["deck_id", "section_id", "column_id"]
SECTION = ["deck_id", "section_id"]
LAYOUT = SECTION + ["section_name", "section_pos", "column_id", "column_pos"]
PLACEMENT = COLUMN + ["pos", "copy_id"]

# Names given to sections made without one.
MAIN_SECTION = "Main"
NEW_SECTION = "New Section"
# Ids of the section and column that are made when a deck has nowhere to put a copy.
MADE_SECTION = "main"
MADE_COLUMN = "main"
# Start of the id of one that is made because the named one does not exist.
MADE = "made:"


# -- nested and flat --------------------------------------------------------------------------


def deck_explode(decks: DataFrame) -> DataFrame:
    """Nested decks as rows; empty columns and sections keep a row without a copy.

    ``decks``: deck_id, sections array<struct<id, name, columns array<struct<id, cards>>>>, and
    ``part`` when a large deck comes in several documents.
    """
    own = [c for c in ("deck_id", "part") if c in decks.columns]
    sections = decks.select(*own, F.posexplode_outer("sections").alias("section_pos", "s"))
    columns = sections.select(
        *own,
        "section_pos",
        F.col("s.id").alias("section_id"),
        F.col("s.name").alias("section_name"),
        F.posexplode_outer("s.columns").alias("column_pos", "c"),
    )
    return columns.select(
        *own,
        "section_pos",
        "section_id",
        "section_name",
        "column_pos",
        F.col("c.id").alias("column_id"),
        F.posexplode_outer("c.cards").alias("pos", "copy_id"),
    )


def deck_assemble(columns: DataFrame, placements: DataFrame, max_cards: int = 10_000) -> DataFrame:
    """Nested documents from the flat tables, order kept.

    A document holds at most ``max_cards`` copies.  A larger deck continues in further documents,
    numbered by ``part``; the sections and columns that go on are named again.
    """
    filled = placements.join(columns, COLUMN)
    held = placements.select(*COLUMN).distinct()
    empty = columns.join(held, COLUMN, "left_anti")
    rows = filled.unionByName(empty, allowMissingColumns=True).select(
        *LAYOUT, F.coalesce("pos", F.lit(0)).alias("pos"), "copy_id"
    )
    order = [(c, "asc") for c in ("section_pos", "section_id", "column_pos", "column_id", "pos")]
    ranked = grouped_rank(rows, ["deck_id"], order + [("copy_id", "asc")], "_rn")
    # Partitioned once by document, which serves all three levels of nesting below.
    parts = ranked.withColumn("part", F.floor((F.col("_rn") - 1) / max_cards).cast("bigint"))
    parts = parts.repartition("deck_id", "part")
    in_order = lambda *fields: F.sort_array(F.collect_list(F.struct(*fields)))
    listed = parts.groupBy(
        "deck_id", "part", "section_pos", "section_id", "section_name", "column_pos", "column_id"
    ).agg(
        F.sort_array(
            F.collect_list(F.when(F.col("copy_id").isNotNull(), F.struct("_rn", "copy_id")))
        )["copy_id"].alias("cards")
    )
    column = F.when(
        F.col("column_id").isNotNull(), F.struct("column_pos", F.col("column_id").alias("id"), "cards")
    )
    sections = listed.groupBy("deck_id", "part", "section_pos", "section_id", "section_name").agg(
        F.sort_array(F.collect_list(column)).alias("cs")
    )
    bare = F.transform("cs", lambda c: F.struct(c["id"].alias("id"), c["cards"].alias("cards")))
    section = ["section_pos", F.col("section_id").alias("id"), F.col("section_name").alias("name")]
    nested = sections.groupBy("deck_id", "part").agg(
        in_order(*section, bare.alias("columns")).alias("ss")
    )
    return nested.select(
        "deck_id",
        "part",
        F.transform(
            "ss",
            lambda s: F.struct(
                s["id"].alias("id"), s["name"].alias("name"), s["columns"].alias("columns")
            ),
        ).alias("sections"),
    )


# -- reading ----------------------------------------------------------------------------------


def _with_deck_owner(rows: DataFrame, decks: DataFrame) -> DataFrame:
    owners = decks.select(F.col("id").alias("deck_id"), F.col("owner").alias("deck_owner"))
    return rows.join(owners, "deck_id")


def deck_detail(placements: DataFrame, decks: DataFrame, detailed: DataFrame) -> DataFrame:
    """Placed copies with their details, in long form; ids that are no copy of the deck's owner are
    dropped.  ``detailed`` comes from ``detail_copies``."""
    known = detailed.drop("deck_id")
    return (
        _with_deck_owner(placements, decks)
        .join(known, "copy_id")
        .filter(F.col("owner") == F.col("deck_owner"))
        .drop("deck_owner")
    )


def deck_orphans(placements: DataFrame, copies: DataFrame, decks: DataFrame) -> DataFrame:
    """Copies that point at a deck of their owner but are missing from its arrangement."""
    inside = copies.filter(F.col("deck_id").isNotNull())
    own = _with_deck_owner(inside, decks).filter(F.col("owner") == F.col("deck_owner"))
    return own.join(placements, ["deck_id", "copy_id"], "left_anti").select("deck_id", "copy_id")


def _first_columns(columns: DataFrame, by: list[str]) -> DataFrame:
    """First column of the first section of each deck (or of each section)."""
    place = F.struct(
        "section_pos", "section_id", F.col("column_id").isNull().alias("bare"), "column_pos", "column_id"
    )
    first = columns.groupBy(*by).agg(F.min(place).alias("_f"))
    return first.select(
        *by, F.col("_f.section_id").alias("first_section"), F.col("_f.column_id").alias("first_column")
    )


def _ensure_columns(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """``columns`` plus those of ``wanted`` (distinct deck, section, column) that do not exist."""
    missing = wanted.select(*COLUMN).distinct().join(columns, COLUMN, "left_anti")
    ends = columns.groupBy("deck_id").agg(F.max("section_pos").alias("_last_section"))
    inside = columns.groupBy(*SECTION).agg(
        F.first("section_name").alias("_name"),
        F.first("section_pos").alias("_pos"),
        F.max("column_pos").alias("_last_column"),
    )
    made = (
        missing.join(inside, SECTION, "left")
        .join(ends, "deck_id", "left")
        .select(
            *SECTION,
            F.coalesce("_name", F.lit(MAIN_SECTION)).alias("section_name"),
            F.coalesce("_pos", F.col("_last_section") + 1, F.lit(0)).cast("int").alias("section_pos"),
            "column_id",
            F.coalesce(F.col("_last_column") + 1, F.lit(0)).cast("int").alias("column_pos"),
        )
    )
    # A section without columns stops needing its bare row once a column is made in it.
    bare = columns.filter(F.col("column_id").isNull()).join(made, SECTION, "left_anti")
    return columns.filter(F.col("column_id").isNotNull()).unionByName(bare).unionByName(made)


def deck_reconcile(
    placements: DataFrame, columns: DataFrame, copies: DataFrame, decks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Placements and columns with every orphan appended to the default column of its deck."""
    last = placements.groupBy(*COLUMN).agg(F.max("pos").alias("_last"))
    appended = (
        deck_orphans(placements, copies, decks)
        .join(_first_columns(columns, ["deck_id"]), "deck_id", "left")
        .select(
            "deck_id",
            F.coalesce("first_section", F.lit(MADE_SECTION)).alias("section_id"),
            F.coalesce("first_column", F.lit(MADE_COLUMN)).alias("column_id"),
            "copy_id",
        )
        .join(last, COLUMN, "left")
        .withColumn("pos", F.coalesce(F.col("_last") + 1, F.lit(0)))
        .select(*PLACEMENT)
    )
    return placements.select(*PLACEMENT).unionByName(appended), _ensure_columns(columns, appended)


# -- placing and removing ---------------------------------------------------------------------


def resolve_places(
    columns: DataFrame, copies: DataFrame, decks: DataFrame, requests: DataFrame
) -> DataFrame:
    """The column that each copy's last valid request leads to; see :func:`deck_place`."""
    return _targets(columns, latest(valid_requests(copies, decks, requests), "copy_id", "seq"))


def resolve_requests(columns: DataFrame, copies: DataFrame, decks: DataFrame, requests: DataFrame) -> DataFrame:
    """The column that each valid request leads to."""
    return _targets(columns, valid_requests(copies, decks, requests))


def valid_requests(copies: DataFrame, decks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for a copy and a deck of one owner."""
    asked = _with_deck_owner(requests, decks).join(copies.select("copy_id", "owner"), "copy_id")
    return asked.filter(F.col("owner") == F.col("deck_owner")).drop("owner", "deck_owner")


def _targets(columns: DataFrame, valid: DataFrame) -> DataFrame:
    """The column that each request leads to."""
    section_first = _first_columns(columns, SECTION).select(
        *SECTION, F.col("first_section").alias("_section"), F.col("first_column").alias("_column")
    )
    exact = (
        columns.filter(F.col("column_id").isNotNull()).select(*COLUMN).withColumn("_there", F.lit(1))
    )
    named = F.col("section_id").isNotNull()
    target_section = F.when(named, F.col("_section")).otherwise(F.col("first_section"))
    target_column = (
        F.when(~named, F.col("first_column"))
        .when(F.col("column_id").isNull(), F.col("_column"))
        .when(F.col("_there").isNotNull(), F.col("column_id"))
    )
    return (
        valid.join(_first_columns(columns, ["deck_id"]), "deck_id", "left")
        .join(section_first, SECTION, "left")
        .join(exact, COLUMN, "left")
        .select(
            "copy_id",
            "seq",
            "index",
            "deck_id",
            F.coalesce(target_section, _made("section_id"), F.lit(MADE_SECTION)).alias("section_id"),
            F.coalesce(target_column, F.when(named, _made("column_id")), F.lit(MADE_COLUMN)).alias("column_id"),
        )
    )


def _made(asked: str) -> Column:
    """Id of the section or column that is made for one that was asked for and does not exist."""
    return F.concat(F.lit(MADE), F.col(asked).cast("string"))


def _runs(placed: DataFrame) -> DataFrame:
    """Requests with ``_start`` and ``_first``: index and seq of the first of their run.  A run is a
    drop of several copies: neighbouring requests of a column whose indices rise by one."""
    rows = placed.withColumn("_at", F.when(F.col("index").isNotNull(), F.greatest("index", F.lit(0))))
    # Numbered in ranges and looked back by number: a column that gets most requests is many tasks.
    turns = settled(grouped_rank(rows, COLUMN, [("seq", "asc"), ("copy_id", "asc")], "_no"))
    before = turns.select(*COLUMN, (F.col("_no") + 1).alias("_no"), (F.col("_at") + 1).alias("_next"))
    goes_on = F.coalesce(F.col("_next") == F.col("_at"), F.lit(False))
    column = F.struct(*COLUMN).alias("_column")
    begun = turns.join(before, [*COLUMN, "_no"], "left").filter(~goes_on).select(column, F.col("_no").alias("_from"), "_at", "seq")
    known = as_of(turns.withColumn("_column", column), begun, "_column", "_no", "_from", "CAST(9223372036854775807 AS BIGINT)")
    return known.select(*placed.columns, F.col("known._at").alias("_start"), F.col("known.seq").alias("_first"))


def place_rows(placements: DataFrame, placed: DataFrame) -> DataFrame:
    """Placements with the resolved requests carried out.  Columns that gain a copy are numbered
    afresh from 0; the others keep their positions."""
    base = placements.select(*PLACEMENT).join(placed, "copy_id", "left_anti").select(*PLACEMENT)
    touched = placed.select(*COLUMN).distinct()
    held = base.join(touched, COLUMN, "left_semi")
    # Old copies take the odd keys and new ones the even keys between them.
    old = grouped_rank(held, COLUMN, [("pos", "asc"), ("copy_id", "asc")], "_rn").select(
        *COLUMN, "copy_id", (2 * F.col("_rn") - 1).alias("_gap"), F.lit(0).alias("_turn"), F.lit(0).alias("_seq")
    )
    length = old.groupBy(*COLUMN).agg(F.count("*").alias("_n"))
    end = F.coalesce("_n", F.lit(0))
    inside = F.col("_start") <= end
    # Of runs dropped at one place the later pushes the earlier on; beyond the end they queue up.
    new = _runs(placed).join(length, COLUMN, "left").select(
        *COLUMN,
        "copy_id",
        (2 * F.when(inside, F.col("_start")).otherwise(end)).alias("_gap"),
        F.when(inside, -F.col("_first")).otherwise(F.lit(0)).alias("_turn"),
        F.col("seq").alias("_seq"),
    )
    order = [("_gap", "asc"), ("_turn", "asc"), ("_seq", "asc"), ("copy_id", "asc")]
    merged = grouped_rank(old.unionByName(new), COLUMN, order, "_rn").select(
        *COLUMN, (F.col("_rn") - 1).alias("pos"), "copy_id"
    )
    untouched = base.join(touched, COLUMN, "left_anti").select(*PLACEMENT)
    return untouched.unionByName(merged)


def place_columns(columns: DataFrame, placed: DataFrame) -> DataFrame:
    """Columns including those that the resolved requests need."""
    return _ensure_columns(columns, placed)


def place_copies(copies: DataFrame, placed: DataFrame) -> DataFrame:
    """Copies pointing at the deck that the resolved requests put them in."""
    moved = placed.select("copy_id", F.col("deck_id").alias("_deck"))
    return (
        copies.join(moved, "copy_id", "left")
        .withColumn("deck_id", F.coalesce("_deck", "deck_id"))
        .select(*copies.columns)
    )


def deck_place(
    placements: DataFrame,
    columns: DataFrame,
    copies: DataFrame,
    decks: DataFrame,
    requests: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put copies into columns; returns the new placements, columns and copies.

    ``requests``: copy_id, deck_id, section_id, column_id, index, seq.  No section means the first
    one, no column the first of the section; what does not exist is made, under an id of its own.
    Neighbouring requests of a column whose indices rise by one are one drop of several copies and
    stay together.  A drop's ``index`` counts in the column as it is once all placed copies have been
    lifted out, is clamped to it, and NULL means append.  Of two drops at the same index the later
    comes first; beyond the end they follow each other.  The last valid request for a copy wins; one
    for a copy or deck of someone else is no valid one.
    """
    placed = settled(resolve_places(columns, copies, decks, requests))
    return (
        place_rows(placements, placed),
        place_columns(columns, placed),
        place_copies(copies, placed),
    )


def deck_pull(placements: DataFrame, decks: DataFrame, ids: DataFrame) -> DataFrame:
    """Placements without the given copies, in the decks of the owner who gave them up.

    ``ids``: owner, copy_id.
    """
    pulled = ids.select(F.col("owner").alias("deck_owner"), "copy_id")
    owners = decks.select(F.col("id").alias("deck_id"), F.col("owner").alias("deck_owner"))
    return (
        placements.join(owners, "deck_id", "left")
        .join(pulled, ["deck_owner", "copy_id"], "left_anti")
        .select(*placements.columns)
    )


def deck_remove(
    placements: DataFrame, copies: DataFrame, decks: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Take copies out of all decks of their owner: an ephemeral copy is deleted, any other loses
    its deck.  ``ids``: owner, copy_id.  Returns the new placements and copies."""
    real = ids.select("owner", "copy_id").distinct().join(copies, ["owner", "copy_id"], "left_semi")
    taken = real.withColumn("_taken", F.lit(True))
    marked = copies.join(taken, ["owner", "copy_id"], "left")
    left = (
        marked.filter(F.col("_taken").isNull() | F.col("collection_id").isNotNull())
        .withColumn("deck_id", F.when(F.col("_taken").isNull(), F.col("deck_id")))
        .select(*copies.columns)
    )
    return deck_pull(placements, decks, real), left


# -- sections and columns ---------------------------------------------------------------------


def section_add(columns: DataFrame, decks: DataFrame, requests: DataFrame) -> DataFrame:
    """Append sections, each with one empty column.

    ``requests``: deck_id, section_id, name, seq, where seq counts from 1 in a deck.
    """
    ends = columns.groupBy("deck_id").agg(F.max("section_pos").alias("_last"))
    known = requests.join(decks.select(F.col("id").alias("deck_id")), "deck_id", "left_semi")
    added = known.join(ends, "deck_id", "left").select(
        *SECTION,
        F.coalesce(F.nullif("name", F.lit("")), F.lit(NEW_SECTION)).alias("section_name"),
        (F.coalesce("_last", F.lit(-1)) + F.col("seq")).cast("int").alias("section_pos"),
        F.lit(MADE_COLUMN).alias("column_id"),
        F.lit(0).alias("column_pos"),
    )
    return columns.select(*LAYOUT).unionByName(added)


def column_add(columns: DataFrame, requests: DataFrame) -> DataFrame:
    """Append empty columns to existing sections; a request for an unknown section is refused.

    ``requests``: deck_id, section_id, column_id, seq, where seq counts from 1 in a section.
    """
    sections = columns.groupBy(*SECTION).agg(
        F.first("section_name").alias("section_name"),
        F.first("section_pos").alias("section_pos"),
        F.max("column_pos").alias("_last"),
    )
    added = requests.join(sections, SECTION).select(
        *SECTION,
        "section_name",
        "section_pos",
        "column_id",
        (F.coalesce("_last", F.lit(-1)) + F.col("seq")).cast("int").alias("column_pos"),
    )
    bare = F.col("column_id").isNull()
    kept = columns.filter(~bare).unionByName(
        columns.filter(bare).join(added, SECTION, "left_anti").select(*columns.columns)
    )
    return kept.select(*LAYOUT).unionByName(added)


def section_rename(columns: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: deck_id, section_id, name."""
    names = requests.select(*SECTION, F.col("name").alias("_name"))
    return (
        columns.join(names, SECTION, "left")
        .withColumn("section_name", F.coalesce("_name", "section_name"))
        .select(*LAYOUT)
    )


def _reorder(items: DataFrame, scope: list[str], item: str, pos: str, orders: DataFrame):
    """New dense positions by (place in the given order or -1, old position), for the scopes that
    have an order."""
    asked = orders.select(*scope, item, F.col("place").alias("_place"))
    some = items.join(asked.select(*scope).distinct(), scope, "left_semi")
    placed = some.join(asked, [*scope, item], "left").withColumn(
        "_place", F.coalesce("_place", F.lit(-1))
    )
    order = [("_place", "asc"), (pos, "asc"), (item, "asc")]
    return grouped_rank(placed, scope, order, "_rn").select(
        *scope, item, (F.col("_rn") - 1).cast("int").alias("_pos")
    )


def section_reorder(columns: DataFrame, orders: DataFrame) -> DataFrame:
    """Sections in a given order; those not named come first, as they were.

    ``orders``: deck_id, section_id, place.
    """
    sections = columns.select(*SECTION, "section_pos").distinct()
    fresh = _reorder(sections, ["deck_id"], "section_id", "section_pos", orders)
    return (
        columns.join(fresh, SECTION, "left")
        .withColumn("section_pos", F.coalesce("_pos", "section_pos"))
        .select(*LAYOUT)
    )


def column_reorder(columns: DataFrame, orders: DataFrame) -> DataFrame:
    """Columns of a section in a given order.  ``orders``: deck_id, section_id, column_id, place."""
    real = columns.filter(F.col("column_id").isNotNull()).select(*COLUMN, "column_pos")
    fresh = _reorder(real, SECTION, "column_id", "column_pos", orders)
    return (
        columns.join(fresh, COLUMN, "left")
        .withColumn("column_pos", F.coalesce("_pos", "column_pos"))
        .select(*LAYOUT)
    )


def _delete_report(requests: DataFrame, known: DataFrame, held: DataFrame, key: list[str]):
    status = (
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.col("_held").isNotNull(), "not_empty")
        .otherwise("deleted")
    )
    return (
        requests.select(*key)
        .distinct()
        .join(known.select(*key).distinct().withColumn("_known", F.lit(1)), key, "left")
        .join(held.select(*key).distinct().withColumn("_held", F.lit(1)), key, "left")
        .select(*key, status.alias("status"))
    )


def section_delete_empty(
    columns: DataFrame, placements: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete sections that hold no copy.  Returns the columns left and the status of each request:
    deleted, not_empty or not_found.  ``requests``: deck_id, section_id."""
    report = _delete_report(requests, columns, placements, SECTION)
    gone = report.filter(F.col("status") == "deleted")
    return columns.join(gone, SECTION, "left_anti").select(*LAYOUT), report


def column_delete_empty(
    columns: DataFrame, placements: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The same for columns; a section that loses its last column stays, without columns."""
    report = _delete_report(requests, columns, placements, COLUMN)
    gone = report.filter(F.col("status") == "deleted")
    left = columns.join(gone, COLUMN, "left_anti").select(*LAYOUT)
    bared = (
        columns.join(gone, COLUMN, "left_semi")
        .join(left, SECTION, "left_anti")
        .select(*SECTION, "section_name", "section_pos")
        .distinct()
    )
    return left.unionByName(bared, allowMissingColumns=True), report
