"""Sort keys and group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curioshelf.functions.colors import combination_rank
from curioshelf.functions.predicates import ALL_DIGITS, RARITIES

# Where a statistic that is not a number goes; first in both directions.
NOT_A_NUMBER_ASC = -1
NOT_A_NUMBER_DESC = 999999


def stat_key(field: str, direction: str = "asc") -> Column:
    other = NOT_A_NUMBER_ASC if direction == "asc" else NOT_A_NUMBER_DESC
    number = F.when(F.col(field).rlike(ALL_DIGITS), F.col(field).try_cast("int"))
    return F.coalesce(number, F.lit(other))


def rarity_key() -> Column:
    """Place on the rarity scale; -1 for a rarity outside it."""
    places = F.array(*[F.lit(r) for r in RARITIES])
    return (F.coalesce(F.array_position(places, F.col("rarity")), F.lit(0)) - 1).cast("int")


def sort_key(order: str, direction: str = "asc") -> Column:
    """The value that the catalogue order called ``order`` sorts by."""
    keys = {
        "name": lambda: F.col("name"),
        "cmc": lambda: F.col("cmc"),
        "set": lambda: F.col("set"),
        "power": lambda: stat_key("power", direction),
        "toughness": lambda: stat_key("toughness", direction),
        "rarity": rarity_key,
        "color": lambda: combination_rank(F.col("colors")),
        "identity": lambda: combination_rank(F.col("color_identity")),
    }
    if order not in keys:
        raise ValueError(f"unknown order {order!r}; one of {sorted(keys)}")
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction {direction!r}")
    return keys[order]()


def ordered(column: Column, direction: str) -> Column:
    return column.desc() if direction == "desc" else column.asc()


def notes_key() -> Column:
    """Missing notes are the same as empty notes."""
    return F.coalesce(F.col("notes"), F.lit(""))


def tag_set(tags: str = "tags") -> Column:
    """Tags regardless of their order, as an array; missing tags are the same as none."""
    return F.coalesce(F.sort_array(tags), F.array().cast("array<string>"))


def tags_key(tags: str = "tags") -> Column:
    """Tags regardless of their order; missing tags are the same as none."""
    return F.coalesce(F.array_join(F.sort_array(tags), ","), F.lit(""))


def collector_key(number: str = "collector_number") -> list[Column]:
    """Numbered printings first, by number, then the others as text."""
    prefix = F.regexp_extract(F.col(number), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
    return [prefix.isNull(), prefix, F.col(number)]
