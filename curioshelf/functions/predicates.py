"""Catalogue filters: each builds a ``Column`` predicate, or ``None`` for "no constraint"."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from curioshelf.functions.colors import as_colors
from curioshelf.functions.compose import all_of, any_of, none_of

# The rarity scale and the layouts that count as extras.
RARITIES = ["common", "uncommon", "rare", "mythic"]
EXTRA_LAYOUTS = [
    "battle",
    "planar",
    "scheme",
    "vanguard",
    "token",
    "double_faced_token",
    "emblem",
]

ALL_DIGITS = "^[0-9]+$"

_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: ~a.eqNullSafe(b),
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _comparison(op: str):
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return _COMPARE[op]


# -- text -------------------------------------------------------------------------------------


def has_text(field: Column, text: str) -> Column:
    """Case-insensitive literal substring; accents count, nothing is a metacharacter."""
    return F.lower(field).contains(text.lower())


def f_name(text: str) -> Column:
    return any_of(has_text(F.col("name"), text), has_text(F.col("flavor_name"), text))


def f_flavor_name(text: str) -> Column:
    return has_text(F.col("flavor_name"), text)


def f_type(text: str) -> Column:
    return has_text(F.col("type_line"), text)


def f_oracle(text: str) -> Column:
    return has_text(F.col("oracle_text"), text)


def f_keyword(text: str) -> Column:
    return F.exists("keywords", lambda word: has_text(word, text))


def f_set(code: str) -> Column:
    return F.col("set") == code.lower()


def f_lang(code: str) -> Column:
    return F.col("lang") == code.lower()


def f_layout(name: str) -> Column:
    return F.col("layout") == name.lower()


# -- numbers ----------------------------------------------------------------------------------


def f_mana_parity(parity: str) -> Column:
    """Even or odd whole part of the mana value."""
    remainder = {"even": 0, "odd": 1}[parity.lower()]
    return F.col("cmc").cast("bigint") % 2 == remainder


def f_mana_value(op: str | None, value) -> Column:
    """Compare the mana value with the whole-number prefix of ``value`` ("3.5" means 3)."""
    text = str(value)
    if text.lower() in ("even", "odd"):
        return f_mana_parity(text)
    compare = _comparison(op or "=")
    number = re.match(r"\s*[+-]?[0-9]+", text)
    if number is None:
        return F.lit(op == "!=")
    return compare(F.col("cmc"), F.lit(float(number.group())))


def stat_number(field: Column) -> Column:
    """A printed statistic as a number; anything but plain digits, and NULL, counts as 0."""
    return F.coalesce(F.when(field.rlike(ALL_DIGITS), field.try_cast("int")), F.lit(0))


def f_stat_text(field: str, op: str, text: str) -> Column:
    """Exact text test on a printed statistic; only equality and inequality make sense."""
    if op not in ("=", "!="):
        raise ValueError(f"a text statistic cannot be ordered with {op!r}")
    return _comparison(op)(F.col(field), F.lit(text))


def _f_stat(field: str, op: str | None, value) -> Column | None:
    text = str(value)
    if not re.fullmatch("-?[0-9]+", text.strip()):
        return f_stat_text(field, op, text) if op in ("=", "!=") else None
    return _comparison(op or "=")(stat_number(F.col(field)), F.lit(int(text)))


def f_power(op: str | None, value) -> Column | None:
    return _f_stat("power", op, value)


def f_toughness(op: str | None, value) -> Column | None:
    return _f_stat("toughness", op, value)


def f_loyalty(op: str | None, value) -> Column | None:
    return _f_stat("loyalty", op, value)


# -- rarity -----------------------------------------------------------------------------------


def f_rarity(name: str) -> Column:
    return F.col("rarity") == name.lower()


def f_rarity_range(op: str, name: str) -> Column:
    """Rarities on one side of ``name``; a rarity outside the scale is compared for equality."""
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"unknown rarity range {op!r}")
    if name.lower() not in RARITIES:
        return f_rarity(name)
    at = RARITIES.index(name.lower())
    low, high = {"<": (0, at), "<=": (0, at + 1), ">": (at + 1, 4), ">=": (at, 4)}[op]
    return F.col("rarity").isin(RARITIES[low:high]) if low < high else F.lit(False)


# -- colours ----------------------------------------------------------------------------------


def _colorless(field: str) -> Column:
    return F.col(field).isNull() | (F.size(field) == 0)


def _contains(field: str, colors) -> Column:
    wanted = as_colors(colors)
    return all_of(*[F.array_contains(field, c) for c in wanted]) if wanted else _colorless(field)


def _exact(field: str, colors) -> Column:
    wanted = as_colors(colors)
    return all_of(_contains(field, colors), F.size(field) == len(wanted) if wanted else None)


def _subset(field: str, colors) -> Column:
    allowed = as_colors(colors)
    if not allowed:
        return _colorless(field)
    return F.size(F.array_except(field, F.array(*[F.lit(c) for c in allowed]))) == 0


def _excludes(field: str, colors) -> Column | None:
    unwanted = as_colors(colors)
    return none_of(*[F.array_contains(field, c) for c in unwanted])


def f_color_contains(colors) -> Column:
    return _contains("colors", colors)


def f_color_exact(colors) -> Column:
    return _exact("colors", colors)


def f_color_subset(colors) -> Column:
    return _subset("colors", colors)


def f_colorless() -> Column:
    return _colorless("colors")


def f_color_excludes(colors) -> Column | None:
    return _excludes("colors", colors)


def f_identity_contains(colors) -> Column:
    return _contains("color_identity", colors)


def f_identity_exact(colors) -> Column:
    return _exact("color_identity", colors)


def f_identity_subset(colors) -> Column:
    return _subset("color_identity", colors)


def f_identity_colorless() -> Column:
    return _colorless("color_identity")


def f_identity_excludes(colors) -> Column | None:
    return _excludes("color_identity", colors)


# -- extras and defaults ----------------------------------------------------------------------


def f_exclude_extras() -> Column:
    """Neither an extra layout nor a bare "Card"; a missing field is no reason to exclude."""
    layout, type_line = F.col("layout"), F.col("type_line")
    return (layout.isNull() | ~layout.isin(EXTRA_LAYOUTS)) & (
        type_line.isNull() | (type_line != "Card")
    )


def f_default_filters() -> Column:
    return all_of(f_lang("en"), f_exclude_extras())


# -- structured search ------------------------------------------------------------------------


@dataclass
class SearchFilters:
    """One search as a set of optional fields; blank fields do not constrain."""

    name: str | None = None
    flavor_name: str | None = None
    type_line: str | None = None
    oracle_text: str | None = None
    set: str | None = None
    lang: str | None = None
    layout: str | None = None
    keyword: str | None = None
    rarity: str | None = None
    rarity_op: str = "="
    cmc: str | None = None
    cmc_op: str = "="
    power: str | None = None
    power_op: str = "="
    toughness: str | None = None
    toughness_op: str = "="
    loyalty: str | None = None
    loyalty_op: str = "="
    colors: list[str] | None = None
    color_mode: str = "contains"
    color_identity: list[str] | None = None
    color_identity_mode: str = "contains"
    exclude_extras: bool = False


_COLOR_MODES = {"contains": _contains, "exactly": _exact, "does-not-contain": _excludes}


def search_filters(search: SearchFilters) -> Column:
    """The conjunction of the filled-in fields.

    Equality on a statistic is the "no comparison given" form, so that text such as ``*`` in a
    statistic field does not constrain the search.
    """

    def text(build, value):
        value = (value or "").strip()
        return build(value) if value else None

    def stat(build, op, value):
        return text(lambda v: build(None if op == "=" else op, v), value)

    def rarity(value):
        return f_rarity(value) if search.rarity_op == "=" else f_rarity_range(search.rarity_op, value)

    def colors(field, chosen, mode):
        return _COLOR_MODES[mode](field, chosen) if chosen else None

    return all_of(
        text(f_name, search.name),
        text(f_flavor_name, search.flavor_name),
        text(f_type, search.type_line),
        text(f_oracle, search.oracle_text),
        text(f_set, search.set),
        text(f_lang, search.lang),
        text(f_layout, search.layout),
        text(f_keyword, search.keyword),
        text(rarity, search.rarity),
        stat(f_mana_value, search.cmc_op, search.cmc),
        stat(f_power, search.power_op, search.power),
        stat(f_toughness, search.toughness_op, search.toughness),
        stat(f_loyalty, search.loyalty_op, search.loyalty),
        colors("colors", search.colors, search.color_mode),
        colors("color_identity", search.color_identity, search.color_identity_mode),
        f_exclude_extras() if search.exclude_extras else None,
    )
