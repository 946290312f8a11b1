"""Colour words, colour sets and the order of colour combinations."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five colours in their canonical order and the recognised colour words.
WUBRG = ["W", "U", "B", "R", "G"]
COLOR_WORDS = {
    "w": "W",
    "u": "U",
    "b": "B",
    "r": "R",
    "g": "G",
    "white": "W",
    "blue": "U",
    "black": "B",
    "red": "R",
    "green": "G",
    "c": "",
    "colorless": "",
    "azorius": "WU",
    "dimir": "UB",
    "rakdos": "BR",
    "gruul": "RG",
    "selesnya": "GW",
    "orzhov": "WB",
    "izzet": "UR",
    "golgari": "BG",
    "boros": "RW",
    "simic": "GU",
    "bant": "GWU",
    "esper": "WUB",
    "grixis": "UBR",
    "jund": "BRG",
    "naya": "RGW",
    "abzan": "WBG",
    "jeskai": "URW",
    "sultai": "BGU",
    "mardu": "RWB",
    "temur": "GUR",
}

# Every colour combination, smaller ones first and WUBRG order inside a size; colourless is last.
COMBINATIONS = ["".join(c) for size in range(1, 6) for c in combinations(WUBRG, size)] + [""]


def color_names(name: str) -> list[str]:
    """Colours meant by a colour word or by a run of colour letters, without repeats."""
    word = name.strip().lower()
    if word not in COLOR_WORDS and not re.fullmatch("[wubrg]+", word):
        raise ValueError(f"not a colour: {name!r}")
    return list(dict.fromkeys(COLOR_WORDS.get(word, word.upper())))


def as_colors(colors: str | list[str]) -> list[str]:
    if isinstance(colors, str):
        return color_names(colors)
    return list(dict.fromkeys(c for one in colors for c in color_names(one)))


def color_mask(colors: Column) -> Column:
    """The colours of a card as bits in canonical order, 0 when it has none."""
    bits = [F.when(F.array_contains(colors, c), 1 << i).otherwise(0) for i, c in enumerate(WUBRG)]
    return reduce(add, bits)


def _word(mask: int) -> str:
    return "".join(c for i, c in enumerate(WUBRG) if mask & (1 << i))


def combination_rank(colors: Column) -> Column:
    """Zero-based place of a colour set among all combinations."""
    places = [COMBINATIONS.index(_word(mask)) for mask in range(1 << len(WUBRG))]
    return F.get(F.array(*[F.lit(p) for p in places]), color_mask(colors))
