"""Catalogue orders.  Ties are always broken by ascending id, so every order is total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.keys import ordered, sort_key

ORDERS = ["name", "cmc", "set", "power", "toughness", "rarity", "color", "identity"]


def sort_cards(df: DataFrame, order: str = "name", direction: str = "asc") -> DataFrame:
    return df.orderBy(ordered(sort_key(order, direction), direction), F.col("id").asc())


def sort_name(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "name", direction)


def sort_cmc(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "cmc", direction)


def sort_set(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "set", direction)


def sort_power(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "power", direction)


def sort_toughness(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "toughness", direction)


def sort_rarity(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "rarity", direction)


def sort_color(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "color", direction)


def sort_identity(df: DataFrame, direction: str = "asc") -> DataFrame:
    return sort_cards(df, "identity", direction)
