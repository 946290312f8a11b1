"""Sorts, pages and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from curioshelf.functions.keys import sort_key
from curioshelf.operators import page_directory as directory
from curioshelf.operators import paging, sorting
from curioshelf.operators.ranking import grouped_rank
from curioshelf.plans.filter_queries import _RARITY, color_place
from curioshelf.plans.registry import query
from curioshelf.session import scratch


def stat(field: str, other: int) -> str:
    return f"CASE WHEN regexp_matches({field}, '^[0-9]+$') THEN CAST({field} AS INT) ELSE {other} END"


# Sort key of each order in the oracle's SQL, and the direction each is registered with.
SORTS = {
    "name": ("desc", "name"),
    "cmc": ("desc", "cmc"),
    "set": ("asc", "set_code"),
    "power": ("desc", stat("power", 999999)),
    "toughness": ("asc", stat("toughness", -1)),
    "rarity": ("asc", f"CAST({_RARITY} AS INT)"),
    "color": ("asc", color_place("color_mask")),
    "identity": ("desc", color_place("identity_mask")),
}


def in_order(df):
    """Adds ``place``: where the row comes in the order that ``df`` is in."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    return grouped_rank(at, [], [("_at", "asc")], "place").drop("_at")


def nulls(direction: str) -> str:
    return "asc nulls first" if direction == "asc" else "desc nulls last"


def _sort(order: str, direction: str, sql: str) -> None:
    @query(
        f"sort_{order}",
        f"""select id, sort_key, row_number() over (order by sort_key {nulls(direction)}, id) place
        from (select id, {sql} sort_key from cards) t""",
    )
    def build(v):
        keyed = v.cards.withColumn("sort_key", sort_key(order, direction))
        return in_order(sorting.sort_cards(keyed, order, direction).select("id", "sort_key"))


for _order, (_direction, _sql) in SORTS.items():
    _sort(_order, _direction, _sql)


@query(
    "page",
    f"""select id, name, row_number() over (order by k desc nulls last, id) - 120 place
    from (select id, name, {SORTS['color'][1]} k from cards) t qualify place between 1 and 40""",
)
def page(v):
    return in_order(paging.page(v.cards, "color", "desc", page=4, page_len=40).select("id", "name"))


@query(
    "page_info",
    """select count(*) total, 3 page, 40 page_len, CAST(ceil(count(*) / 40.0) AS BIGINT) total_pages,
    3 < ceil(count(*) / 40.0) has_more from cards where lang = 'en'""",
)
def page_info(v):
    return paging.page_info(v.cards.filter("lang = 'en'"), page=3, page_len=40)


@query(
    "assign_pages",
    f"""select id, row_no, CAST(ceil(row_no / 25.0) AS BIGINT) page from
    (select id, row_number() over (order by {_RARITY} desc, id) row_no from cards) t""",
)
def assign_pages(v):
    return paging.assign_pages(v.cards, "rarity", "desc", 25).select("id", "row_no", "page")


@query(
    "assign_pages_copies",
    """select copy_id, CAST(ceil(row_number() over (order by added_day desc, copy_id) / 100.0) AS BIGINT) page
    from copies""",
)
def assign_pages_copies(v):
    """Every copy's page in a listing of the newest copies first."""
    ranked = grouped_rank(
        v.copies.select("copy_id", "added_day"), [], [("added_day", "desc"), ("copy_id", "asc")], "rn"
    )
    return ranked.select("copy_id", F.ceil(F.col("rn") / 100).cast("bigint").alias("page"))


@query(
    "merge_pages_dedupe",
    """with every as (
      select id, name || ' v1' label, 1 pg, id row_no from cards where cmc <= 5
      union all select id, name || ' v2', 2, id from cards where cmc >= 4)
    select id, max_by(label, pg) label, min(pg) at_page, min(row_no) at_row from every group by id""",
)
def merge_pages_dedupe(v):
    """Two overlapping result pages; the later one carries newer versions."""

    def one(which, mark):
        return v.cards.filter(which).select(
            "id", F.concat("name", F.lit(mark)).alias("label"), F.col("id").alias("row_no")
        )

    return paging.merge_pages_dedupe(one("cmc <= 5", " v1"), one("cmc >= 4", " v2"))


# Stored by rarity; then cards that cost much are taken out, and cheap ones come back as rare ones.
_CHANGED = f"""select id, name, {_RARITY} k from (select id, name,
    CASE WHEN cmc < 2 THEN 'rare' ELSE rarity END rarity from cards where cmc < 5) t"""


def _stored_by_rarity(v) -> str:
    path = scratch(v.spark)
    cards = v.cards.select("id", "name", "rarity", "cmc")
    directory.write_directory(cards, path, "rarity", "desc", range_rows=100)
    again = cards.filter("cmc < 2").withColumn("rarity", F.lit("rare"))
    directory.update_directory(v.spark, path, cards.filter("cmc < 2 or cmc >= 5 or cmc is null"), again, "rarity", "desc", range_rows=100)
    return path


@query(
    "page_directory",
    f"""select id, name, row_number() over (order by k desc nulls last, id) row_no from ({_CHANGED}) t
    qualify row_no between 151 and 200""",
)
def page_of_directory(v):
    """A page of a stored order after changes."""
    return directory.stored_page(v.spark, _stored_by_rarity(v), 4, 50).select("id", "name", "row_no")


@query(
    "page_directory_info",
    f"""select count(*) total, 4 page, 50 page_len, CAST(ceil(count(*) / 50.0) AS BIGINT) total_pages,
    4 < ceil(count(*) / 50.0) has_more from ({_CHANGED}) t""",
)
def info_of_directory(v):
    return directory.stored_page_info(v.spark, _stored_by_rarity(v), 4, 50)


_RECENT = "id, name, is_active, owner, row_number() over (order by updated_at desc nulls last, id) place"


@query("list_recent", f"select {_RECENT} from collections")
def list_recent(v):
    return in_order(paging.list_recent(v.collections))


@query(
    "list_recent_owner",
    f"select {_RECENT} from collections where owner = 7",
)
def list_recent_owner(v):
    return in_order(paging.list_recent(v.collections, owner=7))


# A library of labels for each market segment and nation.
_TAG_LIBRARY = "select distinct c_mktsegment || ' ' || CAST(c_nationkey AS STRING) label from @customer"


@query("list_tags", f"select label, row_number() over (order by label) place from ({_TAG_LIBRARY}) t")
def list_tags(v):
    return in_order(paging.list_tags(v.sql(_TAG_LIBRARY)))
