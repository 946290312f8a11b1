import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from curioshelf.functions.keys import collector_key, sort_key
from curioshelf.operators import paging, sorting
from curioshelf.operators.ranking import grouped_rank
from tests.helpers import cards_of, column, rows


def test_statistics_that_are_no_numbers_come_first_both_ways(spark):
    cards = cards_of(spark, {"power": "10"}, {"power": "*"}, {"power": "2"}, {"power": None})
    assert column(sorting.sort_power(cards)) == ["c2", "c4", "c3", "c1"]
    assert column(sorting.sort_power(cards, "desc")) == ["c2", "c4", "c1", "c3"]


def test_rarity_and_color_orders(spark):
    cards = cards_of(
        spark,
        {"rarity": "mythic", "colors": []},
        {"rarity": "special", "colors": ["G", "W"]},
        {"rarity": "common", "colors": ["W"]},
        {"rarity": "rare", "colors": None},
        {"rarity": None, "colors": ["R", "U"]},
    )
    assert column(sorting.sort_rarity(cards)) == ["c2", "c5", "c3", "c4", "c1"]
    assert column(sorting.sort_color(cards)) == ["c3", "c2", "c5", "c1", "c4"]
    assert column(sorting.sort_color(cards, "desc"))[:2] == ["c1", "c4"]


def test_names_sort_in_binary_order_with_ascending_ties(spark):
    cards = cards_of(spark, {"name": "b"}, {"name": "B"}, {"name": "b"})
    assert column(sorting.sort_name(cards)) == ["c2", "c1", "c3"]
    assert column(sorting.sort_name(cards, "desc")) == ["c1", "c3", "c2"]


def test_unknown_order_is_refused():
    with pytest.raises(ValueError):
        sort_key("artist")
    with pytest.raises(ValueError):
        sort_key("name", "up")


@pytest.mark.parametrize("order", ["name", "rarity"])
def test_tied_rows_are_paged_once_each(spark, order):
    cards = cards_of(spark, *[{} for _ in range(10)])
    pages = [column(paging.page(cards, order, "desc", n, 3)) for n in range(1, 6)]
    assert sorted(sum(pages, [])) == sorted(column(cards))
    assert [len(p) for p in pages] == [3, 3, 3, 1, 0]


def test_deep_pages_give_the_same_rows(spark, monkeypatch):
    cards = cards_of(spark, *[{"name": f"n{i % 4}"} for i in range(20)])
    shallow = column(paging.page(cards, "name", "asc", 3, 4))
    monkeypatch.setattr(paging, "TOP_K_ROWS", 5)
    assert column(paging.page(cards, "name", "asc", 3, 4)) == shallow


def test_page_info(spark):
    cards = cards_of(spark, {}, {}, {})
    assert rows(paging.page_info(cards, 1, 2)) == [(3, 1, 2, 2, True)]
    assert rows(paging.page_info(cards, 2, 2)) == [(3, 2, 2, 2, False)]
    assert rows(paging.page_info(cards.limit(0), 1, 2)) == [(0, 1, 2, 0, False)]
    with pytest.raises(ValueError):
        paging.page(cards, page=0)


def test_merge_pages_keeps_the_last_version_at_the_first_place(spark):
    one = spark.createDataFrame([("a", "old", 0), ("b", "b", 1)], "id string, v string, row_no int")
    two = spark.createDataFrame([("c", "c", 0), ("a", "new", 1)], "id string, v string, row_no int")
    merged = paging.merge_pages_dedupe(one, two).orderBy("at_page", "at_row")
    assert [tuple(r)[:2] for r in merged.collect()] == [("a", "new"), ("b", "b"), ("c", "c")]


def test_listings(spark):
    table = spark.createDataFrame(
        [(1, "x", True, "u", 5), (2, "y", False, "u", 9), (3, "z", False, "v", 7)],
        "id int, name string, is_active boolean, owner string, updated_at int",
    )
    assert column(paging.list_recent(table, "u")) == [2, 1]
    assert column(paging.list_recent(table)) == [2, 3, 1]
    tags = spark.createDataFrame([("b",), ("a",)], "label string")
    assert column(paging.list_tags(tags), "label") == ["a", "b"]


def test_deep_and_shallow_pages_agree(spark, monkeypatch):
    cards = cards_of(spark, *[{"cmc": c} for c in [1.0, None, float("nan"), 2.0, -1.0] * 9])
    cards = cards.withColumn("row_no", F.lit(7)).withColumn("page", F.lit("kept"))
    for direction in ("asc", "desc"):
        for n in (1, 3, 9, 10):
            monkeypatch.setattr(paging, "TOP_K_ROWS", 10**9)
            want = paging.page(cards, "cmc", direction, n, 5)
            monkeypatch.setattr(paging, "TOP_K_ROWS", 0)
            got = paging.page(cards, "cmc", direction, n, 5)
            assert got.columns == want.columns and column(got) == column(want)


KINDS = {
    "i": "cast(x % 7 as int)",
    "d": "case when x % 5 = 0 then null else x % 3 / 2.0D end",
    "s": "case when x % 6 = 0 then null else repeat(chr(cast(97 + x % 4 as int)), cast(x % 3 as int)) end",
    "b": "x % 2 = 0",
    "t": "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(x % 4 as int))",
    "c": "cast(x % 9 as decimal(8,2))",
}


@pytest.mark.parametrize("seed", range(4))
def test_distributed_rank_equals_a_window(spark, seed):
    """One group holds most rows; keys of several types, with NULLs, in both directions."""
    rng = random.Random(seed)
    fields = rng.sample(sorted(KINDS), 3)
    order = [(f, rng.choice(["asc", "desc"])) for f in fields] + [("x", rng.choice(["asc", "desc"]))]
    df = spark.range(700).select(
        F.col("id").alias("x"), F.expr("case when id % 5 < 4 then 'hot' else concat('g', id % 11) end").alias("g")
    )
    df = df.select("*", *[F.expr(KINDS[f]).alias(f) for f in fields]).repartition(5)
    for group in ([], ["g"]):
        by = Window.partitionBy(*(group or [F.lit(0)])).orderBy(
            *[F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
        )
        want = df.withColumn("rn", F.row_number().over(by).cast("bigint"))
        got = grouped_rank(df, group, order, "rn", ranges=13)
        assert got.exceptAll(want).count() == 0 and got.count() == 700


def test_distributed_rank_splits_a_hot_group(spark):
    """No task numbers more than a small part of a group that holds all rows."""
    df = spark.range(20_000).withColumn("g", F.lit("hot"))
    ranked = grouped_rank(df, ["g"], [("id", "desc")], "rn", ranges=64)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(g" in plan and "_slice" in plan.split("row_number()")[1].split("\n")[0]
    assert ranked.filter("rn <> 20000 - id").count() == 0


def test_rank_of_an_empty_table(spark):
    assert grouped_rank(spark.range(0), [], [("id", "asc")], "rn").count() == 0


def test_collector_numbers(spark):
    cards = cards_of(
        spark, *[{"collector_number": n} for n in ("P7", "100", "12a", "12", None, " 3", "9" * 30)]
    )
    in_order = column(cards.orderBy(*collector_key(), "id"), "collector_number")
    assert in_order[:4] == [" 3", "12", "12a", "100"]
    assert in_order[-2:] == ["9" * 30, "P7"]
