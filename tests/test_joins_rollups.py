import pytest
from pyspark.sql import functions as F

from curioshelf.functions import predicates as P
from curioshelf.operators import joins, rollups, searches
from curioshelf.sources.schema import SCAN
from tests.helpers import cards_of, column, copies_of, rows


@pytest.fixture(scope="module")
def cards(spark):
    return cards_of(
        spark,
        {"name": "Shivan Dragon", "power": "5", "rarity": "rare"},
        {"name": "goblin", "power": "2", "colors": ["R", "W"]},
        {"name": "Counterspell", "power": None, "colors": ["U"], "rarity": "uncommon"},
    )


@pytest.fixture(scope="module")
def copies(spark):
    return copies_of(
        spark,
        {"tags": ["b", "a"]},
        {"tags": ["a", "b"], "notes": ""},
        {"tags": ["a", "b"], "deck_id": "d1"},
        {"card_id": "c2", "notes": "foil", "collection_id": "k2", "owner": "v"},
        {"card_id": "c2", "collection_id": None, "deck_id": "d1"},
        {"card_id": "lost"},
    )


@pytest.fixture(scope="module")
def collections(spark):
    return spark.createDataFrame([("k1", "Binder", "u"), ("k2", "Box", "v")], "id string, name string, owner string")


@pytest.fixture(scope="module")
def decks(spark):
    return spark.createDataFrame([("d1", "Burn", "u"), ("d2", "Empty", "u")], "id string, name string, owner string")


def test_owned_cards_counts_anyone_and_ephemeral_copies(cards, copies):
    assert sorted(column(joins.owned_cards(cards, copies))) == ["c1", "c2"]
    assert sorted(column(joins.owned_cards(cards, copies, owner="v"))) == ["c2"]
    assert rows(joins.search_total(cards, P.f_power(">=", 0), copies)) == [(2,)]
    assert rows(joins.search_total(cards, P.f_name("none"))) == [(0,)]


def test_search_catalog(cards, copies):
    found = joins.search_catalog(cards, copies, P.f_type("goblin"), "power", "desc", 1, 2, owned=True)
    assert column(found) == ["c1", "c2"]
    assert column(joins.search_catalog(cards, None, None, "name", page=2, page_len=2)) == ["c2"]


def test_search_collection(cards, copies):
    assert sorted(column(joins.search_collection(copies, cards, "k1", P.f_rarity("rare")), "copy_id")) == ["p1", "p2", "p3"]
    assert column(joins.search_collection(copies, cards, "k1", P.f_name("goblin")), "copy_id") == []


def test_detail_copies(cards, copies, collections, decks):
    detailed = joins.detail_copies(copies, cards, collections, decks)
    got = rows(detailed, "copy_id", "card.name", "collection_name", "deck_name", "is_ephemeral")
    assert got == [
        ("p1", "Shivan Dragon", "Binder", None, False),
        ("p2", "Shivan Dragon", "Binder", None, False),
        ("p3", "Shivan Dragon", "Binder", "Burn", False),
        ("p4", "goblin", "Box", None, False),
        ("p5", "goblin", None, "Burn", True),
    ]
    assert column(joins.dangling_copies(copies, cards), "copy_id") == ["p6"]


def test_card_locations_skip_ephemeral_copies_and_match_case(cards, copies, collections, decks):
    found = joins.card_locations(copies, cards, collections, decks, "u", "Shivan Dragon")
    assert sorted(column(found, "copy_id")) == ["p1", "p2", "p3"]
    assert joins.card_locations(copies, cards, collections, decks, "u", "shivan dragon").count() == 0
    assert column(joins.card_locations(copies, cards, collections, decks, "v", "goblin"), "copy_id") == ["p4"]


def test_scan_keeps_order_and_empty_results(spark, cards):
    scans = spark.createDataFrame(
        [("s1", 0, "lost"), ("s1", 1, "c3"), ("s1", 2, "c1"), ("s2", 0, "lost")],
        "detected string, rank int, card_id string",
    )
    enriched = joins.scan_enrich(scans, cards)
    assert rows(enriched, "detected", "rank", "card.name") == [
        ("s1", 1, "Counterspell"),
        ("s1", 2, "Shivan Dragon"),
        ("s2", None, None),
    ]
    assert rows(joins.scan_best_match(scans, cards)) == [("s1", "c3"), ("s2", None)]


def test_scan_results_become_rows(spark):
    found = [("s1", "u", [("c2",), ("c1",)]), ("s2", "u", [])]
    batches = spark.createDataFrame([(2, found), (0, [])], SCAN)
    assert rows(joins.scan_matches(batches)) == [("s1", 0, "c2"), ("s1", 1, "c1"), ("s2", None, None)]


def test_tags(spark, copies):
    library = spark.createDataFrame([("a",)], "label string")
    assert sorted(column(joins.tag_vocabulary(copies), "label")) == ["a", "b"]
    assert column(joins.new_tags(copies, library), "label") == ["b"]


def test_default_collection(spark, collections):
    owners = spark.createDataFrame([("u",), ("w",)], "owner string")
    made = joins.owners_without_collection(owners, collections)
    assert [tuple(r) for r in made.collect()] == [
        ("w", "Main Collection", "My main MTG card collection", True)
    ]


def test_groups(cards, copies, decks):
    groups = rollups.group_copies(copies, cards, decks)
    got = rows(groups, "collection_id", "card_id", "notes", "tags", "deck_id", "quantity", "deck_name")
    assert got == sorted(
        [
            ("k1", "c1", "", "a,b", None, 2, None),
            ("k1", "c1", "", "a,b", "d1", 1, "Burn"),
            ("k2", "c2", "foil", "", None, 1, None),
            (None, "c2", "", "", "d1", 1, "Burn"),
        ],
        key=repr,
    )
    in_order = rollups.group_copies_sorted(groups).select("card_name", "deck_id").collect()
    # Reader order: "goblin" before "Shivan Dragon"; loose copies first.
    assert [tuple(r) for r in in_order] == [
        ("goblin", None),
        ("goblin", "d1"),
        ("Shivan Dragon", None),
        ("Shivan Dragon", "d1"),
    ]
    assert rows(rollups.collection_size(groups)) == sorted([("k1", 3), ("k2", 1), (None, 1)], key=repr)
    members = rollups.group_members(copies)
    assert members.count() == copies.count()


def test_locations(cards, copies):
    both = rollups.locations_union(copies, cards)
    got = rows(both, "type", "location_id", "card_id", "notes", "tags", "quantity", "free_quantity")
    assert got == [
        ("collection", "k1", "c1", "", "a,b", 3, 2),
        ("collection", "k2", "c2", "foil", "", 1, 1),
        ("deck", "d1", "c1", "", "a,b", 1, 0),
    ]
    assert rows(rollups.location_totals(copies, cards)) == [("Shivan Dragon", 3, 2), ("goblin", 1, 1)]


def test_section_and_deck_counts(spark, decks):
    layout = [("d1", "s1", "a"), ("d1", "s1", "b"), ("d1", "s1", "c"), ("d1", "s2", "a"), ("d2", "s1", None)]
    columns = spark.createDataFrame(layout, "deck_id string, section_id string, column_id string")
    sizes = {("s1", "a"): 3, ("s1", "b"): 4, ("s1", "c"): 1}
    placed = [("d1", s, c, i, f"{s}{c}{i}") for (s, c), n in sizes.items() for i in range(n)]
    placements = spark.createDataFrame(
        placed, "deck_id string, section_id string, column_id string, pos int, copy_id string"
    )
    sections = rollups.section_counts(columns, placements)
    assert rows(sections) == [("d1", "s1", 8), ("d1", "s2", 0), ("d2", "s1", 0)]
    assert rows(rollups.deck_counts(decks, placements)) == [("d1", 8), ("d2", 0)]
    total = sections.groupBy("deck_id").agg(F.sum("quantity").alias("n"))
    assert rows(total) == rows(rollups.deck_counts(decks, placements))


def test_basic_printing(spark):
    names = ["Plains", "Island", "Swamp", "Mountain", "Forest"]
    cards = cards_of(
        spark,
        *[{"name": n, "set": "unh", "collector_number": "100"} for n in names],
        {"name": "Plains", "set": "unh", "collector_number": "150"},
        {"name": "Plains", "set": "m21", "collector_number": "1"},
        {"name": "Island", "set": "unh", "collector_number": "20a"},
    )
    best = rollups.basic_printing(cards, names, "unh")
    assert [tuple(r) for r in best.select("name", "id").collect()] == [
        ("Plains", "c1"), ("Island", "c8"), ("Swamp", "c3"), ("Mountain", "c4"), ("Forest", "c5")
    ]


def test_active_audit(spark):
    table = spark.createDataFrame(
        [("u", 1, True), ("u", 2, True), ("v", 3, True), ("v", 4, False), ("w", 5, None)],
        "owner string, id int, is_active boolean",
    )
    assert rows(rollups.active_audit(table)) == [("u", 2)]


SEARCHES = "search_id int, lang string, rarity_min int, cmc_min int, cmc_max int, colors array<string>, name_part string"


def test_saved_searches(spark, cards):
    stored = spark.createDataFrame(
        [
            (1, None, None, None, None, None, None),
            (2, "ja", None, None, None, None, None),
            (3, "en", 2, None, None, None, None),
            (4, None, None, None, None, ["R", "W"], None),
            (5, None, None, 3, 3, [], "OB"),
        ],
        SEARCHES,
    )
    matches = rows(searches.saved_search_match(stored, cards))
    assert matches == [(1, "c1"), (1, "c2"), (1, "c3"), (3, "c1"), (4, "c2"), (5, "c2")]
    assert rows(searches.saved_search_counts(stored, cards)) == [(1, 3), (2, 0), (3, 1), (4, 1), (5, 1)]


def test_no_lookup_collects_a_group(cards, copies, collections, decks):
    """Neither the joins nor the roll-ups gather a group into an array or pair everything up."""
    detailed = joins.detail_copies(copies, cards, collections, decks)
    for df in (detailed, rollups.group_copies(copies, cards, decks), rollups.location_totals(copies, cards)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_details_without_names_join_cards_alone(cards, copies):
    detailed = joins.detail_copies(copies, cards)
    assert {"card", "is_ephemeral"} <= set(detailed.columns) and not {"collection_name", "deck_name"} & set(detailed.columns)
    assert detailed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
