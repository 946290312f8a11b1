import pytest
from pyspark.sql import functions as F

from curioshelf.operators import maintenance as M
from curioshelf.operators.paging import list_recent
from tests.helpers import copies_of, rows


@pytest.fixture(scope="module")
def collections(spark):
    return spark.createDataFrame(
        [("k1", "u", "Binder", "", True), ("k2", "u", "Box", "old", False), ("k3", "v", "Bag", "", None)],
        "id string, owner string, name string, description string, is_active boolean",
    )


@pytest.fixture(scope="module")
def decks(spark):
    return spark.createDataFrame([("d1", "u", True), ("d2", "v", True)], "id string, owner string, is_active boolean")


CREATE = (
    "request_id string, owner string, card_id string, collection_id string, deck_id string,"
    " notes string, tags array<string>, quantity double"
)


def test_create(spark, collections, decks, monkeypatch):
    monkeypatch.setattr(M, "CREATE_BLOCK", 2)
    requests = spark.createDataFrame(
        [
            ("r1", "u", "c1", "k1", None, "n", ["a"], 5.9),
            ("r2", "u", "c1", None, "d1", None, None, 0.0),
            ("r3", "u", "c1", None, None, None, None, 1.0),
            ("r4", "u", None, "k1", None, None, None, 1.0),
            ("r5", "u", "c1", "k3", None, None, None, 1.0),
            ("r6", "u", "c1", "k1", "d2", None, None, 1.0),
            ("r7", "u", "c1", "k1", "d1", None, None, None),
        ],
        CREATE,
    )
    status = M.checked_requests(requests, collections, decks)
    assert [s for _, s in rows(status, "request_id", "status")] == [
        "ok", "ok", "no_deck", "no_card", "collection_not_found", "deck_not_found", "ok"
    ]
    made = M.copies_create(requests, collections, decks)
    assert [r[0] for r in rows(made, "copy_id")] == ["r1-1", "r1-2", "r1-3", "r1-4", "r1-5", "r2-1", "r7-1"]
    assert rows(made.filter("copy_id = 'r1-3'"), "notes", "tags", "collection_id") == [("n", ["a"], "k1")]


def test_update_keeps_what_is_not_given(spark, collections):
    copies = copies_of(spark, {"notes": "x", "deck_id": "d1"}, {}, {"owner": "v", "collection_id": "k3"}, {"notes": "y"})
    changes = spark.createDataFrame(
        [
            ("u", "p1", None, ["t"], "k2", 1),
            ("u", "p2", "lost", None, "k3", 1),
            ("u", "p3", "not mine", None, None, 1),
            ("u", "p4", "first", None, None, 1),
            ("u", "p4", "", None, None, 2),
            ("u", "p4", None, ["late"], None, 3),
        ],
        "owner string, copy_id string, notes string, tags array<string>, collection_id string, seq int",
    )
    got = rows(M.copies_update(copies, changes, collections), "copy_id", "notes", "tags", "collection_id", "deck_id")
    assert got == [
        ("p1", "x", ["t"], "k2", "d1"),
        ("p2", None, None, "k1", None),
        ("p3", None, None, "k3", None),
        ("p4", "", ["late"], "k1", None),
    ]


def test_delete_copies(spark, decks):
    copies = copies_of(spark, {"deck_id": "d1"}, {}, {"owner": "v"})
    flat = spark.createDataFrame(
        [("d1", "s", "c", 0, "p1"), ("d1", "s", "c", 1, "p2")],
        "deck_id string, section_id string, column_id string, pos int, copy_id string",
    )
    ids = spark.createDataFrame([("u", "p1"), ("u", "p3")], "owner string, copy_id string")
    left, placed = M.copies_delete(copies, flat, decks, ids)
    assert rows(left, "copy_id") == [("p2",), ("p3",)]
    assert rows(placed, "copy_id") == [("p2",)]


def test_remove_group(spark, decks):
    copies = copies_of(
        spark,
        {"tags": ["a", "b"]},
        {"tags": ["b", "a"], "notes": ""},
        {"tags": ["a", "b"]},
        {"tags": ["a", "b"], "deck_id": "d1"},
        {"tags": ["a"]},
        {"tags": None},
        {"tags": [], "collection_id": "k2"},
        {"tags": ["x,y"]},
        {"tags": ["x", "y"]},
    )
    flat = spark.createDataFrame(
        [("d1", "s", "c", n, f"p{n}") for n in range(1, 8)],
        "deck_id string, section_id string, column_id string, pos int, copy_id string",
    )
    kind = "owner string, collection_id string, card_id string, deck_id string, notes string, tags array<string>, quantity int"

    def left(*requests):
        asked = spark.createDataFrame([("u", *r) for r in requests], kind)
        kept, placed = M.remove_group(copies, flat, decks, asked)
        assert placed.join(kept, "copy_id", "left_anti").count() == 0 and placed.count() == kept.filter("copy_id < 'p8'").count()
        return [c for c, in rows(kept, "copy_id") if c not in ("p8", "p9")]

    assert left(("k1", "c1", None, "", ["b", "a"], 2)) == ["p3", "p4", "p5", "p6", "p7"]
    assert left(("k1", "c1", None, None, ["a", "b"], 1), ("k1", "c1", None, "", ["b", "a"], 1)) == ["p3", "p4", "p5", "p6", "p7"]
    assert left(("k1", "c1", "d1", None, ["a", "b"], 9)) == ["p1", "p2", "p3", "p5", "p6", "p7"]
    assert left(("k1", "c1", None, None, None, 9), ("k2", "c1", None, None, None, 0)) == ["p1", "p2", "p3", "p4", "p5", "p7"]
    assert len(left(("k1", "other", None, None, None, 9), (None, "c1", None, None, None, 9))) == 7
    asked = spark.createDataFrame([("u", "k1", "c1", None, "", ["y", "x"], 9)], kind)
    assert rows(copies.join(M.remove_group(copies, flat, decks, asked)[0], "copy_id", "left_anti"), "copy_id") == [("p9",)]


def test_delete_collection_cascades(spark, collections, decks):
    copies = copies_of(spark, {"deck_id": "d1"}, {"collection_id": "k2"}, {"collection_id": None, "deck_id": "d1"})
    flat = spark.createDataFrame(
        [("d1", "s", "c", 0, "p1"), ("d1", "s", "c", 1, "p3")],
        "deck_id string, section_id string, column_id string, pos int, copy_id string",
    )
    ids = spark.createDataFrame([("u", "k1"), ("u", "k3")], "owner string, id string")
    kept, left, placed = M.delete_collection(collections, copies, flat, decks, ids)
    assert rows(kept, "id") == [("k2",), ("k3",)]
    assert rows(left, "copy_id") == [("p2",), ("p3",)]
    assert rows(placed, "copy_id") == [("p3",)]


def test_delete_deck(spark, decks):
    copies = copies_of(spark, {"deck_id": "d1"}, {"deck_id": "d1", "collection_id": None}, {"deck_id": "d2"}, {})
    ids = spark.createDataFrame([("u", "d1"), ("u", "d2")], "owner string, id string")
    columns = spark.createDataFrame([("d1", "s", "a"), ("d2", "s", "b")], "deck_id string, section_id string, column_id string")
    flat = columns.withColumn("copy_id", F.concat(F.lit("p"), F.substring("deck_id", 2, 1)))
    kept, left, layout, placed = M.delete_deck(decks, copies, columns, flat, ids)
    assert rows(layout, "deck_id") == [("d2",)] and rows(placed, "copy_id") == [("p2",)]
    assert rows(kept, "id") == [("d2",)]
    assert rows(left, "copy_id", "deck_id") == [("p1", None), ("p3", "d2"), ("p4", None)]


@pytest.mark.parametrize(
    "requests, active",
    [
        ([("u", "k2", True)], ["k2"]),
        ([("u", "k2", True), ("u", "k1", True)], ["k1"]),
        ([("u", "k1", False)], []),
        ([("u", "k1", False), ("u", "k2", True), ("u", "k2", False)], []),
        ([("u", "k2", False), ("u", "k2", True), ("u", "k1", False)], ["k2"]),
        ([("u", "k3", True)], ["k1"]),
        ([("v", "k3", True)], ["k1", "k3"]),
    ],
)
def test_set_active(spark, collections, requests, active):
    asked = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(requests)], "owner string, id string, is_active boolean, seq int"
    )
    got = M.set_active(collections, asked).filter("is_active")
    assert [r[0] for r in rows(got, "id")] == active


def test_new_and_changed_entities(spark, collections):
    asked = spark.createDataFrame(
        [("u", "n1", "New", None), ("u", "n2", "", "x"), ("u", "n3", None, "x")],
        "owner string, id string, name string, description string",
    )
    assert rows(M.collections_create(asked)) == [("u", "n1", "New", "", False)]
    made, layout = M.decks_create(asked)
    assert rows(made, "id") == [("n1",)]
    assert rows(layout) == [("n1", "main", "Main", 0, "main", 0)]
    changes = spark.createDataFrame(
        [("u", "k1", "A", None, 1), ("u", "k1", None, "d", 2), ("u", "k2", None, "", 1), ("u", "k3", "Mine", None, 1)],
        "owner string, id string, name string, description string, seq int",
    )
    assert rows(M.entity_update(collections, changes), "id", "name", "description") == [
        ("k1", "A", "d"), ("k2", "Box", ""), ("k3", "Bag", "")
    ]


def test_moves(spark, collections, decks):
    copies = copies_of(spark, {"deck_id": "d1"}, {}, {"collection_id": None, "deck_id": "d1"})
    kind = "owner string, copy_id string, from_deck boolean, to_collection string, to_deck string"
    cases = {
        ("u", "p1", True, "k2", None): ("taken_out", "k2", None),
        ("u", "p1", False, "k2", None): ("moved", "k2", "d1"),
        ("u", "p1", True, "k1", None): ("taken_out", "k1", None),
        ("u", "p1", False, "k1", None): ("unchanged", "k1", "d1"),
        ("u", "p2", False, "k3", None): ("collection_not_found", "k1", None),
        ("u", "p2", False, None, "d1"): ("placed", "k1", "d1"),
        ("u", "p2", False, None, "d2"): ("deck_not_found", "k1", None),
        ("u", "p3", True, "k1", None): ("rejected_ephemeral", None, "d1"),
        ("u", "p3", True, None, "d2"): ("rejected_ephemeral", None, "d1"),
        ("u", "p3", True, None, "d1"): ("placed", None, "d1"),
        ("v", "p1", False, "k3", None): ("copy_not_found", None, None),
    }
    for i, (move, expected) in enumerate(cases.items()):
        got = M.bulk_move(copies, collections, decks, spark.createDataFrame([move], kind))
        assert rows(got, "action", "collection_id", "deck_id") == [expected], i


def test_create_places_and_moves_whole_tables(spark, collections, decks):
    columns = spark.createDataFrame(
        [("d1", "s", "S", 0, "a", 0), ("d1", "s", "S", 0, "b", 1)],
        "deck_id string, section_id string, section_name string, section_pos int, column_id string, column_pos int",
    )
    flat = spark.createDataFrame(
        [("d1", "s", "a", n, c) for n, c in enumerate(["x", "y"])],
        "deck_id string, section_id string, column_id string, pos bigint, copy_id string",
    )
    requests = spark.createDataFrame(
        [
            ("r1", "u", "c1", "k1", "d1", None, ["new"], 11.0, "s", "a", 1, 5),
            ("r2", "u", "c1", None, "d1", None, None, 1.0, None, None, None, 6),
            ("r3", "u", "c1", "k1", None, None, None, 1.0, None, None, 0, 7),
            ("r4", "u", "c1", "k1", "d2", None, None, 1.0, None, None, 0, 8),
        ],
        CREATE + ", section_id string, column_id string, index int, seq int",
    )
    made, placed, layout = M.copies_create_placed(requests, collections, decks, columns, flat)
    in_column = [r["copy_id"] for r in placed.filter("column_id = 'a'").orderBy("pos").collect()]
    assert in_column == ["x", *[f"r1-{n}" for n in range(1, 12)], "y", "r2-1"]
    assert made.count() == 13 and rows(layout) == rows(columns)

    copies = copies_of(spark, {"copy_id": "x", "deck_id": "d1"}, {"copy_id": "y", "deck_id": "d1"}, {"copy_id": "z"})
    kind = "owner string, copy_id string, from_deck boolean, to_collection string, to_deck string, section_id string, column_id string, index int, seq int"
    moves = spark.createDataFrame(
        [
            ("u", "x", True, "k2", None, None, None, None, 1),
            ("u", "z", False, "k2", None, None, None, None, 2),
            ("u", "z", False, None, "d1", "s", "a", 0, 3),
            ("u", "y", False, "k2", None, None, None, None, 4),
            ("v", "y", False, "k3", None, None, None, None, 5),
        ],
        kind,
    )
    after, placed, _ = M.bulk_move_tables(copies, collections, decks, columns, flat, moves)
    assert rows(after, "copy_id", "collection_id", "deck_id") == [("x", "k2", None), ("y", "k2", "d1"), ("z", "k1", "d1")]
    assert [r["copy_id"] for r in placed.orderBy("pos").collect()] == ["z", "y"]


def test_changes_are_dated_and_recent_ones_listed_first(spark):
    kind = "id string, owner string, name string, description string, is_active boolean, updated_at timestamp_ntz"
    table = spark.createDataFrame([(i, "u", i, "", False, None) for i in "abc"], kind.replace("timestamp_ntz", "string"))
    table = table.withColumn("updated_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, ascii(id))"))
    change = spark.createDataFrame([("u", "a", "renamed", None, 1)], "owner string, id string, name string, description string, seq int")
    once = M.entity_update(table, change, "2025-01-01 00:00:00")
    assert [r["id"] for r in list_recent(once).collect()] == ["a", "c", "b"]
    switch = spark.createDataFrame([("u", "b", True, 1)], "owner string, id string, is_active boolean, seq int")
    twice = M.set_active(once, switch, "2025-01-02 00:00:00")
    assert [r["id"] for r in list_recent(twice).collect()] == ["b", "a", "c"]
    assert twice.schema == table.schema
    new = M.collections_create(table.select("owner", F.lit("d").alias("id"), "name", "description").limit(1), "2025-01-03 00:00:00")
    assert [r["id"] for r in list_recent(twice.unionByName(new)).collect()] == ["d", "b", "a", "c"]
    copies = copies_of(spark, {}, {}).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    given = spark.createDataFrame([("u", "p1", "n", None, None, 1)], "owner string, copy_id string, notes string, tags array<string>, collection_id string, seq int")
    owned = spark.createDataFrame([], "id string, owner string")
    dated = M.copies_update(copies, given, owned, "2025-01-01 00:00:00")
    assert [r["updated_at"] is not None for r in dated.orderBy("copy_id").collect()] == [True, False]
