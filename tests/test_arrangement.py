import random

import pytest
from pyspark.sql import functions as F

from curioshelf.operators import arrangement as A
from curioshelf.sources.schema import DECK
from tests.helpers import copies_of, rows

COLUMNS = (
    "deck_id string, section_id string, section_name string, section_pos int,"
    " column_id string, column_pos int"
)
PLACEMENTS = "deck_id string, section_id string, column_id string, pos bigint, copy_id string"
REQUESTS = "copy_id string, deck_id string, section_id string, column_id string, index int, seq int"


@pytest.fixture(scope="module")
def decks(spark):
    return spark.createDataFrame([("d1", "u"), ("d2", "u"), ("x", "v")], "id string, owner string")


@pytest.fixture(scope="module")
def columns(spark):
    return spark.createDataFrame(
        [
            ("d1", "s1", "Main", 0, "a", 0),
            ("d1", "s1", "Main", 0, "b", 1),
            ("d1", "s2", "Side", 1, "a", 0),
            ("d1", "s3", "Bare", 2, None, None),
        ],
        COLUMNS,
    )


def placements_of(spark, **lists):
    """``s1_a=["p1", ...]`` for deck d1."""
    data = []
    for key, ids in lists.items():
        section, column = key.split("_")
        data += [("d1", section, column, i, c) for i, c in enumerate(ids)]
    return spark.createDataFrame(data, PLACEMENTS)


def listed(placements):
    """{(deck, section, column): ordered ids} collected from the flat form."""
    out = {}
    for r in placements.orderBy("deck_id", "section_id", "column_id", "pos", "copy_id").collect():
        out.setdefault((r.deck_id, r.section_id, r.column_id), []).append(r.copy_id)
    return out


@pytest.mark.parametrize("max_cards", [2, 100])
def test_assemble_then_explode_gives_the_arrangement_back(spark, columns, max_cards):
    flat = placements_of(spark, s1_a=["p3", "p1", "p2"], s2_a=["p4"])
    nested = A.deck_assemble(columns, flat, max_cards)
    back = A.deck_explode(nested)
    parts = back.orderBy("deck_id", "part", "section_pos", "column_pos", "pos").collect()
    got = {}
    for r in parts:
        got.setdefault((r.section_id, r.column_id), []).append(r.copy_id)
    assert got == {
        ("s1", "a"): ["p3", "p1", "p2"],
        ("s1", "b"): [None],
        ("s2", "a"): ["p4"],
        ("s3", None): [None],
    }
    held = [
        sum(len(c.cards) for s in r.sections for c in s.columns) for r in nested.collect()
    ]
    assert sum(held) == 4 and max(held) <= max_cards


def test_explode_keeps_empty_columns(spark):
    documents = [
        {"id": "d", "sections": [("s", "Main", [("a", ["p1", "p2"]), ("b", [])]), ("t", "Side", [])]},
        {"id": "e", "sections": []},
    ]
    decks = spark.createDataFrame([tuple(d.get(f) for f in DECK.names) for d in documents], DECK)
    decks = decks.withColumnRenamed("id", "deck_id")
    flat = A.deck_explode(decks)
    assert rows(flat, "deck_id", "section_id", "column_id", "pos", "copy_id") == sorted(
        [
            ("d", "s", "a", 0, "p1"),
            ("d", "s", "a", 1, "p2"),
            ("d", "s", "b", None, None),
            ("d", "t", None, None, None),
            ("e", None, None, None, None),
        ],
        key=repr,
    )


def test_reconcile_appends_orphans_and_makes_what_is_missing(spark, columns, decks):
    copies = copies_of(
        spark,
        {"deck_id": "d1"},
        {"deck_id": "d1"},
        {"deck_id": "d2"},
        {"deck_id": "d1", "owner": "v"},
        {"deck_id": "d1"},
    )
    flat = placements_of(spark, s1_a=["p5"], s2_a=["p1"])
    assert rows(A.deck_orphans(flat, copies, decks)) == [("d1", "p2"), ("d2", "p3")]
    placed, layout = A.deck_reconcile(flat, columns, copies, decks)
    assert listed(placed) == {
        ("d1", "s1", "a"): ["p5", "p2"],
        ("d1", "s2", "a"): ["p1"],
        ("d2", "main", "main"): ["p3"],
    }
    assert rows(layout.filter("deck_id = 'd2'")) == [("d2", "main", "Main", 0, "main", 0)]
    assert layout.filter("deck_id = 'd1'").count() == columns.count()
    again, same = A.deck_reconcile(placed, layout, copies, decks)
    assert listed(again) == listed(placed) and rows(same) == rows(layout)


def place(spark, flat, columns, decks, copies, *requests):
    asked = spark.createDataFrame([(c, "d1", s, k, i, n) for n, (c, s, k, i) in enumerate(requests)], REQUESTS)
    return A.deck_place(flat, columns, copies, decks, asked)


def test_place_at_an_index_clamped_or_at_the_end(spark, columns, decks):
    copies = copies_of(spark, *[{} for _ in range(8)])
    flat = placements_of(spark, s1_a=["p1", "p2", "p3"], s2_a=["p4"])
    for index, want in ((0, 0), (2, 2), (9, 3), (-4, 0), (None, 3)):
        placed, _, moved = place(spark, flat, columns, decks, copies, ("p8", "s1", "a", index))
        expected = ["p1", "p2", "p3"]
        expected.insert(want, "p8")
        assert listed(placed)["d1", "s1", "a"] == expected
        assert rows(moved.filter("copy_id = 'p8'"), "deck_id") == [("d1",)]


def test_place_moves_from_wherever_the_copy_was(spark, columns, decks):
    copies = copies_of(spark, *[{"deck_id": "d1"} for _ in range(5)])
    flat = placements_of(spark, s1_a=["p1", "p2", "p3"], s2_a=["p4"])
    placed, _, _ = place(
        spark, flat, columns, decks, copies, ("p1", "s1", "a", 1), ("p4", None, None, 0), ("nobody", None, None, 0)
    )
    assert listed(placed) == {("d1", "s1", "a"): ["p4", "p2", "p1", "p3"]}


def test_place_makes_missing_sections_and_columns(spark, columns, decks):
    copies = copies_of(spark, *[{} for _ in range(4)])
    flat = placements_of(spark, s1_a=["p9"])
    placed, layout, _ = place(
        spark, flat, columns, decks, copies, ("p1", "gone", None, None), ("p2", "s2", "gone", None), ("p3", "s3", None, 0)
    )
    assert listed(placed) == {
        ("d1", "made:gone", "main"): ["p1"],
        ("d1", "s1", "a"): ["p9"],
        ("d1", "s2", "made:gone"): ["p2"],
        ("d1", "s3", "main"): ["p3"],
    }
    made = layout.filter("column_id in ('main', 'made:gone')")
    assert rows(made) == [
        ("d1", "made:gone", "Main", 3, "main", 0),
        ("d1", "s2", "Side", 1, "made:gone", 1),
        ("d1", "s3", "Bare", 2, "main", 0),
    ]
    assert layout.filter("column_id is null").count() == 0


def test_place_leaves_other_owners_alone(spark, columns, decks):
    copies = copies_of(spark, {"owner": "v"})
    flat = placements_of(spark, s1_a=["p9"])
    placed, _, moved = place(spark, flat, columns, decks, copies, ("p1", "s1", "a", 0))
    assert listed(placed) == {("d1", "s1", "a"): ["p9"]}
    assert rows(moved, "deck_id") == [(None,)]


@pytest.mark.parametrize(
    "drops", [[1, 2, 3], [0, 0], [2, 2, 2], [99, 100], [None, None], [3, 3], [99, None, 99], [0, 1, 2, 3], [2, 3]]
)
def test_drops_as_one_splice_after_another(spark, columns, decks, drops):
    names = ["x", "y", "z", "w"][: len(drops)]
    copies = copies_of(spark, *[{"copy_id": c} for c in ["a", "b", "c", *names]])
    want = ["a", "b", "c"]
    for name, index in zip(names, drops, strict=True):
        want.insert(len(want) if index is None else max(0, min(index, len(want))), name)
    requests = [(name, "s1", "a", index) for name, index in zip(names, drops, strict=True)]
    placed, _, _ = place(spark, placements_of(spark, s1_a=["a", "b", "c"]), columns, decks, copies, *requests)
    assert listed(placed)["d1", "s1", "a"] == want


def test_an_invalid_last_request_does_not_count(spark, columns, decks):
    copies = copies_of(spark, {})
    asked = spark.createDataFrame([("p1", "d1", "s1", "a", 0, 1), ("p1", "foreign", "s1", "a", 0, 2)], REQUESTS)
    owned = decks.union(spark.createDataFrame([("foreign", "someone")], "id string, owner string").select(*[F.col(c) if c in ("id", "owner") else F.lit(None).alias(c) for c in decks.columns]))
    placed, _, _ = A.deck_place(placements_of(spark, s1_a=["p9"]), columns, copies, owned, asked)
    assert listed(placed)["d1", "s1", "a"] == ["p1", "p9"]


def test_a_batch_of_placements_against_brute_force(spark, columns, decks):
    rng = random.Random(5)
    ids = [f"p{i}" for i in range(1, 41)]
    copies = copies_of(spark, *[{} for _ in ids])
    start = {"s1_a": ids[:15], "s1_b": ids[15:20], "s2_a": ids[20:28]}
    flat = placements_of(spark, **start)
    chosen = rng.sample(ids, 18)
    wanted = [(c, *rng.choice([("s1", "a"), ("s1", "b"), ("s2", "a")]), rng.choice([None, -1, 0, 2, 5, 99])) for c in chosen]
    placed, _, _ = place(spark, flat, columns, decks, copies, *wanted)

    expected = {}
    for key, held in start.items():
        section, col = key.split("_")
        base = [c for c in held if c not in chosen]
        runs, before = [], None
        for c, s, k, index in wanted:
            if (s, k) == (section, col):
                spot = None if index is None else max(0, index)
                if before is not None and spot == before + 1:
                    runs[-1][1].append(c)
                else:
                    runs.append((spot, [c]))
                before = spot
        merged = []
        for i in range(len(base) + 1):
            for spot, run in runs[::-1]:
                merged += run if spot == i else []
            merged += base[i : i + 1]
        for spot, run in runs:
            merged += run if spot is None or spot > len(base) else []
        if merged:
            expected["d1", section, col] = merged
    assert listed(placed) == expected
    # Columns that gained a copy are numbered densely.
    assert placed.groupBy(*A.COLUMN).agg(F.max("pos").alias("m"), F.count("*").alias("n")).filter("m + 1 <> n").count() == 0


def test_pull_and_remove(spark, decks):
    flat = placements_of(spark, s1_a=["p1", "p2", "p3"], s1_b=["p4"])
    copies = copies_of(
        spark, {"deck_id": "d1"}, {"deck_id": "d1", "collection_id": None}, {"deck_id": "d1"}, {"deck_id": "d1", "owner": "v"}
    )
    ids = spark.createDataFrame([("u", "p1"), ("u", "p2"), ("v", "p3"), ("u", "p4")], "owner string, copy_id string")
    assert listed(A.deck_pull(flat, decks, ids)) == {("d1", "s1", "a"): ["p3"]}
    placed, left = A.deck_remove(flat, copies, decks, ids)
    assert listed(placed) == {("d1", "s1", "a"): ["p3"], ("d1", "s1", "b"): ["p4"]}
    assert rows(left, "copy_id", "deck_id") == [("p1", None), ("p3", "d1"), ("p4", "d1")]


def test_sections(spark, columns, decks):
    adds = spark.createDataFrame(
        [("d1", "n1", None, 1), ("d1", "n2", "Maybe", 2), ("d2", "n1", "", 1), ("gone", "n1", "No", 1)],
        "deck_id string, section_id string, name string, seq int",
    )
    added = A.section_add(columns, decks, adds).filter("section_id like 'n%'")
    assert rows(added, "deck_id", "section_name", "section_pos", "column_id") == [
        ("d1", "Maybe", 4, "main"),
        ("d1", "New Section", 3, "main"),
        ("d2", "New Section", 0, "main"),
    ]
    names = spark.createDataFrame([("d1", "s2", "Board"), ("d1", "zz", "No")], "deck_id string, section_id string, name string")
    renamed = A.section_rename(columns, names)
    assert rows(renamed.select("section_id", "section_name").distinct()) == [("s1", "Main"), ("s2", "Board"), ("s3", "Bare")]
    order = spark.createDataFrame([("d1", "s3", 0), ("d1", "s1", 1)], "deck_id string, section_id string, place int")
    moved = A.section_reorder(columns, order).select("section_id", "section_pos").distinct()
    assert rows(moved.orderBy("section_pos")) == [("s1", 2), ("s2", 0), ("s3", 1)]


def test_columns(spark, columns):
    adds = spark.createDataFrame(
        [("d1", "s1", "n1", 1), ("d1", "s1", "n2", 2), ("d1", "s3", "n1", 1), ("d1", "zz", "n1", 1)],
        "deck_id string, section_id string, column_id string, seq int",
    )
    added = A.column_add(columns, adds)
    assert rows(added.filter("column_id like 'n%'"), "section_id", "column_id", "column_pos") == [
        ("s1", "n1", 2), ("s1", "n2", 3), ("s3", "n1", 0)
    ]
    assert added.filter("column_id is null").count() == 0
    order = spark.createDataFrame([("d1", "s1", "b", 0)], "deck_id string, section_id string, column_id string, place int")
    moved = A.column_reorder(columns, order).filter("section_id = 's1'")
    assert rows(moved, "column_id", "column_pos") == [("a", 0), ("b", 1)]


def test_only_empty_sections_and_columns_are_deleted(spark, columns):
    flat = placements_of(spark, s1_a=["p1"])
    asked = spark.createDataFrame([("d1", "s1"), ("d1", "s2"), ("d1", "zz")], "deck_id string, section_id string")
    left, report = A.section_delete_empty(columns, flat, asked)
    assert rows(report, "section_id", "status") == [("s1", "not_empty"), ("s2", "deleted"), ("zz", "not_found")]
    assert sorted({r.section_id for r in left.collect()}) == ["s1", "s3"]
    asked = spark.createDataFrame(
        [("d1", "s1", "a"), ("d1", "s1", "b"), ("d1", "s2", "a")], "deck_id string, section_id string, column_id string"
    )
    left, report = A.column_delete_empty(columns, flat, asked)
    assert rows(report, "section_id", "column_id", "status") == [
        ("s1", "a", "not_empty"), ("s1", "b", "deleted"), ("s2", "a", "deleted")
    ]
    assert rows(left, "section_id", "section_name", "column_id") == sorted(
        [("s1", "Main", "a"), ("s2", "Side", None), ("s3", "Bare", None)], key=repr
    )


def test_runs_of_a_hot_column(spark):
    """Most requests go to one column: runs are those of one look after another, over many ranges."""
    r = random.Random(5)
    asked, want, at = [], {}, None
    for k in range(3000):
        hot = k % 10 != 0
        index = None if r.random() < 0.05 else (at + 1 if hot and at is not None and r.random() < 0.8 else r.randrange(-3, 40))
        asked.append((f"p{k}", k // 2 if k % 7 == 0 else k, index, "d", "s", "c" if hot else f"c{k % 3}"))
        at = max(index, 0) if hot and index is not None else (None if hot else at)
    for column in {a[5] for a in asked}:
        last = run = None
        for copy, seq, index, *_ in sorted((a for a in asked if a[5] == column), key=lambda a: (a[1], a[0])):
            now = None if index is None else max(index, 0)
            if now is None or last is None or last + 1 != now:
                run = (now, seq)
            want[copy], last = run, now
    placed = spark.createDataFrame(asked, "copy_id string, seq long, index int, deck_id string, section_id string, column_id string")
    got = {x["copy_id"]: (x["_start"], x["_first"]) for x in A._runs(placed.repartition(5)).collect()}
    assert got == want
