import random

import pytest
from pyspark.sql import functions as F

from curioshelf.operators import arrangement as A
from curioshelf.operators import order_keys, replay

REQUESTS = "copy_id string, deck_id string, section_id string, column_id string, index int, seq long"
PLACEMENTS = "deck_id string, section_id string, column_id string, pos int, copy_id string"
LAYOUT = "deck_id string, section_id string, section_name string, section_pos int, column_id string, column_pos int"


def splice(cards, index, copy):
    cards.insert(len(cards) if index is None else max(0, min(index, len(cards))), copy)


def test_pieces_as_a_list(monkeypatch):
    monkeypatch.setattr(replay, "PIECES", 6)
    r = random.Random(1)
    for n in (0, 1, 7, 60):
        pieces, want = replay.Pieces(n), list(range(n))
        for k in range(400):
            kind = r.random()
            named, ranks = [x for x in want if isinstance(x, str)], [x for x in want if not isinstance(x, str)]
            if kind < 0.25 and named:
                gone = r.choice(named)
                want.remove(gone)
                pieces.remove(gone)
            elif kind < 0.4 and ranks:
                gone = r.choice(ranks)
                want.remove(gone)
                pieces.remove_rank(gone)
            else:
                index = -2 if not want else r.choice([None, -2, 0, 3, len(want), len(want) + 5, r.randrange(len(want) + 1)])
                splice(want, index, f"x{k}")
                pieces.insert(index, f"x{k}")
        after, told = 0, []
        for x in want:
            if isinstance(x, str):
                told.append((x, after))
            else:
                after = x + 1
        assert pieces.named() == told


@pytest.fixture
def world(spark):
    """A deck with three columns of one owner, another deck, and a deck of someone else."""
    layout = [("d", "s", "Main", 0, "a", 0), ("d", "s", "Main", 0, "b", 1), ("d", "t", "Side", 1, "a", 0), ("e", "s", "Main", 0, "a", 0), ("f", "s", "Main", 0, "a", 0)]
    copies = spark.createDataFrame([(f"c{i}", "u", None, 7) for i in range(60)], "copy_id string, owner string, deck_id string, n int")
    decks = spark.createDataFrame([("d", "u"), ("e", "u"), ("f", "other")], "id string, owner string")
    return spark.createDataFrame(layout, LAYOUT), copies, decks


def replayed(spark, world, start, requests, **options):
    """(cards by column, all placements) after the requests."""
    columns, copies, decks = world
    rows = [(*key, n, c) for key, cards in start.items() for n, c in enumerate(cards)]
    flat = spark.createDataFrame(rows, PLACEMENTS) if isinstance(start, dict) else start
    return replay.deck_replay(flat, columns, copies, decks, spark.createDataFrame(requests, REQUESTS), **options)


def listed(placed):
    out = {}
    for r in placed.orderBy("pos", "copy_id").collect():
        out.setdefault((r["deck_id"], r["section_id"], r["column_id"]), []).append(r["copy_id"])
    return out


def plain(start, requests):
    held = {k: list(v) for k, v in start.items()}
    for copy, deck, section, column, index, _ in sorted(requests, key=lambda r: (r[5], r[0])):
        for cards in held.values():
            cards[:] = [c for c in cards if c != copy]
        splice(held.setdefault((deck, section, column), []), index, copy)
    return {k: v for k, v in held.items() if v}


PLACES = [("d", "s", "a"), ("d", "s", "b"), ("d", "t", "a"), ("e", "s", "a")]


@pytest.mark.parametrize("at_once", [1000, 40])
def test_random_requests_one_after_another(spark, world, at_once):
    r = random.Random(at_once)
    start = {("d", "s", "a"): [f"c{i}" for i in range(25)], ("d", "s", "b"): ["c30", "c1", "c31"], ("e", "s", "a"): ["c40"]}
    requests = [(f"c{r.randrange(60)}", *PLACES[min(r.randrange(8), 3) if n % 3 else 0], r.choice([None, 0, 1, -4, 99, r.randrange(30)]), n) for n in range(150)]
    placed, _, copies = replayed(spark, world, start, requests, at_once=at_once)
    assert listed(placed) == plain(start, requests)
    last = {c: d for c, d, *_ in requests}
    assert {x["copy_id"]: x["deck_id"] for x in copies.collect()} == {f"c{i}": last.get(f"c{i}") for i in range(60)}


def test_moves_inside_one_column(spark, world):
    start = {("d", "s", "a"): ["c0", "c1", "c2", "c3"]}
    requests = [("c0", "d", "s", "a", 2, 1), ("c3", "d", "s", "a", 0, 2), ("c0", "d", "s", "a", 1, 3)]
    assert listed(replayed(spark, world, start, requests)[0]) == {("d", "s", "a"): ["c3", "c0", "c1", "c2"]}


def test_made_columns_void_requests_and_none(spark, world):
    start = {("d", "s", "a"): ["c0"]}
    requests = [("c5", "d", "new", None, 0, 1), ("c6", "d", "new", None, 0, 2), ("c7", "f", None, None, 0, 3), ("lost", "d", None, None, 0, 4), ("c8", "d", None, None, 0, 5)]
    placed, layout, _ = replayed(spark, world, start, requests)
    assert listed(placed) == {("d", "s", "a"): ["c8", "c0"], ("d", "made:new", "main"): ["c6", "c5"]}
    assert layout.where("section_id = 'made:new'").count() == 1
    assert listed(replayed(spark, world, start, [])[0]) == start
    assert listed(replayed(spark, world, {}, requests[:1])[0]) == {("d", "made:new", "main"): ["c5"]}


def test_only_what_was_asked_for_is_written(spark, world):
    """The first batch spreads a column without gaps; the next ones write the copies asked for alone."""
    key = ("d", "s", "a")
    cards = [f"k{i}" for i in range(500)]
    flat = spark.createDataFrame([(*key, n, c) for n, c in enumerate(cards)], PLACEMENTS)
    for batch, most in ((1, 501), (2, 20), (3, 20)):
        requests = [(f"c{batch * 20 + i - 20}", *key, 5 + 17 * i, batch * 100 + i) for i in range(20)]
        for copy, *_, index, _ in requests:
            splice(cards, index, copy)
        written, taken = replay.replay_rows(flat, spark.createDataFrame(requests, REQUESTS))
        count = written.count()
        assert 20 <= count <= max(most, 20) + 20 and (batch == 1 or count == 20)
        flat = flat.withColumn("pos", F.col("pos").cast("long")).join(taken, [*A.COLUMN, "copy_id"], "left_anti").select(*written.columns).unionByName(written)
        flat = spark.createDataFrame(flat.collect(), flat.schema)
    assert listed(flat)[key] == cards


def test_the_smallest_stretch_with_room_is_numbered_afresh(spark):
    """Of a list with wide gaps and one crowded place, only rows around that place are written."""
    held = [("g", f"o{i:03}", i + 1, (i + 1) * 1000) for i in range(300)]
    held[100:103] = [("g", f"o{i:03}", i + 1, 101_000 + i - 100) for i in range(100, 103)]
    frame = spark.createDataFrame(held, "grp string, id string, rank long, key long")
    new = [("g", "new1", 101, 0), ("g", "new2", 101, 1), ("g", "new3", 20, 0), ("g", "new4", 0, 0), ("g", "new5", 300, 0)]
    asked = spark.createDataFrame(new, "grp string, id string, after long, turn int")
    keys = {r["id"]: r["key"] for r in order_keys.keys_between(frame, asked, frame.where("id = 'o110'"), ["grp"], "id").collect()}
    assert {"new1", "new2", "new3", "new4", "new5"} <= keys.keys() and len(keys) <= 5 + 63 and "o110" not in keys
    assert all("o063" < k < "o127" for k in keys if k.startswith("o"))
    order = {id: key for _, id, _, key in held} | keys
    want = [id for _, id, _, _ in held]
    for id, after in (("new5", 300), ("new2", 101), ("new1", 101), ("new3", 20), ("new4", 0)):
        want.insert(after, id)
    want.remove("o110")
    del order["o110"]
    assert sorted(order, key=order.get) == want and len(set(order.values())) == len(order)
