"""Roll-ups after changes equal those counted again, and only touched groups are written."""

import random

import pytest
from pyspark.sql import functions as F

from curioshelf.operators import deltas, prices, rollups
from tests.helpers import rows

COPIES = "copy_id string, owner string, card_id string, collection_id string, deck_id string, notes string, tags array<string>"


def a_copy(r, n):
    return (f"p{n:04}", r.choice("uvw"), r.choice(["hot", "hot", "a", "b", "c"]), r.choice([None, "x", "x", "y", "z"]), r.choice([None, "d1", "d2"]), r.choice([None, "", "foil"]), r.choice([None, [], ["b", "a"], ["a", "b"]]))


@pytest.fixture(scope="module")
def batches(spark):
    """Three batches of changes over one table: [(before, gone, new, after)]."""
    r = random.Random(3)
    table, n, out = {c[0]: c for c in (a_copy(r, k) for k in range(300))}, 300, []
    frame = lambda some: spark.createDataFrame(list(some), COPIES)
    for _ in range(3):
        before = dict(table)
        chosen = r.sample(sorted(table), 60)
        gone = [table[k] for k in chosen]
        new = []
        for k in chosen:
            old = table.pop(k)
            if r.random() < 0.6:
                new.append((k, *a_copy(r, 0)[1:]) if r.random() < 0.8 else old)  # some do not change at all
        new += [a_copy(r, n + k) for k in range(30)]
        n += 30
        table |= {c[0]: c for c in new}
        out.append((frame(before.values()), frame(gone), frame(new), frame(table.values())))
    return out


def groups(copies):
    return deltas._keyed(copies).groupBy(*deltas.GROUP).agg(F.count("*").alias("quantity"))


def locations(copies):
    kept = deltas._keyed(copies.where("collection_id is not null"))
    return kept.groupBy(*deltas.LOCATION).agg(F.count("*").alias("quantity"), F.count_if(F.col("deck_id").isNull()).alias("free_quantity"))


def test_counts(batches):
    stored, places = groups(batches[0][0]), locations(batches[0][0])
    for _, gone, new, after in batches:
        changes = deltas.signed(gone, new)
        stored = deltas.group_copies_updated(stored, changes)
        places = deltas.locations_updated(places, changes)
        stored, places = (d.sparkSession.createDataFrame(d.collect(), d.schema) for d in (stored, places))
        assert rows(stored, *deltas.GROUP, "quantity") == rows(groups(after), *deltas.GROUP, "quantity")
        assert rows(places, *deltas.LOCATION, "quantity", "free_quantity") == rows(locations(after), *deltas.LOCATION, "quantity", "free_quantity")


def test_values_and_firsts(spark, batches):
    cost = spark.createDataFrame([("hot", 1.25), ("a", 2.0), ("b", None)], "card_id string, usd double")
    values = prices.collection_value(batches[0][0], cost)
    firsts = batches[0][0].groupBy("collection_id").agg(F.min("copy_id").alias("copy_id"))
    for _, gone, new, after in batches:
        changes = deltas.signed(gone, new)
        values = deltas.collection_value_updated(values, changes, cost)
        firsts = deltas.first_ids_updated(firsts, changes, after, ["collection_id"], "copy_id")
        values, firsts = (spark.createDataFrame(d.collect(), d.schema) for d in (values, firsts))
        assert rows(values, "owner", "value", "copies", "priced") == rows(prices.collection_value(after, cost), "owner", "value", "copies", "priced")
        assert rows(firsts, "collection_id", "copy_id") == rows(after.groupBy("collection_id").agg(F.min("copy_id").alias("copy_id")), "collection_id", "copy_id")


def test_only_touched_groups_are_written(spark, batches):
    before, gone, *_ = batches[0]
    one = gone.limit(1)
    delta = deltas.differences(deltas._keyed(deltas.signed(one, one.withColumn("deck_id", F.lit("d9")))), deltas.GROUP, {"quantity": F.lit(1)})
    assert deltas.touched_groups(groups(before), delta, deltas.GROUP, ["quantity"]).count() == 2
    same = deltas.differences(deltas._keyed(deltas.signed(gone, gone)), deltas.GROUP, {"quantity": F.lit(1)})
    assert same.count() == 0


def test_decks_that_become_empty_stay(spark):
    decks = spark.createDataFrame([("d1",), ("d2",)], "id string")
    placements = spark.createDataFrame([("d1", "p1"), ("d1", "p2"), ("d2", "p3")], "deck_id string, copy_id string")
    changes = deltas.signed(placements.where("copy_id in ('p1', 'p3')"), placements.limit(0))
    assert rows(deltas.deck_counts_updated(rollups.deck_counts(decks, placements), changes), "deck_id", "quantity") == [("d1", 1), ("d2", 0)]
    nothing = deltas.signed(placements.limit(0), placements.limit(0))
    assert rows(deltas.deck_counts_updated(rollups.deck_counts(decks, placements), nothing), "deck_id", "quantity") == [("d1", 2), ("d2", 1)]
