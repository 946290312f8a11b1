"""Roll-ups kept up to date by changes instead of being counted again.

A batch of changes is the rows that are gone (``before``) and the rows that are new (``after``); a
changed row is in both.  Counted with signs they are the difference of every roll-up.  Only groups that
the changes touch are read and written; a group that comes to nothing is taken away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curioshelf.functions.keys import notes_key, tags_key
from curioshelf.session import settled

GROUP = ["collection_id", "card_id", "notes", "tags", "deck_id"]
LOCATION = ["collection_id", "card_id", "notes", "tags"]


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both, with ``sign`` -1 for those gone and 1 for those new."""
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined as ``l`` and ``r`` on keys of which nulls are equal; both may come from one table."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.alias("l").join(right.alias("r"), reduce(lambda p, q: p & q, same), how)


def differences(changes: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Per group that ``changes`` (with ``sign``) touch, what each measure gains; groups whose
    measures all stay the same are left out.  Summed before the shuffle, so a hot group is one row a
    task."""
    sums = [F.sum(F.col("sign") * m).alias(name) for name, m in measures.items()]
    moved = reduce(lambda p, q: p | q, [F.col(name) != 0 for name in measures])
    return changes.groupBy(*keys).agg(*sums).filter(moved)


def touched_groups(stored: DataFrame, delta: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The groups of ``delta`` with their new totals, to be written over the stored ones."""
    old = stored.select(*keys, *measures)
    met = _met(delta, old, keys, "left")
    kinds = dict(stored.dtypes)
    total = lambda m: (F.coalesce(F.col(f"r.{m}"), F.lit(0)) + F.col(f"l.{m}")).cast(kinds[m]).alias(m)
    return met.select(*[F.col(f"l.{k}").alias(k) for k in keys], *[total(m) for m in measures])


def updated(stored: DataFrame, changes: DataFrame, keys: list[str], measures: dict[str, Column], counted: str) -> DataFrame:
    """``stored`` (keys and measures) after ``changes``; groups whose ``counted`` is 0 are gone."""
    names = list(measures)
    delta = settled(differences(changes, keys, measures))
    written = touched_groups(stored, delta, keys, names)
    base = stored.select(*keys, *names)
    return _met(base, delta.select(*keys), keys, "left_anti").unionByName(written.filter(F.col(counted) > 0))


def _keyed(changes: DataFrame) -> DataFrame:
    return changes.withColumn("notes", notes_key()).withColumn("tags", tags_key())


def group_copies_updated(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """Quantities per display row (GROUP, quantity) after changes of copies."""
    return updated(groups, _keyed(changes), GROUP, {"quantity": F.lit(1)}, "quantity")


def locations_updated(locations: DataFrame, changes: DataFrame) -> DataFrame:
    """Quantities and free quantities per collection and display key (LOCATION) after changes."""
    free = F.col("deck_id").isNull().cast("int")
    inside = _keyed(changes.filter(F.col("collection_id").isNotNull()))
    return updated(locations, inside, LOCATION, {"quantity": F.lit(1), "free_quantity": free}, "quantity")


def deck_counts_updated(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Copies per deck (deck_id, quantity) after changes of placements; decks that become empty stay."""
    delta = settled(differences(changes, ["deck_id"], {"quantity": F.lit(1)}))
    written = touched_groups(counts, delta, ["deck_id"], ["quantity"])
    return _met(counts.select("deck_id", "quantity"), delta.select("deck_id"), ["deck_id"], "left_anti").unionByName(written)


def collection_value_updated(values: DataFrame, changes: DataFrame, prices: DataFrame) -> DataFrame:
    """Value, copies and priced copies per owner (owner, value, copies, priced) after changes of
    copies, at the ``prices`` (card_id, usd) that the stored values were made with.  Changes are
    counted per owner and card before they meet the prices."""
    net = differences(changes, ["owner", "card_id"], {"sign": F.lit(1)})
    priced = net.join(prices.select("card_id", F.col("usd").cast("decimal(12,2)").alias("usd")), "card_id", "left")
    usd = F.coalesce(F.col("usd"), F.lit(0).cast("decimal(12,2)"))
    measures = {"value": usd, "copies": F.lit(1), "priced": F.col("usd").isNotNull().cast("int")}
    return updated(values, priced, ["owner"], measures, "copies")


def first_ids_updated(firsts: DataFrame, changes: DataFrame, after: DataFrame, keys: list[str], id: str) -> DataFrame:
    """The smallest ``id`` per group (keys, id) after changes.

    A group that lost its first is looked up again in ``after``, the whole table as it is now; any
    other takes the smaller of its first and of what came in.  ids are distinct."""
    came = changes.filter("sign > 0").groupBy(*keys).agg(F.min(id).alias("_new"))
    gone = changes.filter("sign < 0").select(*keys, id)
    old = firsts.select(*keys, id)
    lost = settled(_met(old, gone, [*keys, id], "left_semi"))
    again = _met(after, lost.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min(id).alias(id))
    held = _met(old, lost, keys, "left_anti")
    grown = _met(came, lost, keys, "left_anti")
    met = _met(held, grown, keys, "full")
    named = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    return met.select(*named, F.least(F.col(f"l.{id}"), F.col("r._new")).alias(id)).unionByName(again)
