import datetime as dt
import random

import pytest

from curioshelf.operators.asof import as_of
from curioshelf.operators.prices import price_convert_as_of
from tests.helpers import rows

DAY = "INTERVAL '24' HOUR"
ASKED, LOG = "id int, key string, time timestamp_ntz, _t int", "key string, at timestamp_ntz, value int, id int"


def moment(hours):
    return None if hours is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def plain(asked, log, hours=24):
    out = []
    for i, key, time, _ in asked:
        fits = [r for r in log if key is not None and time is not None and r[0] == key and r[1] is not None and r[1] <= time and r[1] > time - dt.timedelta(hours=hours)]
        out.append((i, max(fits, key=lambda r: r[1])[2] if fits else None))
    return sorted(out, key=repr)


def found(spark, asked, log):
    got = as_of(spark.createDataFrame(asked, ASKED), spark.createDataFrame(log, LOG), "key", "time", "at", DAY)
    assert got.columns == ["id", "key", "time", "_t", "known"]
    return sorted(((r["id"], r["known"] and r["known"]["value"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_against_every_pair(spark, partitions):
    """Keys over many ranges, ranges without log rows, and one key with half of all rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        r = random.Random(int(partitions))
        key = lambda: r.choice(["hot", "hot", "a", "b", "c", "d", "é", None])
        asked = [(i, key(), moment(r.choice([None] + [r.uniform(0, 400)] * 9)), i) for i in range(600)]
        times = r.sample(range(4000), 250)
        log = [(key(), moment(None if n % 40 == 0 else t / 10), n, n) for n, t in enumerate(times)]
        log += [("hot", moment(1.0), 1000, 1)]  # and nothing more for a while
        log = [x for x in log if not (x[0] == "hot" and x[1] is not None and moment(1.0) < x[1] < moment(20))]
        assert found(spark, asked, log) == plain(asked, log)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_borders_ties_and_nothing(spark):
    log = [("k", moment(0), 1, 5), ("k", moment(10), 2, 6), ("k", moment(10), 2, 6), (None, moment(0), 9, 0)]
    asked = [(1, "k", moment(0), 0), (2, "k", moment(24), 0), (3, "k", moment(34), 0), (4, "k", moment(33.9), 0), (4, "k", moment(33.9), 0), (5, "k", moment(-1), 0), (6, None, moment(1), 0)]
    assert found(spark, asked, log) == plain(asked, log) == [(1, 1), (2, 2), (3, None), (4, 2), (4, 2), (5, None), (6, None)]
    assert found(spark, [], log) == [] and found(spark, asked[:1], []) == [(1, None)]


def test_equal_times_always_give_the_same_row(spark):
    log = [("k", moment(1), n, n) for n in range(30)]
    asked = [(i, "k", moment(2), 0) for i in range(5)]
    assert len({found(spark, asked, random.Random(n).sample(log, 30))[0][1] for n in range(3)}) == 1


def test_convert(spark):
    log = spark.createDataFrame([("USD", "eur", 0.5, moment(0)), ("USD", "EUR", 0.8, moment(5)), ("GBP", "EUR", 9.0, moment(6))], "base string, target string, rate double, updated_at timestamp_ntz")
    paid = spark.createDataFrame([(1, 10.0, "Eur", moment(1)), (2, 10.0, "EUR", moment(7)), (3, 10.0, "usd", moment(7)), (4, 10.0, "EUR", moment(40)), (5, None, "EUR", moment(7))], "id int, usd double, target string, at timestamp_ntz")
    got = price_convert_as_of(paid, log).selectExpr("id", "target", "cast(amount as double) amount")
    assert rows(got) == sorted([(1, "EUR", 5.0), (2, "EUR", 8.0), (3, "USD", 10.0), (4, "EUR", None), (5, "EUR", None)], key=repr)
