from pathlib import Path

from curioshelf import session
from curioshelf.plans import join_queries  # noqa: F401  (registers the queries)
from curioshelf.plans.registry import QUERIES


def test_scratch_folders_are_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    tables = [session.kept(spark.range(5)) for _ in range(3)]
    folders = [Path(p) for p in session._made]
    assert all(t.count() == 5 for t in tables) and all(f.is_dir() for f in folders)
    assert session.release(spark) == 3 and not any(f.exists() for f in folders)
    assert session.release(spark) == 0


def test_registered_queries_tune_the_session(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    spark.conf.set(key, "false")
    QUERIES["owned_cards"](spark, "/root/testdata/sf0.001").schema
    assert spark.conf.get(key) == "true"


def test_a_tuned_session_starts_with_many_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(key)
    session.tune(spark)
    assert int(spark.conf.get(key)) >= 200 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Small tables are few tasks all the same.
    assert spark.range(1000).repartition("id").rdd.getNumPartitions() < 10


def test_broadcasts_fit_in_the_driver(spark):
    """Four tables of the size, at six times the bytes measured each, leave a quarter of the heap."""
    for heap in (750 << 20, 2 << 30, 64 << 30):
        assert 4 * 6 * session.broadcast_size(heap) <= 0.75 * heap
    session.tune(spark)
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(session.broadcast_size(heap))
