"""What is stored for a query, and how."""

import shutil

import pytest

from curioshelf.plans import join_queries, maintenance_queries  # noqa: F401  (registers the queries)
from curioshelf.plans.registry import QUERIES
from curioshelf.plans.views import VIEWS, Views, with_views

SOURCE = "/root/testdata/sf0.001"


def _fresh(spark, tmp_path):
    """Views over a folder of its own, of which nothing is stored yet."""
    return Views(spark, shutil.copytree(SOURCE, tmp_path / "tables").as_posix())


def _stored(v):
    return {name for _, folder, name in Views._stored if folder == v.sf_dir}


def test_layout_is_made_without_storing_copies(spark, tmp_path):
    v = _fresh(spark, tmp_path)
    first = {tuple(r) for r in v.layout.collect()}
    assert _stored(v) == {"layout"}
    assert v.copies.count() > 0 and v.placements.count() > 0
    again = {tuple(r) for r in v._make("layout").collect()}
    assert _stored(v) == {"layout", "copies", "placements"} and first == again


def test_line_items_are_dealt_out_once(spark, tmp_path):
    v = _fresh(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = v._make("copies")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    # The join with the line items is the outer one.
    assert "l_orderkey" in joins[0] and "c_custkey" in joins[1]


@pytest.mark.parametrize("key", ["section_delete_empty", "deck_assemble", "deck_replay", "copies_create_placements"])
def test_what_a_query_reads_is_made_of_each_other(spark, tmp_path, monkeypatch, key):
    v = _fresh(spark, tmp_path)
    texts = {}
    run = Views._run
    monkeypatch.setattr(Views, "_run", lambda self, text: texts.setdefault(text, run(self, text)))
    QUERIES[key](spark, v.sf_dir)
    assert sum("@lineitem" in text for text in texts) == 1
    stored = [name for _, folder, name in Views._stored if folder == v.sf_dir and name in ("copies", "placements", "layout")]
    assert stored[-2:] == ["placements", "layout"]


@pytest.mark.parametrize(("key", "tables"), [("collection_value", {"price_cache"}), ("collection_value_in", {"price_cache", "fx_rates"})])
def test_values_are_summed_without_a_table_of_copies(spark, tmp_path, key, tables):
    v = _fresh(spark, tmp_path)
    got = QUERIES[key](spark, v.sf_dir)
    assert _stored(v) == tables
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # No counts per owner and card, no sorting of line items, none of their other columns.
    assert not any("Aggregate" in line and "card_id#" in line.split("]")[0] for line in plan.splitlines())
    assert "strategy=shuffle_hash" in plan and not any("Project" in line and "l_quantity" in line for line in plan.splitlines())
    first = {tuple(r) for r in got.collect()}
    assert v.copies.count() > 0
    assert first == {tuple(r) for r in QUERIES[key](spark, v.sf_dir).collect()} and first


def test_newest_price_and_rate_of_a_log_with_gaps(spark, tmp_path):
    v = _fresh(spark, tmp_path)
    log = """select user_id, event_type, value, ts from values (1, 'buy', 1.5D, TIMESTAMP_NTZ '2024-01-30 10:00:00'),
      (1, 'error', 9D, TIMESTAMP_NTZ '2024-01-30 12:00:00'), (1, 'buy', 7D, NULL), (2, 'buy', 2.5D, NULL),
      (3, 'buy', NULL, TIMESTAMP_NTZ '2024-01-30 12:00:00'), (NULL, 'buy', 4D, TIMESTAMP_NTZ '2024-01-30 12:00:00'),
      (NULL, 'buy', 5D, TIMESTAMP_NTZ '2024-01-30 13:00:00'), (20, 'buy', 6D, TIMESTAMP_NTZ '2024-01-30 13:00:00')
      t(user_id, event_type, value, ts)"""
    for name in ("price_cache", "fx_rates"):
        found = []
        for text in (with_views(f"select * from {name}", v._definitions()), with_views(f"select * from {name}", VIEWS)):
            found.append(spark.sql(text.replace("@events", f"({log}) e")))
        assert found[0].dtypes == found[1].dtypes
        assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
        ranked = found[0]._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in ranked
