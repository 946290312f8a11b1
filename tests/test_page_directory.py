"""Stored pages against sorting everything."""

import random

import pytest
from helpers import cards_of
from pyspark.sql import functions as F

from curioshelf.operators import page_directory as directory
from curioshelf.operators.paging import page
from curioshelf.sources.ingest import catalog_current


def made(spark, n, seed, base=0):
    r = random.Random(seed)
    some = [{"id": f"x{base + k:04}", "name": r.choice([None, "Elf", "Goblin", "Ünal", f"n{r.randrange(9)}"]), "cmc": r.choice([0.0, 1.5, float("nan"), None, 4.0])} for k in range(n)]
    return cards_of(spark, *some).select("id", "name", "cmc")


def same_pages(spark, path, table, order, direction, page_len, numbers):
    for number in numbers:
        got = [tuple(r) for r in directory.stored_page(spark, path, number, page_len).select("id").collect()]
        assert got == [tuple(r) for r in page(table, order, direction, number, page_len).select("id").collect()], number


@pytest.mark.parametrize("order,direction", [("name", "asc"), ("cmc", "desc")])
def test_pages_after_changes(spark, tmp_path, order, direction):
    path, table = str(tmp_path / "pages"), made(spark, 230, 1)
    directory.write_directory(table, path, order, direction, range_rows=20)
    same_pages(spark, path, table, order, direction, 30, [1, 3, 8, 9])
    gone = table.filter("id like '%7' or id = 'x0003'")
    after = made(spark, 40, 2, 500).unionByName(gone.filter("id like '%07'").withColumn("name", F.lit("Elf")).withColumn("cmc", F.lit(9.0)))
    directory.update_directory(spark, path, gone, after, order, direction, range_rows=20)
    table = table.join(gone, "id", "left_anti").unionByName(after)
    same_pages(spark, path, table, order, direction, 30, [1, 4, 8])
    info = directory.stored_page_info(spark, path, 2, 30).first()
    assert info["total"] == table.count() and info["total_pages"] == -(-table.count() // 30) and info["has_more"]
    assert catalog_current(spark, f"{path}/directory").agg(F.max("n")).first()[0] <= 20


def test_only_ranges_with_changes_are_written(spark, tmp_path):
    path = str(tmp_path / "pages")
    table = spark.range(1000).select(F.format_string("c%05d", "id").alias("id"), F.format_string("n%05d", "id").alias("name"))
    directory.write_directory(table, path, range_rows=50)
    old = {(r["folder"], r["range"]) for r in catalog_current(spark, f"{path}/directory").collect()}
    new = spark.createDataFrame([("c90000", "n00510b"), ("c90001", "a first")], "id string, name string")
    assert directory.update_directory(spark, path, table.filter("id = 'c00777'"), new, range_rows=50) == 3
    now = {(r["folder"], r["range"]) for r in catalog_current(spark, f"{path}/directory").collect()}
    assert len(old) == 20 and len(old & now) == 17
    assert directory.stored_page(spark, path, 1, 2).select("id").collect()[0][0] == "c90001"


def test_a_page_reads_its_ranges_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(directory, "SHELF", 3)
    path = str(tmp_path / "pages")
    table = spark.range(1000).select(F.format_string("c%05d", "id").alias("id"), F.lit("same").alias("name"))
    directory.write_directory(table, path, range_rows=50)
    found = directory.stored_page(spark, path, 15, 50)
    assert len(directory.page_ranges(spark, path, 15, 50)) == 1 and len(found.inputFiles()) == 1
    assert len(directory.page_ranges(spark, path, 8, 60)) == 2
    assert [r["row_no"] for r in found.collect()] == list(range(701, 751))
    same_pages(spark, path, table, "name", "asc", 60, [1, 8, 17, 18])
    with pytest.raises(ValueError):
        directory.stored_page(spark, path, 0)


def test_empty_directory_and_emptied_one(spark, tmp_path):
    path, table = str(tmp_path / "pages"), made(spark, 30, 4)
    directory.write_directory(table.limit(0), path, range_rows=8)
    assert directory.stored_page(spark, path).count() == 0
    assert directory.stored_page_info(spark, path).first()["total"] == 0
    directory.update_directory(spark, path, table.limit(0), table, range_rows=8)
    same_pages(spark, path, table, "name", "asc", 7, [1, 5])
    directory.update_directory(spark, path, table, table.limit(0), range_rows=8)
    assert directory.stored_page(spark, path).count() == 0


def test_small_ranges_share_files(spark, tmp_path):
    path = str(tmp_path / "pages")
    table = spark.range(1000).select(F.format_string("c%05d", "id").alias("id"), F.lit("same").alias("name"))
    directory.write_directory(table, path, range_rows=10)
    assert catalog_current(spark, f"{path}/directory").count() == 100
    assert len(list((tmp_path / "pages").glob("rows-*/**/*.parquet"))) == 1
