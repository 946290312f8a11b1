"""The substring index against a look at every row."""

import re
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from curioshelf.functions.predicates import has_text
from curioshelf.operators.substring import add_grams, grams, rarest_grams, search_grams

TEXTS = [
    "Draw a card.", "DRAW two cards, then discard", "", None, "ab", "a.b*c%d_e", "Jötunn Grünt — Élan", "日本語の札", "😀😀 smile 😀x",
    "aaaaaaaaaa", "İstanbul", "ΣΑΣ", "{T}: Add {G}", "line\nbreak\\n", "a_b", "draw a card.", "cards cards cards",
]
NEEDLES = ["card", "CARDS", "draw a card.", "b*c", "%d_", "grün", "élan", "日本語", "本語の札", "😀😀 ", "smile", "aaa", "zzz", "{g}", "break\\n", "k\nb", "a", "", "_", "日", "σας", "istanbul", "then discard"]


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, oracle_text string")
    folder = str(tmp_path_factory.mktemp("grams") / "index")
    add_grams(table.filter("id < 8"), "oracle_text", folder, 4)
    add_grams(table.filter("id >= 8"), "oracle_text", folder, 4)
    return table, folder


@pytest.mark.parametrize("text", NEEDLES)
def test_equal_to_contains(filed, text):
    table, folder = filed
    got = search_grams(table, "oracle_text", folder, text, 4)
    assert rows(got) == rows(table.filter(has_text(F.col("oracle_text"), text)))


def test_grams_are_runs_of_three_characters(filed):
    want = set()
    for id_, low in filed[0].select("id", F.lower("oracle_text")).collect():
        want |= {(low[k : k + 3], id_) for k in range(len(low or "") - 2)}
    got = [tuple(r) for r in grams(filed[0], "oracle_text").collect()]
    assert len(got) == len(want) and set(got) == want


def test_changed_and_deleted_rows(spark, filed, tmp_path):
    folder = str(tmp_path / "index")
    old = spark.createDataFrame([(1, "a goblin"), (2, "an elf"), (3, "goblin king")], "id bigint, oracle_text string")
    add_grams(old, "oracle_text", folder, 4)
    new = spark.createDataFrame([(1, "an elf now"), (4, "goblin four")], "id bigint, oracle_text string")
    add_grams(new, "oracle_text", folder, 4)
    table = old.filter("id = 2").unionByName(new)
    assert rows(search_grams(table, "oracle_text", folder, "goblin", 4), "id") == [(4,)]
    assert rows(search_grams(table, "oracle_text", folder, "an elf", 4), "id") == [(1,), (2,)]


def test_only_lists_of_rare_grams_are_read(spark, filed):
    table, folder = filed
    assert rarest_grams(spark, folder, "discard zzz", 4)[0][2] == 0 and len(rarest_grams(spark, folder, "discard zzz", 4)) == 1
    found = rarest_grams(spark, folder, "then discard", 4)
    assert len(found) == 3 and [n for *_, n in found] == sorted(n for *_, n in found)
    plan = search_grams(table, "oracle_text", folder, "then discard", 4)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*", plan)
    assert len(scans) == 3 and all("PartitionFilters: [isnotnull(bucket" in s and "EqualTo(gram," in s for s in scans)


def test_a_gram_of_every_row_and_a_long_text(spark, tmp_path):
    folder = str(tmp_path / "index")
    many = spark.range(3000).select("id", F.concat(F.lit("the "), F.col("id").cast("string"), F.lit(" end")).alias("oracle_text"))
    table = many.unionByName(spark.createDataFrame([(10**6, "xy" * 500_000 + "needle")], "id bigint, oracle_text string"))
    start = time.time()
    add_grams(table, "oracle_text", folder, 4)
    assert time.time() - start < 60
    assert rows(search_grams(table, "oracle_text", folder, "THE 2999 ", 4), "id") == [(2999,)]
    assert rows(search_grams(table, "oracle_text", folder, "yneedle", 4), "id") == [(10**6,)]
    assert search_grams(table, "oracle_text", folder, "the ", 4).count() == 3000


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "id bigint, oracle_text string")
    add_grams(table, "oracle_text", str(tmp_path / "index"), 4)
    assert search_grams(table, "oracle_text", str(tmp_path / "index"), "abc", 4).count() == 0


def test_texts_are_cut_once(spark, tmp_path):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        cut.add(1)
        return text

    some = spark.range(20).select("id", F.format_string("text %d 𝒳𝒴 end", "id").alias("t"))
    table = some.select("id", seen("t").alias("oracle_text"))
    add_grams(table, "oracle_text", str(tmp_path / "index"), 4)
    assert cut.value == 20
    found = search_grams(some.withColumnRenamed("t", "oracle_text"), "oracle_text", str(tmp_path / "index"), "𝒳𝒴 ", 4)
    assert sorted(r.id for r in found.collect()) == list(range(20))
    assert grams(spark.createDataFrame([(1, "a𝒳b𝒴")], "id bigint, t string"), "t").count() == 2
