import pytest
from pyspark.sql import functions as F

from curioshelf.functions import predicates as P
from curioshelf.functions.colors import COMBINATIONS, color_names
from curioshelf.functions.compose import all_of, any_of, none_of, where
from tests.helpers import cards_of, column


@pytest.fixture(scope="module")
def cards(spark):
    return cards_of(
        spark,
        {"name": "Shivan Dragon", "type_line": "Creature — Dragon", "power": "5", "rarity": "rare", "cmc": 6.0},
        {"name": "Goblin Guide", "flavor_name": "a.b", "colors": ["R", "W"], "power": "*", "cmc": 0.5},
        {"name": "Élan", "type_line": None, "colors": None, "power": None, "rarity": "special", "layout": None},
        {"name": "axb", "type_line": "Card", "colors": [], "power": "1+*", "cmc": 4.0, "lang": "ja"},
        {"name": "Ring", "type_line": "Token", "colors": ["U"], "power": "99999999999", "layout": "token",
         "keywords": ["First strike", "Haste"], "rarity": "mythic", "cmc": None},
    )


def ids(cards, pred):
    return sorted(column(where(cards, pred)))


ALL = ["c1", "c2", "c3", "c4", "c5"]


@pytest.mark.parametrize(
    "pred, expected",
    [
        (lambda: P.f_name("DRAGON"), ["c1"]),
        (lambda: P.f_name("a.b"), ["c2"]),
        (lambda: P.f_name("elan"), []),
        (lambda: P.f_name("éLAN"), ["c3"]),
        (lambda: P.f_type("creature — d"), ["c1"]),
        (lambda: P.f_keyword("strike"), ["c5"]),
        (lambda: P.f_keyword("strike haste"), []),
        (lambda: P.f_set("TST"), ALL),
        (lambda: P.f_mana_value(None, "6"), ["c1"]),
        (lambda: P.f_mana_value("<", "4.9"), ["c2", "c3"]),
        (lambda: P.f_mana_value("!=", 6), ["c2", "c3", "c4", "c5"]),
        (lambda: P.f_mana_value("<", "x"), []),
        (lambda: P.f_mana_value("!=", "x"), ALL),
        (lambda: P.f_mana_value("=", "even"), ["c1", "c2", "c4"]),
        (lambda: P.f_mana_parity("odd"), ["c3"]),
        (lambda: P.f_power("=", 0), ["c2", "c3", "c4", "c5"]),
        (lambda: P.f_power(">=", "5"), ["c1"]),
        (lambda: P.f_power("!=", 5), ["c2", "c3", "c4", "c5"]),
        (lambda: P.f_power("=", "*"), ["c2"]),
        (lambda: P.f_power("!=", "*"), ["c1", "c3", "c4", "c5"]),
        (lambda: P.f_power(">", "*"), ALL),
        (lambda: P.f_power(None, "*"), ALL),
        (lambda: P.f_rarity("RARE"), ["c1"]),
        (lambda: P.f_rarity_range(">=", "rare"), ["c1", "c5"]),
        (lambda: P.f_rarity_range(">", "mythic"), []),
        (lambda: P.f_rarity_range("<=", "special"), ["c3"]),
        (lambda: P.f_color_contains("red"), ["c1", "c2"]),
        (lambda: P.f_color_contains("boros"), ["c2"]),
        (lambda: P.f_color_contains("c"), ["c3", "c4"]),
        (lambda: P.f_color_exact("r"), ["c1"]),
        (lambda: P.f_color_subset("rg"), ["c1", "c4"]),
        (lambda: P.f_colorless(), ["c3", "c4"]),
        (lambda: P.f_color_excludes(["W", "U"]), ["c1", "c3", "c4"]),
        (lambda: P.f_exclude_extras(), ["c1", "c2", "c3"]),
        (lambda: P.f_default_filters(), ["c1", "c2", "c3"]),
    ],
)
def test_filter(cards, pred, expected):
    assert ids(cards, pred()) == expected


def test_composition_drops_missing_constraints(cards):
    assert ids(cards, all_of(None, None)) == ALL
    assert any_of(None, None) is None
    assert ids(cards, any_of(P.f_type("dragon"), None)) == ["c1"]
    assert ids(cards, any_of(P.f_type("dragon"), all_of())) == ALL
    assert none_of(None) is None
    assert ids(cards, none_of(P.f_type("creature"))) == ["c3", "c4", "c5"]
    nested = all_of(any_of(P.f_type("dragon"), P.f_type("goblin")), none_of(P.f_power(">", 4)))
    assert ids(cards, nested) == ["c2"]


@pytest.mark.parametrize(
    "pred",
    [
        lambda: P.f_name("r"),
        lambda: P.f_power("<=", 2),
        lambda: P.f_color_subset("wu"),
        lambda: P.f_mana_value(">=", 4),
        lambda: P.f_exclude_extras(),
        lambda: P.f_rarity("rare"),
    ],
)
def test_a_filter_and_its_negation_partition_the_table(cards, pred):
    assert sorted(ids(cards, pred()) + ids(cards, none_of(pred()))) == ALL


def test_search_filters(cards):
    assert ids(cards, P.search_filters(P.SearchFilters())) == ALL
    assert ids(cards, P.search_filters(P.SearchFilters(name="  ", power="*"))) == ALL
    assert ids(cards, P.search_filters(P.SearchFilters(power="*", power_op=">="))) == ALL
    search = P.SearchFilters(
        cmc="1", cmc_op=">", colors=["W"], color_mode="does-not-contain", exclude_extras=True
    )
    assert ids(cards, P.search_filters(search)) == ["c1", "c3"]
    exact = P.SearchFilters(colors=["W", "R"], color_mode="exactly")
    assert ids(cards, P.search_filters(exact)) == ["c2"]


def test_color_names():
    assert color_names("red") == ["R"]
    assert color_names("URu") == ["U", "R"]
    assert set(color_names("Temur")) == {"G", "U", "R"}
    assert color_names("colorless") == []
    for unknown in ("purple", "xyz", ""):
        with pytest.raises(ValueError):
            color_names(unknown)


def test_color_combinations():
    assert len(COMBINATIONS) == 32
    assert COMBINATIONS[:7] == ["W", "U", "B", "R", "G", "WU", "WB"]
    assert COMBINATIONS[-2:] == ["WUBRG", ""]


def test_unknown_operators_are_refused():
    for call in (
        lambda: P.f_mana_value("~", 1),
        lambda: P.f_rarity_range("=", "rare"),
        lambda: P.f_stat_text("power", ">", "*"),
    ):
        with pytest.raises(ValueError):
            call()


def test_bare_comparisons_reach_the_scan(spark, cards, tmp_path):
    cards.write.parquet(str(tmp_path / "cards"))
    stored = spark.read.parquet(str(tmp_path / "cards"))
    pred = all_of(P.f_lang("en"), P.f_mana_value(">", 2), P.f_exclude_extras())
    plan = stored.filter(pred).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(cmc,2.0)" in plan
    assert "oracle_text" not in plan


def test_two_valued_projection(cards):
    from curioshelf.functions.compose import two_valued

    flags = cards.select(two_valued(P.f_type("creature")).alias("t"))
    assert flags.filter(F.col("t").isNull()).count() == 0
