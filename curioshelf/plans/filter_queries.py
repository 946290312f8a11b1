"""Filters, composition and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from curioshelf.functions import predicates as P
from curioshelf.functions.colors import COLOR_WORDS, COMBINATIONS
from curioshelf.functions.compose import all_of, any_of, none_of, where
from curioshelf.operators import joins, searches
from curioshelf.operators.substring import add_grams, search_grams
from curioshelf.plans.registry import query
from curioshelf.plans.views import color_array
from curioshelf.session import scratch

W, U, B, R, G = 1, 2, 4, 8, 16


def _filter(key: str, predicate, condition: str) -> None:
    """A catalogue filter over all cards, giving the ids that pass."""

    @query(key, f"select id, name from cards where {condition}")
    def build(v):
        return where(v.cards, predicate()).select("id", "name")


def digits(field: str) -> str:
    return f"(CASE WHEN regexp_matches({field}, '^[0-9]+$') THEN CAST({field} AS INT) ELSE 0 END)"


def any_keyword(text: str) -> str:
    words = "select id from (select id, unnest(string_split(name, ' ')) word from cards) t"
    return f"id in ({words} where contains(lower(word), '{text}'))"


NOT_EXTRA = (
    "coalesce(layout not in ('battle', 'planar', 'scheme', 'vanguard', 'token', "
    "'double_faced_token', 'emblem'), true) and coalesce(type_line <> 'Card', true)"
)

_filter(
    "f_name",
    lambda: P.f_name("Brand#1"),
    "contains(lower(name), 'brand#1') or contains(lower(flavor_name), 'brand#1')",
)
_filter("f_flavor_name", lambda: P.f_flavor_name("RING"), "contains(lower(flavor_name), 'ring')")
_filter("f_type", lambda: P.f_type("Economy R"), "contains(lower(type_line), 'economy r')")
_filter("f_keyword", lambda: P.f_keyword("Ol"), any_keyword("ol"))
_filter("f_set", lambda: P.f_set("BRAND#7"), "set_code = 'brand#7'")
_filter("f_lang", lambda: P.f_lang("JA"), "lang = 'ja'")
_filter("f_layout", lambda: P.f_layout("Transform"), "layout = 'transform'")
_filter("f_mana_value", lambda: P.f_mana_value(">=", "5.9"), "cmc >= 5")
_filter("f_mana_value_not", lambda: P.f_mana_value("!=", 3), "cmc is distinct from 3")
_filter("f_mana_parity", lambda: P.f_mana_parity("odd"), "CAST(floor(cmc) AS BIGINT) % 2 = 1")
_filter("f_power", lambda: P.f_power("<=", 2), f"{digits('power')} <= 2")
_filter("f_power_not", lambda: P.f_power("!=", "7"), f"{digits('power')} <> 7")
_filter("f_toughness", lambda: P.f_toughness(">", " 4 "), f"{digits('toughness')} > 4")
_filter("f_loyalty", lambda: P.f_loyalty("=", 0), f"{digits('loyalty')} = 0")
_filter("f_stat_text", lambda: P.f_stat_text("power", "=", "1+*"), "power = '1+*'")
_filter("f_stat_text_not", lambda: P.f_power("!=", "*"), "power is distinct from '*'")
_filter("f_rarity", lambda: P.f_rarity("Rare"), "rarity = 'rare'")
_filter("f_rarity_range", lambda: P.f_rarity_range(">=", "uncommon"), "rarity in ('uncommon', 'rare', 'mythic')")
_filter("f_rarity_range_below", lambda: P.f_rarity_range("<", "rare"), "rarity in ('common', 'uncommon')")
_filter("f_exclude_extras", P.f_exclude_extras, NOT_EXTRA)
_filter("f_default_filters", P.f_default_filters, f"lang = 'en' and {NOT_EXTRA}")

for _kind, _mask, _subject in (("color", "color_mask", "colors"), ("identity", "identity_mask", "identity")):
    _less = "f_colorless" if _kind == "color" else "f_identity_colorless"
    _of = lambda name, kind=_kind: getattr(P, f"f_{kind}_{name}")
    _filter(f"f_{_kind}_contains", lambda f=_of("contains"): f("azorius"), f"({_mask} & {W | U}) = {W | U}")
    _filter(f"f_{_kind}_exact", lambda f=_of("exact"): f("ubr"), f"{_mask} = {U | B | R}")
    _filter(f"f_{_kind}_subset", lambda f=_of("subset"): f("jund"), f"({_mask} & {W | U}) = 0")
    _filter(_less, getattr(P, _less), f"{_mask} is null or {_mask} = 0")
    _filter(
        f"f_{_kind}_excludes",
        lambda f=_of("excludes"): f(["W", "G"]),
        f"coalesce(({_mask} & {W | G}) = 0, true)",
    )


@query("f_oracle", "select doc_id id, lang from documents where contains(lower(text), 'tion of')")
def f_oracle(v):
    cards = v.sql("select doc_id id, text oracle_text, lang from @documents")
    return where(cards, P.f_oracle("TION OF")).select("id", "lang")


@query("substring_index", "select doc_id id, lang from documents where contains(lower(text), 'tion of')")
def substring_index(v):
    """The same through the lists of three characters, filed in two batches."""
    cards = v.sql("select doc_id id, text oracle_text, lang from @documents")
    folder = scratch(v.spark)
    for part in ("lang = 'en'", "lang is distinct from 'en'"):
        add_grams(cards.filter(part), "oracle_text", folder, buckets=8)
    return search_grams(cards, "oracle_text", folder, "TION OF", buckets=8).select("id", "lang")


_WORDS = list(COLOR_WORDS)


@query(
    "color_names",
    f"""select p_partkey request_id, word, colors from part join
    (select unnest({_WORDS!r}) word, unnest({list(COLOR_WORDS.values())!r}) colors,
     generate_subscripts({_WORDS!r}, 1) - 1 place) t on p_partkey % {len(_WORDS)} = place""",
)
def color_names(v):
    """Colour words asked for by each part, resolved by a look-up table of fixed size."""
    words = F.array(*[F.lit(w) for w in _WORDS])
    asked = v.sql("select p_partkey request_id from @part").withColumn(
        "word", F.get(words, (F.col("request_id") % len(_WORDS)).cast("int"))
    )
    table = v.spark.createDataFrame(
        [(w, "".join(P.as_colors(w))) for w in _WORDS], "word string, colors string"
    )
    return asked.join(F.broadcast(table), "word")


# -- composition ------------------------------------------------------------------------------

_filter(
    "all_of",
    lambda: all_of(P.f_type("economy"), None, P.f_mana_value(">=", 3), P.f_power(">", "*")),
    "contains(lower(type_line), 'economy') and cmc >= 3",
)
_filter(
    "any_of",
    lambda: any_of(P.f_type("ring"), P.f_loyalty("<", "x"), P.f_set("brand#3")),
    "contains(lower(type_line), 'ring') or set_code = 'brand#3'",
)
_filter(
    "none_of",
    lambda: none_of(P.f_type("economy"), P.f_flavor_name("r")),
    "not coalesce(contains(lower(type_line), 'economy'), false) "
    "and not coalesce(contains(lower(flavor_name), 'r'), false)",
)
_filter(
    "nested_groups",
    lambda: all_of(
        P.f_color_contains("red"),
        any_of(P.f_type("ring"), all_of(P.f_type("bolt"), none_of(P.f_rarity("special")))),
    ),
    f"(color_mask & {R}) = {R} and (contains(lower(type_line), 'ring') "
    "or (contains(lower(type_line), 'bolt') and not (rarity = 'special')))",
)

_SEARCH = P.SearchFilters(
    name=" r ",
    lang="EN",
    layout="",
    keyword="  ",
    rarity="uncommon",
    rarity_op=">=",
    cmc="2",
    cmc_op=">",
    power="*",
    toughness="3",
    toughness_op=">=",
    colors=["U"],
    color_mode="does-not-contain",
    color_identity=["W", "R"],
    exclude_extras=True,
)
_filter(
    "search_filters",
    lambda: P.search_filters(_SEARCH),
    f"""(contains(lower(name), 'r') or contains(lower(flavor_name), 'r')) and lang = 'en'
    and rarity in ('uncommon', 'rare', 'mythic') and cmc > 2 and {digits('toughness')} >= 3
    and coalesce((color_mask & {U}) = 0, true) and (identity_mask & {W | R}) = {W | R}
    and {NOT_EXTRA}""",
)

_RARITY = "coalesce(list_position(['common', 'uncommon', 'rare', 'mythic'], rarity), 0) - 1"
_FLAGSHIP = (
    f"contains(lower(type_line), 'o') and (color_mask & {R}) = {R} and cmc >= 2 and "
    "id in (select card_id from copies where owner = 3)"
)


def flagship(v):
    """Red cards of some type and cost that an owner has, rarest first, second page."""
    pred = all_of(P.f_type("o"), P.f_color_contains("red"), P.f_mana_value(">=", 2))
    found = joins.search_catalog(
        v.cards, v.copies, pred, "rarity", "desc", page=2, page_len=25, owned=True, owner=3
    )
    return found.select("id", "name", "rarity", "cmc")


query(
    "search_catalog",
    f"""select id, name, rarity, cmc from cards where {_FLAGSHIP}
    order by {_RARITY} desc, id limit 25 offset 25""",
)(flagship)


@query("search_total", f"select count(*) total from cards where {_FLAGSHIP}")
def search_total(v):
    pred = all_of(P.f_type("o"), P.f_color_contains("red"), P.f_mana_value(">=", 2))
    return joins.search_total(v.cards, pred, v.copies, owner=3)


@query(
    "search_collection",
    """select copy_id, collection_id, card_id from copies where collection_id is not null
    and card_id in (select id from cards where rarity = 'mythic' and cmc > 4)""",
)
def search_collection(v):
    pred = all_of(P.f_rarity("mythic"), P.f_mana_value(">", 4))
    found = joins.search_collection(v.copies, v.cards, None, pred)
    return found.select("copy_id", "collection_id", "card_id")


_KEY = " || ".join(f"CASE WHEN (m & {1 << i}) > 0 THEN '{c}' ELSE '' END" for i, c in enumerate("WUBRG"))
_MATCH = f"""from saved_searches s join cards c on (s.lang is null or s.lang = c.lang)
 and (rarity_min is null or {_RARITY} >= rarity_min)
 and (cmc_min is null or cmc >= cmc_min) and (cmc_max is null or cmc <= cmc_max)
 and (must_mask is null or must_mask = 0 or (color_mask & must_mask) = must_mask)
 and (name_part is null or contains(lower(name), lower(name_part))
      or contains(lower(flavor_name), lower(name_part)))"""


@query("saved_search_match", f"select search_id, id card_id {_MATCH}")
def saved_search_match(v):
    return searches.saved_search_match(v.searches, v.cards)


@query(
    "saved_search_counts",
    f"""with hits as (select search_id, count(*) n {_MATCH} group by search_id)
    select s.search_id, coalesce(n, 0) total from saved_searches s
    left join hits on s.search_id = hits.search_id""",
)
def saved_search_counts(v):
    return searches.saved_search_counts(v.searches, v.cards)


# Searches over many fields; the comparison of power and the colour mode vary with the search.
_SEARCH_TABLE = """select s_suppkey search_id, CASE s_suppkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' END lang,
 CASE WHEN s_suppkey % 7 = 1 THEN 'Widget' END type_line, CASE WHEN s_suppkey % 5 = 1 THEN 'normal' END layout,
 CASE WHEN s_suppkey % 4 > 1 THEN 'rare' END rarity, CASE s_suppkey % 4 WHEN 2 THEN '>=' ELSE '<' END rarity_op,
 CASE s_suppkey % 6 WHEN 1 THEN 'even' WHEN 2 THEN '4' WHEN 3 THEN '4' END cmc,
 CASE s_suppkey % 6 WHEN 3 THEN '>' ELSE '<=' END cmc_op,
 CASE s_suppkey % 8 WHEN 1 THEN '3' WHEN 2 THEN '*' WHEN 3 THEN '0' END power,
 CASE s_suppkey % 8 WHEN 1 THEN '>' WHEN 2 THEN '!=' ELSE '=' END power_op,
 CASE WHEN s_suppkey % 9 > 3 THEN CAST(s_suppkey % 32 AS INT) END wanted,
 CASE s_suppkey % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'exactly' ELSE 'does-not-contain' END color_mode,
 s_suppkey % 2 = 0 exclude_extras from @supplier"""
_STAT = "CASE WHEN regexp_matches(power, '^[0-9]+$') THEN CAST(power AS INT) ELSE 0 END"


@query(
    "saved_search_fields",
    f"""select search_id, c.id card_id from ({_SEARCH_TABLE}) s join
    (select id, lang lang2, type_line type2, layout layout2, {_RARITY} rank, cmc cmc2, power power2, {_STAT} stat,
     color_mask mask from cards) c on (lang is null or lang = lang2)
    and (type_line is null or contains(lower(type2), lower(type_line))) and (layout is null or layout = layout2)
    and (rarity is null or (rarity_op = '>=' and rank >= 2) or (rarity_op = '<' and rank between 0 and 1))
    and (s.cmc is null or (s.cmc = 'even' and CAST(trunc(cmc2) AS BIGINT) % 2 = 0)
      or (s.cmc = '4' and ((cmc_op = '>' and cmc2 > 4) or (cmc_op = '<=' and cmc2 <= 4))))
    and (s.power is null or (s.power = '3' and stat > 3) or (s.power = '*' and power2 is distinct from '*')
      or (s.power = '0' and stat = 0))
    and (coalesce(wanted, 0) = 0 or (color_mode = 'contains' and (mask & wanted) = wanted)
      or (color_mode = 'exactly' and mask = wanted) or (color_mode = 'does-not-contain' and coalesce(mask & wanted, 0) = 0))
    and (not exclude_extras or ((layout2 is null or layout2 not in {tuple(P.EXTRA_LAYOUTS)}) and (type2 is null or type2 <> 'Card')))""",
)
def saved_search_fields(v):
    table = v.sql(_SEARCH_TABLE).withColumn("colors", color_array("wanted")).drop("wanted")
    return searches.search_table_match(table, v.cards)


def color_place(mask: str) -> str:
    """Zero-based place of a colour mask among the combinations, in the oracle's SQL."""
    key = _KEY.replace("m &", f"coalesce({mask}, 0) &")
    return f"(CAST(list_position({COMBINATIONS!r}, {key}) AS INT) - 1)"
