from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curioshelf.operators import prices, text
from tests.helpers import cards_of, column, rows

NOW = "2024-05-10 12:00:00"
AT = datetime(2024, 5, 10, 12)
CACHE = "card_id string, usd string, updated_at timestamp_ntz"


def cache_of(spark, *entries):
    """(card, price, age in hours or None)."""
    data = [(c, p, None if h is None else AT - timedelta(hours=h)) for c, p, h in entries]
    return spark.createDataFrame(data, CACHE)


def ids_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "card_id string")


def test_fresh_and_stale(spark):
    cache = cache_of(spark, ("a", "1.00", 1), ("b", "2.00", 48), ("c", "3.00", 24), ("d", "4.00", None), ("z", "9.00", 1))
    ids = ids_of(spark, "a", "a", "b", "c", "d", "e")
    assert rows(prices.price_fresh(ids, cache, NOW), "card_id", "usd") == [("a", "1.00")]
    assert sorted(column(prices.price_stale(ids, cache, NOW), "card_id")) == ["b", "c", "d", "e"]
    assert rows(prices.price_resolve(ids, cache, NOW), "card_id", "usd") == [
        ("a", "1.00"), ("b", None), ("c", None), ("d", None), ("e", None)
    ]


def test_upsert_keeps_the_last_write(spark):
    cache = cache_of(spark, ("a", "1.00", 5), ("b", "1.50", 5))
    updates = cache_of(spark, ("a", "2.00", 3), ("a", "3.00", 2), ("c", "4.00", 9))
    got = prices.price_upsert(cache, updates)
    assert rows(got, "card_id", "usd") == [("a", "3.00"), ("b", "1.50"), ("c", "4.00")]


def test_extract_defaults_missing_prices(spark):
    fields = ", ".join(f"{f}: string" for f in prices.PRICE_FIELDS)
    raw = spark.createDataFrame(
        [("a", ("1.25", None, None, "1.10", None, None)), ("b", None)], f"id string, prices struct<{fields}>"
    )
    got = prices.price_extract(raw)
    assert rows(got, "card_id", "prices.usd", "prices.eur", "prices.tix") == [
        ("a", "1.25", "1.10", None), ("b", None, None, None)
    ]


def test_batches(spark):
    ids = spark.range(160).select(F.format_string("c%03d", "id").alias("card_id"))
    sizes = prices.price_batches(ids.unionByName(ids)).groupBy("batch").count()
    assert rows(sizes) == [(0, 75), (1, 75), (2, 10)]


def test_exchange_rates(spark):
    rates = spark.createDataFrame(
        [("USD", "NZD", 1.63, AT - timedelta(hours=1)), ("USD", "EUR", 0.92, AT - timedelta(hours=48))],
        "base string, target string, rate double, updated_at timestamp_ntz",
    )
    asked = spark.createDataFrame([("USD",), ("nzd",), ("EUR",), ("XX",), ("U5D",), (None,)], "target string")
    got = prices.fx_resolve(asked, rates, NOW)
    assert rows(got, "target", "rate", "status") == sorted(
        [
            ("USD", 1.0, "ok"),
            ("NZD", 1.63, "ok"),
            ("EUR", None, "unknown"),
            ("XX", None, "malformed"),
            ("U5D", None, "malformed"),
            (None, None, "malformed"),
        ],
        key=repr,
    )
    assert sorted(column(prices.fx_valid_codes(asked, "target"), "target")) == ["EUR", "NZD", "USD"]


def test_convert_rounds_half_up(spark):
    amounts = spark.createDataFrame([("2.50", "NZD"), ("0.10", "NZD"), ("1.00", "ZZZ")], "usd string, target string")
    amounts = amounts.union(spark.createDataFrame([("3.00", "usd"), ("4.00", "nzd"), ("5.00", "EUR")], "usd string, target string"))
    rates = spark.createDataFrame([("USD", "NZD", 1.05, 1), ("USD", "EUR", 0.9, 48)], "base string, target string, rate double, h int")
    rates = rates.selectExpr("base", "target", "rate", f"timestamp_ntz'{NOW}' - make_interval(0, 0, 0, 0, h) as updated_at")
    got = prices.price_convert(amounts, rates, NOW)
    assert [(str(u), str(a)) for u, a in rows(got, "usd", "amount")] == [
        ("0.10", "0.11"), ("1.00", "None"), ("2.50", "2.63"), ("3.00", "3.00"), ("4.00", "4.20"), ("5.00", "None")
    ]


def test_collection_value(spark):
    copies = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "x")], "owner string, card_id string")
    got = prices.collection_value(copies, cache_of(spark, ("a", "1.10", 1), ("b", "2.05", 1)))
    assert [(o, str(v), n, p) for o, v, n, p in rows(got, "owner", "value", "copies", "priced")] == [
        ("u", "4.25", 3, 3), ("v", "0.00", 1, 0)
    ]


LINES = {
    "I, II — Draw a card.": "saga",
    "III - {W}: Gain 1 life.": "saga",
    "+2: Draw a card.": "loyalty",
    "−3: Destroy target.": "loyalty",
    "0: Nothing.": "loyalty",
    "X: Something.": "loyalty",
    "X — Something.": "saga",
    "Haste": "plain",
    "+2:no blank": "plain",
}


def rules(spark):
    return cards_of(spark, {"oracle_text": "\n".join([*LINES, "", "   "])}, {"oracle_text": ""}, {"oracle_text": None})


def test_rules_lines(spark):
    got = text.rules_lines(rules(spark))
    assert {r.line: r.kind for r in got.collect()} == LINES
    assert rows(got.filter("line = 'Haste'"), "id", "line_no") == [("c1", 7)]


def test_saga_chapters(spark):
    got = text.saga_chapters(text.rules_lines(rules(spark)))
    assert rows(got, "line_no", "chapter", "ability") == [
        (0, 1, "Draw a card."), (0, 2, "Draw a card."), (1, 3, "{W}: Gain 1 life."), (6, 10, "Something.")
    ]


def test_loyalty_costs(spark):
    got = text.loyalty_costs(text.rules_lines(rules(spark)))
    assert rows(got, "cost", "direction", "size") == [
        ("+2", "up", "2"), ("0", "zero", "0"), ("X", "up", "x"), ("−3", "down", "3")
    ]


def test_symbols(spark):
    cards = cards_of(
        spark,
        {"mana_cost": "{2}{U}{U}", "oracle_text": "{T}: Add {W/U}. ({T} taps.)"},
        {"mana_cost": None, "oracle_text": "none {} here"},
        {"mana_cost": "{U}"},
    )
    assert rows(text.mana_symbols(cards)) == [("2", 1), ("U", 3)]
    assert rows(text.text_symbols(cards)) == [("T", 2), ("W/U", 1)]
    assert rows(text.reminder_text(cards)) == [("c1", 0, "({T} taps.)")]


def test_faces(spark):
    face = ", ".join(f"{f}: string" for f in text.FACE_FIELDS)
    cards = cards_of(spark, {"name": "One"}, {"name": "Two"}, {"name": "None"})
    two = f"from_json('[{{\"name\": \"Front\"}}, {{\"name\": \"Back\", \"power\": \"3\"}}]', 'array<struct<{face}>>')"
    faces = F.expr(f"case id when 'c2' then {two} when 'c3' then cast(array() as array<struct<{face}>>) end")
    got = text.card_faces(cards.withColumn("card_faces", faces))
    assert rows(got, "id", "face_no", "name", "power") == [
        ("c1", 0, "One", "2"), ("c2", 0, "Front", None), ("c2", 1, "Back", "3"), ("c3", 0, "None", "2")
    ]
