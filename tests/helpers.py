"""Small frames in the shape of the reference data."""

CARD_SCHEMA = (
    "id string, name string, flavor_name string, type_line string, oracle_text string, `set` string,"
    " lang string, layout string, cmc double, power string, toughness string, loyalty string,"
    " rarity string, colors array<string>, color_identity array<string>, keywords array<string>,"
    " collector_number string, mana_cost string"
)
DEFAULTS = {
    "id": "c1",
    "name": "Test Card",
    "flavor_name": None,
    "type_line": "Creature — Goblin",
    "oracle_text": "Haste",
    "set": "tst",
    "lang": "en",
    "layout": "normal",
    "cmc": 3.0,
    "power": "2",
    "toughness": "2",
    "loyalty": None,
    "rarity": "common",
    "colors": ["R"],
    "color_identity": ["R"],
    "keywords": [],
    "collector_number": "1",
    "mana_cost": "{2}{R}",
}
FIELDS = list(DEFAULTS)


def cards_of(spark, *rows):
    data = [tuple({**DEFAULTS, "id": f"c{i}", **row}[f] for f in FIELDS) for i, row in enumerate(rows, 1)]
    return spark.createDataFrame(data, CARD_SCHEMA)


COPY_SCHEMA = (
    "copy_id string, owner string, card_id string, collection_id string, deck_id string,"
    " notes string, tags array<string>"
)


def copies_of(spark, *rows):
    base = {"owner": "u", "card_id": "c1", "collection_id": "k1", "deck_id": None, "notes": None, "tags": None}
    names = ["copy_id", *base]
    data = [tuple({**base, "copy_id": f"p{i}", **row}[n] for n in names) for i, row in enumerate(rows, 1)]
    return spark.createDataFrame(data, COPY_SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def column(df, name="id"):
    return [r[0] for r in df.select(name).collect()]
