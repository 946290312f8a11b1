"""The catalogue schema and the fields a card cannot do without."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Field names of a catalogue record, in groups, and the required ones.
IMAGE_URIS = _struct(
    dict.fromkeys(["png", "border_crop", "art_crop", "large", "normal", "small"], STRING)
)
RELATED_PART = _struct(dict.fromkeys(["id", "component", "name", "type_line", "uri"], STRING))
FACE = _struct(
    {
        "layout": STRING,
        "oracle_id": STRING,
        "cmc": T.DoubleType(),
        "color_indicator": STRINGS,
        "colors": STRINGS,
        "loyalty": STRING,
        "mana_cost": STRING,
        "name": STRING,
        "oracle_text": STRING,
        "power": STRING,
        "toughness": STRING,
        "type_line": STRING,
        "flavor_text": STRING,
        "image_uris": IMAGE_URIS,
    }
)
CARD = _struct(
    {
        "id": STRING,
        "lang": STRING,
        "tcgplayer_id": T.DoubleType(),
        "layout": STRING,
        "oracle_id": STRING,
        "all_parts": T.ArrayType(RELATED_PART),
        "card_faces": T.ArrayType(FACE),
        "cmc": T.DoubleType(),
        "colors": STRINGS,
        "color_indicator": STRINGS,
        "color_identity": STRINGS,
        "keywords": STRINGS,
        "loyalty": STRING,
        "mana_cost": STRING,
        "name": STRING,
        "oracle_text": STRING,
        "power": STRING,
        "produced_mana": STRINGS,
        "toughness": STRING,
        "type_line": STRING,
        "attraction_lights": STRINGS,
        "border_color": STRING,
        "collector_number": STRING,
        "finishes": STRINGS,
        "flavor_name": STRING,
        "flavor_text": STRING,
        "illustration_id": STRING,
        "image_status": STRING,
        "image_uris": IMAGE_URIS,
        "rarity": STRING,
        "set_name": STRING,
        "set": STRING,
    }
)
REQUIRED = [
    "id",
    "lang",
    "layout",
    "cmc",
    "name",
    "type_line",
    "border_color",
    "collector_number",
    "image_status",
    "rarity",
    "set_name",
    "set",
]
REQUIRED_IN_PART = ["id", "component", "name", "type_line", "uri"]
REQUIRED_IN_FACE = ["name"]

# The other tables, in the column names that the operators use.
COPY = _struct(
    {
        "copy_id": STRING,
        "owner": STRING,
        "card_id": STRING,
        "collection_id": STRING,
        "deck_id": STRING,
        "notes": STRING,
        "tags": STRINGS,
        "created_at": T.TimestampType(),
        "updated_at": T.TimestampType(),
    }
)
COLLECTION = _struct(
    {
        "id": STRING,
        "name": STRING,
        "description": STRING,
        "is_active": T.BooleanType(),
        "owner": STRING,
        "updated_at": T.TimestampType(),
    }
)
DECK_COLUMN = _struct({"id": STRING, "cards": STRINGS})
DECK_SECTION = _struct({"id": STRING, "name": STRING, "columns": T.ArrayType(DECK_COLUMN)})
DECK = T.StructType(COLLECTION.fields).add("sections", T.ArrayType(DECK_SECTION))
TAG = _struct({"label": STRING})
PRICES = _struct(dict.fromkeys(["usd", "usd_foil", "usd_etched", "eur", "eur_foil", "tix"], STRING))
PRICE = _struct({"card_id": STRING, "prices": PRICES, "updated_at": T.TimestampType()})
RATE = _struct(
    {"base": STRING, "target": STRING, "rate": T.DoubleType(), "updated_at": T.TimestampType()}
)
SCAN_MATCH = _struct({"card_id": STRING})
SCANNED = _struct({"id": STRING, "url": STRING, "matches": T.ArrayType(SCAN_MATCH)})
SCAN = _struct({"count": T.LongType(), "cards": T.ArrayType(SCANNED)})

# What the import reads: the stored fields and the flags it filters by.
IMPORT_FLAGS = ["variation", "digital", "oversized"]
IMPORT = T.StructType(
    CARD.fields + [T.StructField(flag, T.BooleanType(), True) for flag in IMPORT_FLAGS]
)
