"""Jobs over mana costs and rules text.  Each explodes the pieces of a text and counts or keeps
them as rows; the counting combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that mark symbols, reminder text, saga chapters and loyalty abilities,
# and the chapter numerals.
SYMBOL = r"\{[^}]+\}"
REMINDER = r"\([^)]+\)"
SAGA = r"^([IVX]+(?:,\s*[IVX]+)*)\s*[—−-]\s*(.+)$"
LOYALTY = r"^([+\-−]?\d+|0|X): (.+)$"
NUMERALS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]


def symbols_in(text: Column) -> Column:
    """Array of the symbols in a text, without their braces."""
    found = F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0))
    return F.transform(found, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def _histogram(df: DataFrame, text: str) -> DataFrame:
    pieces = df.select(F.explode(symbols_in(F.col(text))).alias("symbol"))
    return pieces.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def mana_symbols(cards: DataFrame) -> DataFrame:
    """How often each symbol occurs in mana costs."""
    return _histogram(cards, "mana_cost")


def text_symbols(cards: DataFrame) -> DataFrame:
    """How often each symbol occurs in rules text."""
    return _histogram(cards, "oracle_text")


def reminder_text(cards: DataFrame) -> DataFrame:
    """One row per parenthesised segment: id, its place in the text, and the segment."""
    found = F.regexp_extract_all(F.col("oracle_text"), F.lit(REMINDER), F.lit(0))
    return cards.select("id", F.posexplode(found).alias("place", "segment"))


def rules_lines(cards: DataFrame) -> DataFrame:
    """Non-blank lines of rules text with their kind: saga, loyalty or plain."""
    lines = cards.select("id", F.posexplode(F.split("oracle_text", "\n")).alias("line_no", "line"))
    kind = (
        F.when(F.col("line").rlike(SAGA), "saga")
        .when(F.col("line").rlike(LOYALTY), "loyalty")
        .otherwise("plain")
    )
    return lines.filter(F.col("line").rlike(r"\S")).withColumn("kind", kind)


def saga_chapters(lines: DataFrame) -> DataFrame:
    """One row per chapter of each saga line; a numeral beyond X counts as 1."""
    chapters = F.split(F.regexp_extract("line", SAGA, 1), r",\s*")
    number = F.array_position(F.array(*[F.lit(n) for n in NUMERALS]), F.col("numeral"))
    return (
        lines.filter(F.col("line").rlike(SAGA))
        .select(
            "id",
            "line_no",
            F.explode(chapters).alias("numeral"),
            F.regexp_extract("line", SAGA, 2).alias("ability"),
        )
        .withColumn("chapter", F.when(number > 0, number.cast("int")).otherwise(1))
    )


def loyalty_costs(lines: DataFrame) -> DataFrame:
    """Direction (up, down, zero) and size of each loyalty ability.

    A saga line is never a loyalty line, and a bare number other than 0 has direction zero.
    """
    sign = F.substring("cost", 1, 1)
    signed = sign.isin("+", "-", "−")
    direction = (
        F.when((sign == "+") | (F.col("cost") == "X"), "up").when(signed, "down").otherwise("zero")
    )
    size = F.when(signed, F.expr("substring(cost, 2)")).otherwise(F.lower("cost"))
    return (
        lines.filter(F.col("line").rlike(LOYALTY) & ~F.col("line").rlike(SAGA))
        .select("id", "line_no", F.regexp_extract("line", LOYALTY, 1).alias("cost"))
        .withColumn("direction", direction)
        .withColumn("size", size)
    )


FACE_FIELDS = ["name", "mana_cost", "type_line", "oracle_text", "power", "toughness", "loyalty"]


def card_faces(cards: DataFrame) -> DataFrame:
    """One row per face; a card without faces is its own single face."""
    own = F.array(F.struct(*[F.col(f).cast("string").alias(f) for f in FACE_FIELDS]))
    faces = F.transform(
        "card_faces", lambda face: F.struct(*[face[f].cast("string").alias(f) for f in FACE_FIELDS])
    )
    shown = F.when(F.size("card_faces") > 0, faces).otherwise(own)
    return cards.select("id", F.posexplode(shown).alias("face_no", "face")).select(
        "id", "face_no", "face.*"
    )
