"""Chat formatting from an event log, with DataFrame functions only.

Conversations come as events (conv_id, seq, turn, kind, role, text).  They are sorted by ``seq`` and
folded: a ``delta`` appends to the text of its turn, an ``edit`` replaces it, a ``regenerate`` starts
the turn anew and discards what later turns had so far.  The final messages are then rendered as

    ### role: text </turn>

with ``\\``, ``<``, ``#`` (and ``:`` in roles) escaped by a backslash and a letter, so that a text
never holds a control string and every text can be had back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
# The backslash comes first here and last when undone.
TEXT_ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (":", "\\c")]
TRAINED_ROLE = "assistant"


def _escaped(text: Column, escapes: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), escapes, text)


def _plain(text: Column, escapes: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), escapes[::-1], text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log.

    Events of one turn with the same seq follow each other by kind and text.  A null kind is a
    ``delta``, a null text is empty, the role is the last that is not null, else empty.  Null
    conv_ids are one conversation and null turns its first turn.  A turn of which nothing is left
    after a regeneration of an earlier one is gone.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    event = F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    turns = events.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(kind == "regenerate", F.col("seq"))).alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("again").over(earlier))
    turns = turns.withColumn("log", F.filter("log", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))).where(F.size("log") > 0)
    # The place of the last event that starts the text anew; what precedes it does not count.
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(0)))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return turns.withColumn("last", last).select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(F.filter("log", lambda e, i: i >= F.col("last")), lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, marks) of messages with one row per turn, in order of turn.

    marks has one entry per turn, in code points of ``formatted``: where the turn starts, where its
    trained text starts and how long that is; both null where the turn is not the assistant's.
    """
    head = F.concat(F.lit(OPEN), _escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    body = _escaped(F.col("text"), TEXT_ESCAPES)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    parts = parts.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    parts = parts.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    trained = F.col("role") == TRAINED_ROLE
    mark = F.struct(
        F.col("start").alias("start"),
        F.when(trained, F.col("start") + F.length("head")).alias("loss_start"),
        F.when(trained, F.length("body").cast("long")).alias("loss_length"),
    )
    piece = F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), mark.alias("mark"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform("pieces", lambda p: p["mark"]).alias("marks"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns of role and text, trained texts) from what ``render`` wrote."""
    pieces = F.filter(F.split("formatted", CLOSE.replace("\n", "\\n")), lambda p: p != "")
    split = formatted.withColumn("pieces", pieces)
    at = lambda p: F.instr(p, MIDDLE)
    turn = lambda p: F.struct(
        _plain(F.substring(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
        _plain(F.substring(p, at(p) + len(MIDDLE), F.length(p)), TEXT_ESCAPES).alias("text"),
    )
    masked = F.zip_with("pieces", "marks", lambda p, m: F.when(m["loss_start"].isNotNull(), F.substring(p, (m["loss_start"] - m["start"] + 1).cast("int"), m["loss_length"].cast("int"))))
    return split.select(
        "conv_id",
        "formatted",
        F.transform("pieces", turn).alias("turns"),
        F.transform(F.filter(masked, lambda x: x.isNotNull()), lambda x: _plain(x, TEXT_ESCAPES)).alias("trained"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Folds an event log and renders it: (conv_id, formatted, marks).  An empty log has no rows;
    other columns are not looked at."""
    return render(fold(events))


def as_events(conversations: DataFrame) -> DataFrame:
    """An event log that leads to the rows of ``conversations`` (conv_id, turn, role, text).

    Rows are the turns, in order of turn, role and text, so rows that repeat stay turns of their
    own.  Users' texts are typed, then edited; assistants' are drafted, regenerated and streamed.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda n, kind, text: F.struct((F.col("turn") * 8 + n).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "delta", first), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    typed = F.array(event(0, "delta", first), event(1, "edit", F.col("text")))
    log = rows.withColumn("event", F.explode(F.when(F.col("role") == TRAINED_ROLE, streamed).otherwise(typed)))
    return log.select("conv_id", "event.seq", "turn", "event.kind", "role", "event.text")
