"""Secret scans with Markov models of characters, with DataFrame functions only.

Fixed patterns give the base spans.  Two character chains of order one, of random strings and of
ordinary identifiers, are counted from labelled samples of the corpus itself: the values of base
spans are random, long tokens of letters alone or digits alone are ordinary.  A long token is a
secret too where the log-likelihood ratio of the two chains is high enough.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds and patterns of the base spans, the group that is the value, its least length.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
ORDINARY = r"^([A-Za-z_-]+|[0-9-]+)=*$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.="

LEAST_RATIO = 10.0  # natural logarithm, of the whole token
SMOOTHING = 0.5

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, of) -> Column:
    """``of(value)``, with ``value`` computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _running(values: Column, joined) -> Column:
    """For each element, all elements up to it joined: in steps of 1, 2, 4, ... elements."""

    def of(held: Column) -> Column:
        steps = F.filter(F.lit([1 << k for k in range(31)]), lambda k: k < F.size(held))
        return F.aggregate(steps, held, lambda acc, k: F.transform(acc, lambda x, i: joined(x, F.get(acc, i - k))))

    return _let(values, of)


def _stretches(text: Column, places) -> Column:
    """``places`` of a function that gives the stretch of code points from start to end.  The text is
    cut into characters once."""
    return _let(F.split(text, ""), lambda chars: places(lambda start, end: F.array_join(F.slice(chars, start + 1, end - start), "")))


def _merged(spans: Column) -> Column:
    """Sorted spans (start, end) as stretches (start, end) that do not overlap; those that only touch
    stay apart."""
    reach = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    paired = F.arrays_zip(F.transform(spans, lambda s: s["start"]).alias("start"), reach.alias("reach"))

    def heads(pairs: Column) -> Column:
        each = F.transform(pairs, lambda p, i: F.struct(p["start"].alias("start"), F.get(pairs, i - 1)["reach"].alias("before")))
        return F.filter(each, lambda h: h["before"].isNull() | (h["start"] >= h["before"]))

    def stretches(pairs: Column) -> Column:
        last = F.element_at(pairs, -1)["reach"]
        closed = lambda held: F.transform(held, lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(held, i + 1)["before"], last).alias("end")))
        return _let(heads(pairs), closed)

    return _let(paired, stretches)


def _replaced(text: Column, spans: Column, filling) -> Column:
    """``text`` with ``filling(length)`` in place of every stretch under ``spans``, which are sorted."""

    def pieces(stretch):
        def of(held: Column) -> Column:
            each = F.transform(held, lambda s, i: F.concat(stretch(F.coalesce(F.get(held, i - 1)["end"], F.lit(0)), s["start"]), filling(s["end"] - s["start"])))
            return F.concat(F.array_join(each, ""), stretch(F.element_at(held, -1)["end"], F.length(text)))

        return _let(_merged(spans), of)

    return F.when(F.size(spans) > 0, _stretches(text, pieces)).otherwise(text)


def _matches(df: DataFrame, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds array ``name`` of the pattern's matches: leftmost first, none overlapping, places in
    code points.  What lies between two matches is what ``split`` leaves, and so gives the places.
    Matches whose value is shorter than ``least`` take their place and are then dropped."""
    text, hit = F.col("_text"), F.col("_text").rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_m") > 0
    df = df.withColumn("_g", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_v", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("_m"))
    taken = F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda gap, match: F.length(gap) + F.length(match))
    df = df.withColumn("_l", F.when(some, taken).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_s", _running(F.col("_l"), lambda x, y: x + F.coalesce(y, F.lit(0))))
    spans = F.expr("transform(arrays_zip(_s, _m, _v), x -> named_struct('start', x._s - length(x._m), 'end', x._s, 'value', x._v))")
    return df.withColumn(name, F.filter(spans.cast(_SPAN), lambda x: F.length(x["value"]) >= least)).drop("_m", "_g", "_v", "_l", "_s")


def scan(documents: DataFrame) -> DataFrame:
    """``documents`` (text, and whatever else) with the base spans of each kind and the long tokens of
    what lies between them, as columns _assign, _access, _hex, _tokens.  Null texts are empty."""
    df = documents.withColumn("_text", F.coalesce("text", F.lit("")))
    for name, pattern, group, least in KINDS:
        df = _matches(df, f"_{name}", pattern, group, least)
    df = df.withColumn("_cut", F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), lambda s: F.struct(s["start"], s["end"]))))
    df = df.withColumn("_text", _replaced(F.col("_text"), F.col("_cut"), lambda n: F.repeat(F.lit(" "), n)))
    return _matches(df, "_tokens", TOKEN, 0, 16).drop("_text", "_cut")


def samples(scanned: DataFrame) -> DataFrame:
    """Labelled samples (value, random) of a scanned table, from all its rows.  The table is best
    written before (``kept``), as it is read once for each kind of sample and once more to be scored."""
    # With explode in place of explode_outer, Spark would first scan the texts to see which have spans.
    one = lambda spans, random: scanned.select(F.explode_outer(spans).alias("s")).select("s.value", F.lit(random).alias("random"))
    random, plain = one(F.concat("_assign", "_access", "_hex"), True), one(F.col("_tokens"), False)
    return random.where("value is not null").unionByName(plain.where(F.col("value").rlike(ORDINARY)))


def _pairs(value: Column, joined) -> Column:
    """``joined`` of each two neighbouring characters."""
    both = lambda chars: F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), joined)
    return _let(F.split(value, ""), both)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, random against ordinary, by 128 * first + second.

    Only pair counts come to the driver: at most two for each pair of the alphabet.  Without samples
    of both kinds all ratios are 0 and no span is added."""
    pairs = labelled.where(F.length("value") > 1).select("random", F.explode_outer(_pairs(F.col("value"), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    ratios = [0.0] * (128 * 128)
    if {random for random, _ in counts} != {True, False}:
        return ratios
    for a in ALPHABET:
        rows = [{b: counts.get((random, a + b), 0) + SMOOTHING for b in ALPHABET} for random in (True, False)]
        sums = [sum(row.values()) for row in rows]
        for b in ALPHABET:
            ratios[128 * ord(a) + ord(b)] = math.log(rows[0][b] / sums[0]) - math.log(rows[1][b] / sums[1])
    return ratios


def ratio(value: Column, ratios: Sequence[float]) -> Column:
    """Log-likelihood ratio of a token: its pairs' ratios added up."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    found = _pairs(value, lambda a, b: F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1))
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x)


def score(scanned: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """A scanned table with ``_spans``: all spans (start, order, kind, end), sorted."""
    named = lambda c, n, k: F.transform(c, lambda s: F.struct(s["start"], F.lit(n).alias("order"), F.lit(k).alias("kind"), s["end"]))
    added = F.filter("_tokens", lambda t: ratio(t["value"], ratios) >= LEAST_RATIO)
    base = [named(f"_{k}", n, k) for n, (k, *_) in enumerate(KINDS)]
    return scanned.withColumn("_base", F.array_sort(F.concat(*base))).withColumn(
        "_spans", F.array_sort(F.concat("_base", named(added, len(KINDS), "markov")))
    )


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: str, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch of code points under ``spans`` (sorted) replaced by ``mark``."""
    return _replaced(text, F.col(spans), lambda n: F.lit(mark))
