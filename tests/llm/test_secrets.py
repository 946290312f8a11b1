import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from curioshelf.llm import secrets

FIXED = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(FIXED):
        found += [(m.start(), n, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def told(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


HEX = "0123456789abcdef" * 3
TEXTS = [
    None,
    "",
    "a password=hunter22 and passwd: 'x' secret=token:abcdefgh",
    "日本 TOKEN = \"" + HEX + "\" é AKIA" + "Z9" * 9 + "\n" + HEX,
    "API_KEY:=abcdef apikey=\"abcdef.g-h\" secret=token: zzzzzz password  :  =====",
    "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 12 + " xAKIA" + "1" * 16,
    HEX[:23] + " " + HEX[:24] + "g" + HEX[:30] + "token=" + HEX[:5],
    "password=abc password=abcdefg" * 40,
    "\x01\x02 token=abcdef\x00 token=abcdef",
]


def scored(docs, ratios=None):
    scanned = secrets.scan(docs)
    return secrets.score(scanned, secrets.train(secrets.samples(scanned)) if ratios is None else ratios)


def test_base_spans(docs_of):
    r = random.Random(1)
    bits = ["password", "token", "=", ":", " ", "'", "abcdef", "AKIA", "Z9Z9Z9Z9", HEX[:13], "é", "\n", "api_key", "secret", ".", "x"]
    texts = TEXTS + ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    for row in scored(docs_of(texts), [0.0] * 128 * 128).withColumn("told", secrets.listed("_base")).collect():
        want = base(row["text"])
        assert row["told"] == told(want), repr(row["text"])
        for kind in ("assign", "access", "hex"):
            assert len(row[f"_{kind}"]) == sum(k == kind for _, _, k, _ in want)


@pytest.fixture
def mixed(docs_of):
    """Texts with labelled secrets, long ordinary words, card numbers, and bare random tokens."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("aeilnorst") for _ in range(n))
    blob = lambda n: hashlib.sha256(str(r.random()).encode()).hexdigest()[:n]
    texts = [f"{word(5)} password={blob(18)} {word(20)} {r.randrange(10**15, 10**16)}" for _ in range(150)]
    bare = [f"{word(22)} {blob(20)} {r.randrange(10**15, 10**16)} {word(17)}-{word(4)}" for _ in range(30)]
    return docs_of([*texts, *bare, None, ""])


def test_chains_add_random_tokens_only(mixed):
    rows = scored(mixed).orderBy("doc_id").collect()
    for row in rows[:150]:
        assert [s["kind"] for s in row["_spans"]] == ["assign"]
    hits = [[row["text"][s["start"] : s["end"]] for s in row["_spans"]] for row in rows[150:180]]
    assert sum(h == [row["text"].split()[1]] for h, row in zip(hits, rows[150:180], strict=True)) >= 28
    assert rows[180]["_spans"] == rows[181]["_spans"] == []


def test_redaction(mixed, spark):
    out = scored(mixed).withColumn("out", secrets.redacted(F.col("text"), "_spans")).orderBy("doc_id").collect()
    for row in out:
        text, at, want = row["text"], 0, ""
        for s in row["_spans"]:
            want += text[at : s["start"]] + "[SECRET]"
            at = s["end"]
        assert row["out"] == (None if text is None else want + text[at:])
    spans = "array(named_struct('start', 1, 'end', 4), named_struct('start', 2, 'end', 3), named_struct('start', 3, 'end', 6), named_struct('start', 7, 'end', 8))"
    one = spark.range(1).selectExpr("'abcdefgh' as text", f"{spans} as s").select(secrets.redacted(F.col("text"), "s", "_")).first()
    assert one[0] == "a_g_"


def test_native_and_empty(odd_docs):
    plan = scored(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert scored(odd_docs).count() == odd_docs.count() and scored(odd_docs.limit(0)).count() == 0
    assert "score" in scored(odd_docs).columns


def test_what_a_base_span_leaves_of_a_token(docs_of):
    """Random characters on either side of a base span are found too, and struck out."""
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    random_part = letters(40)
    token = random_part + "-" + "0123456789abcdef" * 2 + "-" + random_part[::-1]
    teach = [f"password={letters(24)} " + "".join(r.choice("aeinorst") for _ in range(24)) for _ in range(200)]
    row = scored(docs_of([*teach, "é " + token + " end"])).withColumn("out", secrets.redacted(F.col("text"), "_spans")).orderBy(F.desc("doc_id")).first()
    assert row["out"].startswith("é ") and row["out"].endswith(" end") and random_part not in row["out"] and random_part[::-1] not in row["out"]
    at = [(s["kind"], s["start"], s["end"]) for s in row["_spans"]]
    assert at == [("markov", 2, 43), ("hex", 43, 75), ("markov", 75, 116)]


LENGTHS = {
    "hex runs": (HEX[:32] + " ") * 31_000,
    "assignments": "token=abcdef " * 80_000,
    "one token": "Ab1_" * 250_000,
    "one hex run": HEX * 21_000,
}


@pytest.mark.parametrize("name", LENGTHS)
def test_long_texts_take_time_by_their_length(docs_of, name):
    text = LENGTHS[name]
    docs = docs_of([text, text, None])
    start = time.monotonic()
    rows = scored(docs).withColumn("out", secrets.redacted(F.col("text"), "_spans")).withColumn("told", secrets.listed("_base")).collect()
    assert time.monotonic() - start < 60  # squared, this took from minutes to hours
    for row in rows[:2]:
        assert row["told"] == told(base(text)) and (row["_base"] or row["_tokens"][0]["end"] == len(text))
        assert len(row["out"]) < len(text) or not row["_spans"]
