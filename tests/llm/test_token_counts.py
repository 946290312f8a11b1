import json
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curioshelf.llm import token_counts as tc

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t", "don't stop", "I'VE o''s y'all 'TIS", "x\x1c\x1dy\x85z\xa0q", "İx İ", "J̌ H̱ T̈", "KK kelvin",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "<|endof text|>", "한글 가 ﬁ ß ẞ Σς ΟΔΟΣ 😀a🏽", "½1²3 ªº ٣", "éè", "ŉ ǆ Ǆ ǅ ſ",
    "x" * 70_000, "word " * 30_000, "ünïcödé " * 5_000, "'s't're 'S ''s", "\x00\x01\x7f",
]


def expected(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n):
    r = random.Random(8)
    bits = [*"ab'sSt 1²½é<|>.\n\t\x1f\x85İıßΣ한", "̀", "ᄀ", "the ", "Vector", "<|endoftext|>"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts_are_the_library_s(path):
    counting = tc.Counting(path, tc.whole_tokens(path))
    texts = [t or "" for t in ODD] + random_texts(1500)
    assert counting.counts(texts) == expected(path, texts)


def merged(word, ranks):
    """Byte-pair merges by the book: the pair of the lowest rank first, leftmost first."""
    parts = [*word[:-1], word[-1] + "</w>"]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_whole_tokens_are_proved():
    with open(WORDS, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): n for n, m in enumerate(model["merges"])}
    whole = set(tc.whole_tokens(WORDS))
    ends = [v[: -len("</w>")] for v in model["vocab"] if v.endswith("</w>") and v != "</w>"]
    assert 10_000 < len(whole) <= len(ends)
    for word in [*sorted(whole)[::7], *sorted(set(ends) - whole)]:
        assert (len(merged(word, ranks)) == 1) == (word in whole), word


def test_most_words_take_the_shortcut(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    whole = tc.whole_tokens(WORDS)
    counting = tc.Counting(WORDS, whole)
    assert counting.counts(texts) == expected(WORDS, texts)
    cut = Counter(w for t in texts for w in counting.find(t.lower()))
    assert not set(counting.plain_rest) & set(counting.plain) and set(counting.plain_rest) <= set(cut)


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tc, "CACHED", 3)
    counting, texts = tc.Counting(WORDS, tc.whole_tokens(WORDS)), random_texts(300)
    assert [n for i in range(0, 300, 7) for n in counting.counts(texts[i : i + 7])] == expected(WORDS, texts)


def test_rows(odd_docs, docs_of):
    got = tc.token_counts(odd_docs, WORDS)
    rows = sorted(map(tuple, got.collect()), key=repr)
    given = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    counts = expected(WORDS, [t for _, t in given])
    assert rows == sorted(((d, len(t.encode()), n, n > 2048) for (d, t), n in zip(given, counts, strict=True)), key=repr)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert any(r[3] for r in rows) and tc.token_counts(odd_docs.limit(0), WORDS).count() == 0
    assert {r["over_limit"] for r in tc.token_counts(docs_of(["one two", "one"]), WORDS, limit=1).collect()} == {True, False}
