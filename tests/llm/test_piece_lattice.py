import random
import zlib

import public_tokenizers
import pytest

from curioshelf.llm import piece_lattice as pl

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pl.lattice(PATH)


def brute(model, text, n):
    """Scores of the n best paths through the whole text's lattice, by full dynamic programming."""
    if not text:
        return [0.0]
    into = model.edges(pl.SPACE + text.replace(" ", pl.SPACE))
    best = [[0.0]] + [[] for _ in into[1:]]
    for j in range(1, len(into)):
        best[j] = sorted((b + s for i, s, _ in into[j] for b in best[i]), reverse=True)[:n]
    return best[-1]


TEXTS = ["", " ", "a", "the tokenization of 日本 😀\n\n x", "  two  spaces ", "naïve café, déjà-vu!", "aaaaaaaaaaaaaaaa", "\x00\t", "x" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_best_paths(model, text):
    got = model.n_best(text)
    assert [s for s, _ in got] == brute(model, text, pl.N_BEST)
    assert len({p for _, p in got}) == len(got)
    assert all(model.decode(p) == text for _, p in got)


def test_random_texts(model):
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice("abt heion.,é日 ") for _ in range(r.randrange(1, 30)))
        assert [s for s, _ in model.n_best(text)] == brute(model, text, pl.N_BEST)


def test_search_gives_paths_in_order(model):
    found = model.search("▁tokenization", 20)
    assert [s for s, _ in found] == brute(model, "tokenization", 20)


def test_fractional_scores(model, monkeypatch):
    """Scores of a unigram model are no whole numbers: sums differ by rounding, paths do not."""
    r = random.Random(9)
    monkeypatch.setattr(model, "pieces", {p: (i, -r.uniform(0.1, 9.9)) for p, (i, _) in model.pieces.items()})
    for _ in range(80):
        text = "".join(r.choice("abt heion.") for _ in range(r.randrange(1, 25)))
        found = model.search(pl.SPACE + text.replace(" ", pl.SPACE), 8)
        assert [s for s, _ in found] == pytest.approx(brute(model, text, 8))
        assert len({ids for _, ids in found}) == len(found) and all(model.decode(ids) == text for _, ids in found)


def test_tables(spark, odd_docs):
    rows = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    encoded = pl.encode(odd_docs, PATH)
    assert encoded.count() == odd_docs.count()
    assert {tuple(r) for r in pl.decode(encoded, PATH).collect()} == rows
    for r in pl.digests(odd_docs, PATH).collect():
        assert r["round_trip"] and (r["next_score"] is None or r["next_score"] <= r["score"])
    empty = pl.digests(odd_docs.where("doc_id = 3"), PATH).first()
    assert tuple(empty) == (3, 0, zlib.crc32(b""), 0.0, None, True)
    assert pl.encode(odd_docs.limit(0), PATH).count() == 0
