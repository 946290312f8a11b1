import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curioshelf.llm import token_files as tf
from curioshelf.llm.tokens import WordTokenizer, runs, tokenizer
from curioshelf.session import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "A\x1cb C", "İstanbul ΣΑΣ", "don't, they'll.,x a.b, c", "<|endoftext|> hi <|ENDOFTEXT|> b.", "éa café, ÀÉ. x", "\ttab\r\nx", "１２3 ²", "日本語。text", "naïve,\nfoo.", "é, x́"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB ,.'é\ńΣ<|>1 日"), max_size=40), max_size=6))
def test_ids_are_the_librarys(texts):
    own = tokenizer(PATH)
    ids, counts = own.encode(texts)
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_odd_texts_and_a_small_cache(monkeypatch):
    monkeypatch.setattr("curioshelf.llm.tokens.CACHED_WORDS", 2)
    own = WordTokenizer(PATH)
    for text in ODD * 2:
        assert own.encode([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_capitals_that_do_not_compose():
    """Composed first, lowered then: the small letter with the mark is one character, the capital's are two."""
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    own = WordTokenizer(PATH)
    for text in [*pairs, *(p.lower() for p in pairs), *(f"An {p}X, B\n{p}" for p in pairs)]:
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode([text])[0].tolist() == want and own.lengths([text]).tolist() == [len(want)], ascii(text)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 5000, 140_000])
@pytest.mark.parametrize("kind", ["same", "random", "skewed", "repeating"])
def test_blocks_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"same": np.full(n, 7), "random": r.integers(0, 49_408, n), "skewed": np.minimum(r.geometric(0.05, n), 49_407), "repeating": np.arange(n) % 97}[kind]
    docs, counts = np.array([-5, 2**62]), np.array([n // 3, n - n // 3])
    got = tf.decode_block(tf.encode_block(docs, counts, ids))
    for a, b in zip(got, (docs, counts, ids), strict=True):
        assert np.array_equal(a, b)


def test_prediction_pays():
    r = np.random.default_rng(1)
    plain = r.integers(0, 40_000, 60_000)
    again = np.tile(r.integers(0, 40_000, 300), 200)
    assert len(tf.encode_block(np.array([1]), np.array([len(again)]), again)) < 0.2 * len(tf.encode_block(np.array([1]), np.array([len(plain)]), plain))


def test_orders_are_mixed():
    """Three likely successors an id: 1.49 bits an id by order 1, 10.5 by order 0."""
    r = np.random.default_rng(0)
    n, follows = 1 << 18, r.integers(0, 2000, (2000, 3))
    picks, ids, now = r.choice(3, n, p=[0.5, 0.3, 0.2]), np.empty(n, np.int64), 0
    for k in range(n):
        now = ids[k] = follows[now, picks[k]]
    block = tf.encode_block(np.array([1]), np.array([n]), ids)
    assert 8 * len(block) / n < 2.2
    assert np.array_equal(tf.decode_block(block)[2], ids)


def test_intervals_are_disjoint_and_found():
    """Every id has an interval, they follow each other, and each value is found in its own."""
    r = np.random.default_rng(3)
    model = tf._Model(50, 40)
    for _ in range(300):
        model.predict()
        model.interval(ids := np.minimum(r.geometric(0.2, 40), 49).astype(np.int32))
        model.learn(ids)
    model.predict()
    end = np.zeros(40, np.int64)
    for id_ in range(50):
        start, width = model.interval(np.full(40, id_, np.int32))
        assert (start == end).all() and (width > 0).all()
        for value in (start, start + width // 2, start + width - 1):
            assert (model.find(value.astype(np.int32)) == id_).all()
        end = start.astype(np.int64) + width
    assert (end <= 1 << 30).all()


def test_damage_is_noticed():
    block = bytearray(tf.encode_block(np.array([1]), np.array([3]), np.array([5, 6, 7])))
    for at in (0, 6, 20, len(block) - 1):
        bad = block.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tf.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        tf.decode_block(bytes(block[:20]))


def test_files(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 20)
    monkeypatch.setattr("curioshelf.llm.fingerprints.BUCKET_ROWS", 2)
    folder = scratch(spark)
    tf.write_tokens(odd_docs, PATH, folder)
    library = tokenizer(PATH).tokenizer
    rows = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in odd_docs.collect()))
    want, start = [], 0
    for doc, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4")), ids))
        start += len(ids)
    assert sorted(map(tuple, tf.read_tokens(spark, folder).collect()), key=lambda x: x[1]) == want
    assert sorted(map(tuple, tf.read_tokens(spark, folder, ids=False).collect()), key=lambda x: x[1]) == [w[:4] for w in want]
    assert tf.token_file(odd_docs.limit(0), PATH).count() == 0


def test_words_are_known_whatever_signs_follow_them():
    own = WordTokenizer(PATH)
    texts = ["Word word, word... (word) word's wörd, wörd", "a,b a≮b á, Á≮ o'.'s x.'s don't! …!? 1,2 a1,", "", "\n,\n", "<|endoftext|> word,"]
    ids, counts = own.encode(texts)
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert own.lengths(texts).tolist() == counts.tolist()
    assert b"word" in own.places and not {b"word,", b"word...", b"word)"} & own.places.keys()


def test_runs_of_texts_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr("curioshelf.llm.tokens.RUN_BYTES", 4)
    assert list(runs(pa.array(["ab", "é", None, "abcdefgh", "", "x"]))) == [(0, 3), (3, 1), (4, 2)]
    assert list(runs(pa.array([], pa.string()))) == []


def test_words_are_told_apart_by_all_their_bytes():
    own = WordTokenizer(PATH)
    long = ["a" * n for n in (7, 8, 9, 15, 16, 23, 24, 30, 31, 32, 33)]
    texts = [" ".join(long), "a a\0 a\0\0 \0", "ß à í ÿ straße voilà aquí", " ".join(f"{w[:-1]}b {w}c" for w in long)]
    for given in (texts, pa.array([*texts, None]).slice(1), pa.array(texts, pa.large_binary())):
        ids, counts = own.encode(given)
        rows = given if isinstance(given, list) else [(t or "") if isinstance(t, (str, type(None))) else t.decode() for t in given.to_pylist()]
        want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        assert own.lengths(given).tolist() == counts.tolist()
    assert own.places.keys() >= {w.encode() for w in long} | {b"a\0", b"a\0\0", b"\0"}


def test_the_cache_of_words_grows():
    own = WordTokenizer(PATH)
    for start in range(0, 9000, 1500):
        texts = [f"w{n} v{n * 7919}" for n in range(start, start + 3000)]
        want = [len(e.ids) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert own.lengths(texts).tolist() == want
    assert len(own.places) == own.known == 2 * 10_500


def test_id_zero_is_a_follower_like_others():
    r = np.random.default_rng(5)
    ids = np.where(r.random(40_000) < 0.6, 0, r.integers(0, 6, 40_000))
    assert np.array_equal(tf.decode_block(tf.encode_block(np.array([1]), np.array([len(ids)]), ids))[2], ids)
