import hashlib

import numpy as np
import pyarrow as pa
import pytest

from curioshelf.llm import fingerprints as fp
from curioshelf.llm.shingles import shingle_sets


def of(text):
    return next(shingle_sets(pa.array([text])))


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_coding():
    for text in ("", "a", words(0, 9), words(0, 5000)):
        s = fp.sketch(of(text))
        assert np.array_equal(fp.decode(fp.encode(s)), s)


def test_estimates():
    a, b = of(words(0, 6000)), of(words(2000, 8000))
    x, y = fp.sketch(a), fp.sketch(b)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert fp.resemblance(x, y) == pytest.approx(truth, abs=0.13)
    assert fp.containment(x, y) == pytest.approx(4 / 6, abs=0.2)
    assert fp.distinct(x) == pytest.approx(len(a), rel=0.3)
    assert np.array_equal(fp.merge([x, y]), fp.sketch(np.union1d(a, b)))


def test_small_sets_are_exact():
    a, b = fp.sketch(of(words(0, 60))), fp.sketch(of(words(20, 80)))
    assert fp.resemblance(a, b) == 36 / 76 and fp.containment(a, b) == 36 / 56 and fp.distinct(a) == 56
    none = fp.sketch(of(""))
    assert fp.resemblance(none, none) == 1 and fp.resemblance(none, a) == 0 and fp.containment(none, a) == 1 and fp.distinct(none) == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        own, other, new = (fp.sketch(of(t)) for t in (text, after, edited))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.encode(own), fp.encode(new), fp.resemblance(own, new), fp.resemblance(own, other)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_of_a_range", [1, 3, 2048])
def test_table(odd_docs, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(fp, "BUCKET_ROWS", rows_of_a_range)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = fp.fingerprints(odd_docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_lone_and_no_documents(docs_of):
    lone = fp.fingerprints(docs_of(["abcd"])).first()
    assert lone["n_chars"] == 4 and lone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and lone["near_next"] == 1
    assert fp.fingerprints(docs_of(["a"]).limit(0)).count() == 0


def test_parts_merge(spark, docs_of):
    docs = docs_of([words(0, 400), words(300, 900), None, ""])
    got = fp.merged(fp.fingerprints(docs).selectExpr("doc_id % 2 as part", "fingerprint"), "part")
    want = {k: fp.encode(fp.sketch(of(words(*span)))) for k, span in ((0, (0, 400)), (1, (300, 900)))}
    assert {tuple(r) for r in got.collect()} == set(want.items())
