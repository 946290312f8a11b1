import math
import random

import numpy as np
import pytest

from curioshelf.llm import topk


def brute(rows, queries):
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i in queries}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q))[: topk.K]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_rows, group, few", [(7, 20, 0), (64, 4096, 8), (2048, 8192, 64)])
def test_table(spark, monkeypatch, slice_rows, group, few):
    for name, value in (("SLICE", slice_rows), ("GROUP", group), ("FEW", few), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(slice_rows)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [rows[5], rows[10]]
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, rows[0][1]), (305, [2.0, 1.0]), (306, [900.0] * 8)]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = topk.top_k(frame, frame.where("vec_id % 10 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0})


def test_fewer_than_k_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.top_k(frame, frame.where("vec_id = 0")).collect())) == [(0, 1, 1, -65536)]
    assert topk.top_k(frame, frame.limit(0)).count() == 0 and topk.top_k(frame.limit(0), frame).count() == 0


def test_large_numbers_are_exact():
    r = np.random.default_rng(1)
    for most in (300, 10**6, 10**8):
        x = r.integers(-most, most, (500, 16)).astype(float)
        found = topk.search_group(x[:3], np.arange(3), x, np.arange(500))
        for i, (scores, ids) in enumerate(found):
            exact = [(-sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True)), j) for j in range(500) if j != i]
            assert [(-int(s), int(j)) for s, j in zip(scores, ids, strict=True)] == sorted(exact)[: topk.K]


@pytest.mark.parametrize("most", [30, 30_000, 10**8])
def test_scores_far_below_zero(most):
    """Every score is negative and large; a query still gets all it can, and never itself."""
    r = np.random.default_rng(2)
    for n in (4, 5, 6, 200, 3000):
        x = -r.integers(most // 2, most, (n, 64)).astype(float)
        q = -x[:3]
        found = topk.search_group(q, np.array([0, 1, 10**6]), x, np.arange(n))
        for i, (scores, ids) in enumerate(found):
            exact = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)), j) for j in range(n) if j != (0, 1, 10**6)[i])
            assert [(-int(s), int(j)) for s, j in zip(scores, ids, strict=True)] == exact[: topk.K]
