import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from curioshelf.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, pivots int, `values` int, of int, position int"


def plain(rows, rounds=vc.ROUNDS):
    """Codes by lists of whole numbers: every part against every entry."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in rows), default=1) // 8))
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in rows]
    parts = [[w[p * width : (p + 1) * width] for p in range(8)] for w in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:16]
    books = [[parts[i][p] for i in first] for p in range(8)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(row)] for row in parts]
    for _ in range(rounds):
        found = assign()
        for p in range(8):
            for k in range(len(first)):
                own = [row[p] for row, f in zip(parts, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    error, by_label = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    codes = ["".join(f"{k:02x}" for _, k in f) for f in found]
    return sorted(((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, error, strict=True)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def ran(spark, rows):
    return sorted(map(tuple, vc.vector_codes(frame(spark, rows)).collect()), key=repr)


def test_as_plain_lists(spark):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)], r.choice([0, 1, 2, None])) for i in range(-30, 220)]
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    assert ran(spark, rows) == plain(rows)


def test_ties_repeats_and_odd_rows(spark):
    r = random.Random(5)
    rows = [(r.randrange(20), [float(r.randrange(-1, 2)) for _ in range(8)], None if k % 3 else 1) for k in range(120)]
    rows += rows[:20]
    rows += [(None, [0.5] * 8, None), (7, None, 1), (8, [0.0, None], 1), (9, [float("nan")] * 8, 1), (10, [float("inf")], 2), (11, [], 2), (12, [-0.25] * 3, 2), (500, [0.1] * 13, 3)]
    assert ran(spark, rows) == plain(rows)


def test_few_vectors_and_none(spark):
    few = [(3, [1.0] * 16, None), (1, [-1.0] * 16, 4), (2, [1.0] * 16, 4)]
    assert ran(spark, few) == plain(few)
    assert ran(spark, []) == [] and ran(spark, [(1, None, 2)]) == []
    with pytest.raises(ValueError):
        vc.vector_codes(frame(spark, [(1, [1e30] * 8, 1)]))


def test_bounds_save_distances_and_lose_nothing():
    r = np.random.default_rng(6)
    centres = r.integers(-3000, 3000, (16, 8))
    for entries in (centres, np.repeat(centres[:4], 4, axis=0), centres // 1000):
        x = entries[r.integers(0, 16, 3000)] + r.integers(-40, 41, (3000, 8))
        pivots = entries[:4]
        stored = np.sqrt(vc._distances(x, pivots)).astype(np.float32)
        moved = entries + r.integers(-20, 21, entries.shape)
        found, best, computed = vc.nearest(x, stored, pivots, moved)
        every = vc._distances(x, moved)
        assert (found == every.argmin(1)).all() and (best == every.min(1)).all()
        if entries is centres:
            assert computed < 0.4 * every.size


def test_codes_decode_to_their_entries(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(16)], 0) for i in range(60)]
    stored, pivots, books = vc.train(frame(spark, rows))
    values = {x["vec_id"]: x["values"] for x in stored.collect()}
    for row in vc.codes(stored, pivots, books).collect():
        assert ((np.array(values[row["vec_id"]]) - vc.decode(row["code"], books)) ** 2).sum() == row["error"]
