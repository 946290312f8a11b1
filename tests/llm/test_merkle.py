import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from curioshelf.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"
CLASHING = "tree string, pos long, hash string, block long, step int, leaf string, rank int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [*row[:4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def fold(levels, at, node):
    """(siblings, what ``node`` in place of the one at ``at`` folds to)."""
    told = []
    for nodes in levels[:-1]:
        run = nodes[at - at % 16 : at - at % 16 + 16]
        told += run[: at % 16] + run[at % 16 + 1 :]
        run[at % 16] = node
        node, at = h(*run), at // 16
    return told, node


def brute(rows):
    """Whole trees in memory; a row is FIELDS."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row, leaf(row, row[4])))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for own in by_source.values():
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    low = {s: tree([x[1] for x in by_source[s]]) for s in sources}
    high = tree([low[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for at, (row, own) in enumerate(by_source[s]):
            now = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            told, node = fold(low[s], at, now)
            more, top = fold(high, n, node)
            root = high[-1][0]
            out.append((row[0], own, low[s][-1][0], root, h(*told, *more), top, top == root))
    return sorted(out, key=repr)


def ran(spark, rows, **kinds):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z", 4) for r in rows], f"{FIELDS}, {CLASHING}")
    found = merkle.manifest(docs, merkle.tampered(docs))
    return sorted(map(tuple, found.collect()), key=repr)


def doc(i, source, text="Text A"):
    return (i, source, "en", 3, f"{text} {i}")


def test_every_shape_of_tree(spark):
    sizes = {"a": 1, "b": 2, "c": 15, "d": 16, "e": 17, "f": 255, "g": 256, "h": 257, "i": 700, "é": 33, "": 3, None: 40}
    rows = [doc(1000 * n + i, s) for n, (s, size) in enumerate(sizes.items()) for i in range(size)]
    got = ran(spark, rows)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_many_sources(spark):
    rows = [doc(i, f"s{i * 7 % 300}") for i in range(330)]
    assert ran(spark, rows) == brute(rows)


@pytest.mark.parametrize("sources", [["s"], [None], ["t", "s"]])
def test_few_rows(spark, sources):
    rows = [doc(i, s) for i, s in enumerate(sources)]
    assert ran(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "A"), (5, "s", "en", None, None), (5, "s", "en", None, None), (5, "s", "de", 2, "ÄB"), (-3, "s", "", 0, "")]
    rows += [(2**62 + i, "s", "en", 1, "Long A " * 20_000) for i in range(3)] + [(10, "-", "e:n", 1, "1:a"), (15, "=", "en", 1, "\x00 é😀 Z")]
    rows += [(i, "copy", "en", 1, "Same") for i in [7] * 30]
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, []) == []


def test_untouched_rows_fold_to_the_root(spark):
    docs = spark.createDataFrame([doc(i, "s") for i in range(40)], FIELDS)
    assert {r["verified"] for r in merkle.manifest(docs).collect()} == {True}


def test_one_source_over_three_stages(spark):
    n = merkle.BLOCK**2 + 300
    rows = [(i, "hot", None, None, "A") for i in range(n)] + [doc(i, "other") for i in range(n, n + 20)]
    docs = spark.range(n).selectExpr("id doc_id", "'hot' source", "string(null) lang", "bigint(null) n_chars", "'A' text")
    docs = docs.unionByName(spark.createDataFrame(rows[n:], FIELDS))
    found = merkle.manifest(docs, merkle.tampered(docs))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
