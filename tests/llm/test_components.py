import random

from curioshelf.llm.components import components


def test_against_union_find(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame([*links, (None, 3), (5, None)], "a long, b long"))
    assert {(n, t) for n, t in map(tuple, got.collect()) if n is not None} == {(n, top(n)) for n in nodes}


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
