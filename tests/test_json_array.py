import json
import random

import pytest

from curioshelf.sources import json_array
from curioshelf.sources.json_array import Cutter, advance, read_elements

TEXTS = ['plain', '"', '\\', '\\"', '}', '{"a": [1, 2]}', '], [', 'é日😀', '', '\\\\', '\n\t', '"}', ',']


def an_object(r, depth=0):
    value = lambda: r.choice(
        [r.choice(TEXTS) + r.choice(TEXTS), r.randrange(99), None, True, [r.choice(TEXTS)], [], {}] + ([an_object(r, depth + 1), [an_object(r, depth + 1)]] if depth < 3 else [])
    )
    return {r.choice(TEXTS) + str(k): value() for k in range(r.randrange(4))} | {"id": r.randrange(10**6)}


def layouts(records):
    yield json.dumps(records, separators=(",", ":"))
    yield json.dumps(records, indent=3, ensure_ascii=False)
    yield "\n  [" + " \n,\t".join(json.dumps(x, ensure_ascii=False) for x in records) + " ]\n\n"


def pieces_of(text, r, blocks):
    """What the tasks give for ``text``, its fragments dealt to blocks, and these to batches."""
    fragments = text.split("}")
    cuts = sorted(r.randrange(len(fragments) + 1) for _ in range(blocks - 1))
    state, depth, rows = 0, 0, []
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(fragments)], strict=True)):
        block = [f + "}" for f in fragments[a:b]]
        cutter = Cutter(state, depth)
        while block:
            k = r.randrange(1, len(block) + 1)
            rows += [("whole" if own else "goes on", x) for own, x in cutter.feed("".join(block[:k]))]
            block = block[k:]
        rest = cutter.finish() if a < b else None
        if rest:
            rows.append(("starts" if rest[0] else "goes on", rest[1]))
        text = "".join(f + "}" for f in fragments[a:b])
        after = [advance(s, text) for s in range(3)]
        state, depth = after[state][0], depth + after[state][1]
    out = []
    for kind, x in rows:
        if kind == "goes on":
            out[-1] += x
        else:
            out.append(x)
    return out


def test_any_cut_gives_the_elements():
    r = random.Random(1)
    for n in range(150):
        records = [an_object(r) for _ in range(r.randrange(8))]
        for text in layouts(records):
            assert [json.loads(x) for x in pieces_of(text, r, 1 + n % 9)] == records


def test_states_add_up():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice('"\\{}[]a,') for _ in range(r.randrange(30)))
        cut = r.randrange(len(text) + 1)
        for start in range(3):
            middle, first = advance(start, text[:cut])
            assert advance(start, text) == (lambda e: (e[0], first + e[1]))(advance(middle, text[cut:]))


@pytest.mark.parametrize("text", ['{"id": 1}', "[1]", '["x"]', "[[1]]", '[{"a": 1} x]', "[null]", 'x [{"a": 1}]'])
def test_what_is_no_array_of_objects(text):
    with pytest.raises(ValueError):
        pieces_of(text, random.Random(3), 1)


def test_files_in_many_blocks(spark, tmp_path):
    r = random.Random(4)
    records = [an_object(r) | {"id": n} for n in range(400)] + [{"id": 400, "long": "} \\\" { " * 3000}, {"id": 401}]
    for n, text in enumerate(layouts(records)):
        (tmp_path / f"{n}.json").write_text(text)
    (tmp_path / "none.json").write_text("[ ]")
    (tmp_path / "empty.json").write_text("")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = read_elements(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 20
        rows = sorted(found.collect(), key=lambda x: x["seq"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [json.loads(x["text"]) for x in rows] == records * 3
    assert len({x["seq"] for x in rows}) == len(rows) and len({x["seq"]["block"] for x in rows}) > 20
    by_spark = spark.read.option("multiLine", True).schema("id long").json(str(tmp_path / "1.json"))
    assert [x["id"] for x in by_spark.collect()] == [json.loads(x["text"])["id"] for x in rows if "1.json" in x["seq"]["file"]]


def test_a_path_with_nothing_in_it(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert json_array.read_elements(spark, str(tmp_path)).count() == 0
