import random
from collections import defaultdict

import public_tokenizers
import pytest

from curioshelf.llm import packing
from curioshelf.llm.queries import QUERIES
from curioshelf.llm.tokens import tokenizer


@pytest.mark.parametrize("seed", range(60))
def test_tightest_compatible_bin(seed):
    """Each document is in the tightest bin that takes it, or a new one if none does."""
    r = random.Random(seed)
    capacity = r.choice([1, 7, 20, 64, 100])
    sizes = sorted((r.randrange(capacity + 1) for _ in range(r.randrange(1, 90))), reverse=True)
    sources = [r.choice([None, *range(r.randrange(1, 9))]) for _ in sizes]
    clusters = [r.choice([None, *range(30)]) for _ in sizes]
    bins = {}
    for (b, at), size, source, cluster in zip(packing.pack_shard(sizes, sources, clusters, capacity), sizes, sources, clusters, strict=True):
        takes = lambda x: 0 < x[0] >= size and (source is None or source not in x[1]) and (cluster is None or cluster not in x[2])  # noqa: B023, E731
        fit = [x[0] for x in bins.values() if takes(x)]
        if b in bins:
            assert takes(bins[b]) and bins[b][0] == min(fit) and at == capacity - bins[b][0]
        else:
            assert not fit and at == 0
            bins[b] = [capacity, set(), set()]
        bins[b][0] -= size
        bins[b][1].add(source)
        bins[b][2].add(cluster)


def check(rows, items, capacity):
    bins, pieces = defaultdict(list), defaultdict(list)
    for doc, chunk, size, b, start in rows:
        bins[b].append((start, size, doc))
        pieces[doc].append((chunk, size))
    for held in bins.values():
        end = 0
        for start, size, _ in sorted(held):
            assert start >= end
            end = start + size
        assert end <= capacity
        docs = [items[d] for _, _, d in held]
        for k in (1, 2):
            known = [d[k] for d in docs if d[k] is not None]
            assert len(known) == len(set(known))
    for doc, (length, _, _) in items.items():
        sizes = [s for _, s in sorted(pieces[doc])]
        assert sum(sizes) == max(length or 0, 0) and all(s == capacity for s in sizes[:-1]) and sizes


@pytest.mark.parametrize("shard_items", [5, 10_000])
def test_table(spark, monkeypatch, shard_items):
    monkeypatch.setattr(packing, "SHARD_ITEMS", shard_items)
    r = random.Random(1)
    items = {i: (r.choice([None, -3, 0, 1, 64, 65, 200, r.randrange(64)]), r.choice([None, "hot", "hot", "b", "c"]), r.choice([None, 1, r.randrange(99)])) for i in range(200)}
    frame = spark.createDataFrame([(i, *x, "clash", 1) for i, x in items.items()], "doc_id long, length long, source string, cluster long, bin_id string, shard int")
    got = packing.pack(frame, 64)
    assert got.columns == ["doc_id", "chunk", "size", "bin_id", "start"]
    check(list(map(tuple, got.collect())), items, 64)


def test_documents(odd_docs):
    packed = packing.pack(packing.as_items(odd_docs))
    encode = tokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer.encode
    want = sum(len(encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert packed.agg({"size": "sum"}).first()[0] == want
    assert packed.where("doc_id = 9").count() > 10 and packed.where("doc_id = 5").count() == 2
    assert packing.pack(packing.as_items(odd_docs.limit(0))).count() == 0


def test_bins_hold_real_ids(spark, docs_of):
    """Bins are filled with the ids of the library, and those of no bin exceed the capacity."""
    encode = tokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer.encode
    texts = [None, "", "<|endoftext|> x", "zq jx vk " * 700, *["Qz%d xk-vv, é日 " % i * (40 * i + 1) for i in range(30)]]
    ids = {i: [*encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert any(len(x) > packing.CAPACITY >= len(texts[i] or "") / 4 + 2 for i, x in ids.items())
    frame = docs_of(list(enumerate(texts))).drop("source").selectExpr("*", "cast(doc_id as string) source")
    bins, lengths = defaultdict(int), defaultdict(int)
    for doc, chunk, size, b, _ in packing.pack(packing.as_items(frame)).collect():
        held = ids[doc][chunk * packing.CAPACITY : (chunk + 1) * packing.CAPACITY]
        assert size == len(held)
        bins[b] += len(held)
        lengths[doc] += len(held)
    assert max(bins.values()) <= packing.CAPACITY
    assert lengths == {i: len(x) for i, x in ids.items()}


def test_near_copies_are_one_cluster(spark, tmp_path, docs_of):
    """No bin of op9 holds two near copies, whatever their sources and doc_ids; others share bins."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:-1], f"end{i}"]) for i in range(6)]
    rows = [*enumerate(near), (None, near[0].upper()), (0, "another text of a few short words"), (7, "one more text of a few words"), (8, None), (9, "")]
    frame = docs_of(rows).drop("source").selectExpr("*", "cast(monotonically_increasing_id() as string) source")
    clusters = [(r["doc_id"], r["cluster"]) for r in packing.near_items(frame).collect()]
    groups = defaultdict(list)
    for doc, cluster in clusters:
        groups[cluster].append(doc)
    assert len(clusters) == len(rows)
    assert sorted(map(str, groups.pop(None))) == ["0", "7"]
    assert sorted(sorted(map(str, g)) for g in groups.values()) == [sorted([*"012345", "None"]), ["8", "9"]]
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    bins = defaultdict(list)
    for r in QUERIES["op9_best_fit_packing"](spark, str(tmp_path)).collect():
        bins[r["bin_id"]].append((r["doc_id"], r["size"]))
    assert len(bins) == 7 and max(map(len, bins.values())) > 1
    long = [[d for d, size in held if size > 60] for held in bins.values()]
    assert sorted(map(str, sum(long, []))) == sorted([*"012345", "None"]) and max(map(len, long)) == 1
