"""N-gram Jaccard join by vertical partitioning.

The hashes of all shingles have one global order, cut into fragments.  Each document's set is cut
the same way, and a fragment is worked on by itself: it counts in how many different sets each of
its shingles occurs, and it counts its part of the overlap of each candidate pair.  The parts are
then summed per pair.

1. A set is known by a 64-bit hash; documents with equal sets are one node from here on.
2. Fragments count set frequencies.  The global order is (frequency, fragment, rank in it).  Two
   sets with Jaccard >= t share a shingle among the first ``n - ceil(t n) + 1`` of either.  Shingles
   of one set only come first and match nothing, so most sets are out at once.
3. Each list of nodes with one prefix shingle is a star around a leader (chosen by hash, so that
   lists of one group have several).  Stars are counted exactly, twice, and linked nodes joined up.
4. What is left are pairs in one list but in different components.  Short lists give them as rows.
   Long lists are cut in blocks of nodes; each pair of blocks is one tile whose partial counts stay
   packed, and a tile gives no more links than join it up.  No group is written out as pairs.

No link is lost: a pair in one list either is in one component or is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.llm.components import components
from curioshelf.llm.shingles import mix, shingle_sets
from curioshelf.session import kept

FRAGMENT_SHINGLES = 2_000_000
BUCKET_SHINGLES = 8_000_000
PARTS = 8
SHORT_LIST = 32
BLOCK = 256
STARS = 2
LEADERS = 4


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """The hash of each set; none may be empty."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    return mix(np.add.reduceat(mix(np.concatenate(sets)), starts)).view(np.int64)


def _groups(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """The sets of the texts, in lists with about ``size`` shingles."""
    held, n = [], 0
    for found in shingle_sets(texts):
        held.append(found)
        n += len(found)
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def sets_of(texts: pa.Array) -> list[pa.Array]:
    """Number of shingles of each text, and the hash of its set, null if the set is empty."""
    sizes, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for sets in _groups(texts, 1 << 16):
        sizes.append(np.array([len(s) for s in sets]))
        nodes.append(np.zeros(len(sets), np.int64))
        full = np.flatnonzero(sizes[-1])
        if len(full):
            nodes[-1][full] = _set_ids([sets[i] for i in full])
    size = np.concatenate(sizes)
    return [pa.array(size, pa.int64()), pa.array(np.concatenate(nodes), pa.int64(), mask=size == 0)]


def set_ids(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node): node is the hash of the set, null if the set is empty."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *sets_of(batch.column(1))], ["doc_id", "n_shingles", "node"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long")


def _cut(documents: DataFrame, fragments: int) -> DataFrame:
    """One row per fragment and run of documents: nodes, shingles of each node, shingles."""
    kind = np.uint8 if fragments <= 1 << 8 else np.uint16 if fragments <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            seen: set[int] = set()  # a set is sent once per batch
            nodes, sets, held = [], [], 0
            for group in _groups(batch.column(0), 1 << 16):
                group = [s for s in group if len(s)]
                for node, found in zip(_set_ids(group).tolist() if group else [], group, strict=True):
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(found)
                        held += len(found)
                if held > 1 << 20:
                    yield packed(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield packed(nodes, sets)

    def packed(nodes, sets):
        # A fragment is a range of hashes, so a sorted set has what is in it in a row.
        sizes, tokens = np.array([len(s) for s in sets], np.int32), np.concatenate(sets)
        place = ((tokens >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(kind)
        order = np.argsort(place, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        ends = np.cumsum(np.bincount(place, minlength=fragments))
        nodes, rows, start = np.array(nodes, np.int64), [], 0
        for f, end in enumerate(ends.tolist()):
            if end > start:
                at = np.flatnonzero(np.diff(owner[start:end], prepend=-1))
                own, counts = owner[start + at], np.diff(at, append=end - start).astype(np.int32)
                rows.append((f, nodes[own].tobytes(), sizes[own].tobytes(), counts.tobytes(), tokens[start:end].tobytes()))
            start = end
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))],
            ["frag", "nodes", "sizes", "counts", "tokens"],
        )

    return documents.select("text").mapInArrow(run, "frag int, nodes binary, sizes binary, counts binary, tokens binary")


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(c for c in table[name].to_pylist()), kind)


def _count_fragment(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one fragment: for each node its shingles that other nodes have too, by rank, and the
        number of nodes that have each; packed by bucket of nodes."""
        frag = table["frag"][0].as_py()
        rows = []
        for bucket, (nodes, sizes, counts, ranks, often) in enumerate(_shared(table, buckets)):
            if len(nodes):
                rows.append((bucket, frag, nodes.tobytes(), sizes.tobytes(), counts.astype(np.int32).tobytes(), ranks.tobytes(), often.astype(np.int32).tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        out = pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "frag", "nodes", "sizes", "counts", "ranks", "often"])
        pa.default_memory_pool().release_unused()
        return out

    return run


def _shared(table: pa.Table, buckets: int):
    nodes, sizes, counts = _joined(table, "nodes", np.int64), _joined(table, "sizes", np.int32), _joined(table, "counts", np.int32)
    tokens = _joined(table, "tokens", np.uint64)
    first = np.zeros(len(nodes), bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    if not first.all():
        tokens = tokens[np.repeat(first, counts)]
        nodes, sizes, counts = nodes[first], sizes[first], counts[first]
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    del ordered, tokens
    at = np.flatnonzero(new)
    often = np.diff(np.concatenate((at, [len(new)])))
    rank = np.cumsum(new, dtype=np.int32) - 1
    ranks = np.empty(len(rank), np.int32)
    ranks[order] = rank
    shared = often[ranks] > 1
    owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)[shared]
    ranks, often = ranks[shared], often[ranks[shared]]
    left = np.bincount(owner, minlength=len(nodes))
    place = np.where(left > 0, (mix(nodes.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), -1)
    for bucket in range(buckets):
        own = place == bucket
        mine = own[owner]
        yield nodes[own], sizes[own], left[own], ranks[mine], often[mine]


SEGMENT = "bucket int, frag int, nodes binary, sizes binary, counts binary, ranks binary, often binary"
SETS = "node long, n int, lone int, first array<long>, parts array<array<long>>"


def _gather(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket of nodes: the sets that can be similar to another at all.

        lone: shingles of no other set, the first in order; first: what else of the set's first
        shingles is to be looked at; parts: all shared shingles, by fragment."""
        nodes, sizes, counts = _joined(table, "nodes", np.int64), _joined(table, "sizes", np.int32), _joined(table, "counts", np.int32)
        blocks = np.array([len(c) // 4 for c in table["ranks"].to_pylist()])
        names = np.repeat(table["frag"].to_numpy().astype(np.int64) << 32, blocks) | _joined(table, "ranks", np.int32)
        known, index = np.unique(nodes, return_inverse=True)
        n = np.zeros(len(known), np.int32)
        n[index] = sizes
        lone = (n - np.bincount(index, weights=counts, minlength=len(known))).astype(np.int32)
        prefix = n - -(-n.astype(np.int64) * percent // 100) + 1
        alive = lone < prefix
        owner = np.repeat(index, counts)
        keep = alive[owner]
        owner, names, often = owner[keep], names[keep], _joined(table, "often", np.int32)[keep]
        order = np.lexsort((names, often, owner))
        owner, names = owner[order], names[order]
        out: dict[str, list] = {"first": [], "parts": []}
        ends = np.cumsum(np.bincount(owner, minlength=len(known))) if len(known) else np.zeros(0, np.int64)
        for k in np.flatnonzero(alive):
            own = names[(ends[k - 1] if k else 0) : ends[k]]
            part = (own >> 32) % PARTS
            out["first"].append(own[: prefix[k] - lone[k]])
            out["parts"].append([own[part == p] for p in range(PARTS)])
        found = {"node": pa.array(known[alive]), "n": pa.array(n[alive]), "lone": pa.array(lone[alive])}
        found |= {"first": pa.array(out["first"], pa.list_(pa.int64())), "parts": pa.array(out["parts"], pa.list_(pa.list_(pa.int64())))}
        result = pa.table(found)
        pa.default_memory_pool().release_unused()
        return result

    return run


def _close(a: str, b: str, percent: int) -> F.Column:
    """Whether the sizes allow the similarity."""
    return F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * percent


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, na, b, nb) that are similar: partial overlaps by fragment,
    summed per pair."""
    left = sets.select(F.col("node").alias("a"), F.col("parts").alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("parts").alias("xb"))
    parts = F.zip_with("xa", "xb", lambda x, y: F.size(F.array_intersect(x, y)))
    total = F.aggregate(parts, F.lit(0), lambda acc, part: acc + part).cast("long")
    met = pairs.join(left, "a").join(right, "b").select("a", "na", "b", "nb", total.alias("both"))
    return met.where(F.col("both") * 100 >= (F.col("na").cast("long") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _with_roots(postings: DataFrame, roots: DataFrame) -> DataFrame:
    return postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _stars(postings: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of each list's leader with those of its nodes that are in another component."""
    key = F.xxhash64("node", F.pmod(F.xxhash64("shingle"), F.lit(LEADERS)), F.lit(seed))
    leaders = postings.groupBy("shingle").agg(F.min(F.struct(key.alias("key"), "node", "n", "root")).alias("lead"))
    leaders = leaders.select("shingle", F.col("lead.node").alias("l"), F.col("lead.n").alias("nl"), F.col("lead.root").alias("lroot"))
    found = postings.join(leaders, "shingle").where((F.col("root") != F.col("lroot")) & _close("n", "nl", percent))
    swap = F.col("node") < F.col("l")
    return found.select(
        F.when(swap, F.col("node")).otherwise(F.col("l")).alias("a"),
        F.when(swap, F.col("n")).otherwise(F.col("nl")).alias("na"),
        F.when(swap, F.col("l")).otherwise(F.col("node")).alias("b"),
        F.when(swap, F.col("nl")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def _short(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in short lists, unless their places in it rule them out: at the
    first common shingle no more can be shared than what follows it in either set."""
    side = lambda x: postings.select("shingle", F.col("node").alias(x), F.col("n").alias("n" + x), F.col("root").alias("r" + x), F.col("place").alias("p" + x))
    most = F.least(F.expr("na - pa"), F.expr("nb - pb")).cast("long")
    enough = most * (100 + percent) >= (F.col("na").cast("long") + F.col("nb")) * percent
    met = side("a").join(side("b"), "shingle").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _close("na", "nb", percent) & enough)
    return met.select("a", "na", "b", "nb").distinct()


def _tile_links(percent: int):
    def overlaps(table: pa.Table, rows: list[np.ndarray]) -> np.ndarray:
        """Overlaps of the nodes of both sides: partial counts by fragment, added up."""
        total = np.zeros(len(rows[0]) * len(rows[1]), np.int64)
        parts = table["parts"].combine_chunks()
        for part in range(PARTS):
            sides = []
            for own in rows:
                lists = pc.list_element(parts.take(pa.array(own)), part)
                tokens, owners = lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
                order = np.argsort(tokens, kind="stable")
                sides.append((tokens[order], owners[order]))
            (ta, oa), (tb, ob) = sides
            low = np.searchsorted(tb, ta)
            met = np.searchsorted(tb, ta, "right") - low
            bounds = np.concatenate(([0], np.cumsum(met)))
            at = 0
            while at < len(ta):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 2_000_000, "right")) - 1)
                own = np.repeat(np.arange(at, to), met[at:to])
                other = np.arange(len(own)) - np.repeat(bounds[at:to] - bounds[at], met[at:to]) + low[own]
                total += np.bincount(oa[own] * len(rows[1]) + ob[other], minlength=len(total))
                at = to
        return total.reshape(len(rows[0]), len(rows[1]))

    def run(table: pa.Table) -> pa.Table:
        """Links of one tile that join up what is similar and in different components: no more than
        there are nodes."""
        node, n, root, side = (table[c].to_numpy() for c in ("node", "n", "root", "side"))
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        both = overlaps(table, rows)
        (ra, rb), (sa, sb) = (root[r] for r in rows), (n[r].astype(np.int64) for r in rows)
        fit = (both * 100 >= (sa[:, None] + sb[None] - both) * percent) & (ra[:, None] != rb[None])
        up: dict[int, int] = {}

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(fit), strict=True):
            x, y = top(int(ra[i])), top(int(rb[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(node[rows[0][i]]), int(node[rows[1][j]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _tiles(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in long lists, tile by tile."""
    heads = postings.groupBy("shingle").agg(F.min("node").alias("b"))
    group = components(postings.join(heads, "shingle").select(F.col("node").alias("a"), "b")).withColumnRenamed("root", "cluster")
    blocks = group.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = postings.select("node", "n", "root").distinct().join(group, "node").join(blocks, "cluster")
    placed = kept(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    held = postings.join(placed.select("node", "cluster", "block"), "node").select("shingle", "cluster", "block").distinct()
    other = held.select("shingle", F.col("block").alias("block2"))
    tiles = held.join(other, "shingle").where("block <= block2").select("cluster", "block", "block2").distinct()
    name = F.concat_ws(" ", "cluster", "block", "block2").alias("tile")
    first = tiles.select("cluster", "block", name, F.lit(0).alias("side"))
    second = tiles.select("cluster", F.col("block2").alias("block"), name, F.lit(1).alias("side"))
    members = first.unionByName(second).join(placed, ["cluster", "block"]).join(sets.select("node", "parts"), "node")
    return members.select("tile", "side", "node", "n", "root", "parts").groupBy("tile").applyInArrow(_tile_links(percent), "a long, b long")


def set_roots(documents: DataFrame, total: int, percent: int = 75) -> DataFrame:
    """(node, root) of every set that links with another: root is one for each near-duplicate class.
    ``total`` is the number of shingles of all ``documents`` (text)."""
    segments = _cut(documents, max(PARTS, -(-total // FRAGMENT_SHINGLES)))
    buckets = max(PARTS, -(-total // BUCKET_SHINGLES))
    shared = segments.groupBy("frag").applyInArrow(_count_fragment(buckets), SEGMENT)
    sets = kept(shared.groupBy("bucket").applyInArrow(_gather(percent), SETS))
    postings = sets.select("node", "n", "lone", F.posexplode("first").alias("pos", "shingle"))
    postings = postings.select("node", "n", "shingle", (F.col("lone") + F.col("pos")).alias("place"))
    lists = postings.groupBy("shingle").agg(F.count("*").alias("length"))
    postings = kept(postings.join(lists.where("length > 1"), "shingle"))

    links, rooted = None, postings.withColumn("root", F.col("node"))
    for seed in range(STARS):
        found = kept(_overlaps(_stars(rooted, seed, percent), sets, percent))
        links = found if links is None else links.unionByName(found)
        rooted = kept(_with_roots(postings, components(links)))
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle")
    rooted = kept(rooted.join(mixed, "shingle", "left_semi"))
    links = links.unionByName(_overlaps(_short(rooted.where(F.col("length") <= SHORT_LIST), percent), sets, percent))
    long = rooted.where(F.col("length") > SHORT_LIST)
    if not long.isEmpty():
        links = links.unionByName(_tiles(long, sets, percent))
    return components(links)


def ngram_join(documents: DataFrame, percent: int = 75) -> DataFrame:
    """Near-duplicate classes of ``documents`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least
    ``percent`` / 100.  component_id is the smallest doc_id that links reach.  Null and empty texts
    have no shingles and link with nothing.  Rows that repeat, doc_id included, each give a row; a
    null doc_id counts as no smallest id.  An empty table gives an empty result.  Other columns are
    not looked at.
    """
    docs = kept(set_ids(documents))
    total = docs.agg(F.sum("n_shingles")).first()[0] or 0
    roots = set_roots(documents, total, percent)
    known = docs.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.select("node", "root").join(least, "root").select("node", "component_id")
    return docs.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
