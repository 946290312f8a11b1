"""Exact top-k search by inner product with sequential access only (no random access).

Candidates are dealt in groups, and each group meets each block of queries once.  Within a group,
slices of candidates have one list per component, sorted by value; a query reads a list from its
large end where its own component is positive, else from its small end.  All lists are read to the
same depth.  What has been read gives each candidate a lower and an upper bound of its score:
components not yet read lie between the list's far end and the last value read.  A query stops on a
slice once few candidates have an upper bound that reaches its k-th best lower bound; their final
scores are then resolved.  The k-th best score so far is carried from slice to slice.  Bounds of all
queries and candidates of a slice are two matrix products at each depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
GROUP = 8192
QUERY_BLOCK = 1024
SLICE = 2048
DEPTHS = (0.25, 0.5, 0.75)
FEW = 64


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole numbers floor(SCALE * x); shorter vectors are filled up with zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None] < lengths[:, None]] = np.floor(SCALE * lists.flatten().to_numpy().astype(np.float64))
    return out


def _kind(queries: np.ndarray, vectors: np.ndarray):
    """The cheapest number type in which all sums are exact."""
    most = float((np.abs(queries).max(0, initial=0) * np.abs(vectors).max(0, initial=0)).sum()) * 2
    if most >= 2**63:
        raise ValueError("scores may pass 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_group(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K):
    """For each query the k best (scores, ids) among ``vectors``, without those of its own id."""
    kind = _kind(queries, vectors)
    none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf  # below every score
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    signed = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1)
    found = [(np.zeros(0, kind), np.zeros(0, np.int64)) for _ in queries]
    for at in range(0, len(vectors), SLICE):
        x, names = vectors[at : at + SLICE], ids[at : at + SLICE]
        n = len(x)
        order = np.argsort(x, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        ends = np.concatenate((x.min(0), x.max(0)))  # of what a list can still hold at worst
        going = np.arange(len(queries))
        for depth in (*DEPTHS, 1):
            r = max(1, int(n * depth))
            seen = np.concatenate((place >= n - r, place < r), axis=1)
            low = np.take_along_axis(x, order[[n - r]], axis=0)[0]
            high = np.take_along_axis(x, order[[r - 1]], axis=0)[0]
            front = np.concatenate((low, high))  # the last values read
            twice = np.concatenate((x, x), axis=1)
            q = signed[going]
            upper = (q @ front)[:, None] + q @ np.where(seen, twice - front, 0).T
            lower = (q @ ends)[:, None] + q @ np.where(seen, twice - ends, 0).T
            same = own[going, None] == names[None]
            lower[same] = none
            bar = np.array([found[i][0][k - 1] if len(found[i][0]) == k else none for i in going], kind)
            if n > k:
                bar = np.maximum(bar, np.partition(lower, n - k, axis=1)[:, n - k])
            alive = (upper >= bar[:, None]) & ~same
            number = alive.sum(1)
            done = (number <= FEW) | (depth == 1)
            for row in np.flatnonzero(done):
                i, some = going[row], np.flatnonzero(alive[row])
                if len(some):
                    scores = upper[row, some] if depth == 1 else x[some] @ queries[i]
                    found[i] = _best(np.concatenate((found[i][0], scores)), np.concatenate((found[i][1], names[some])), k)
            going = going[~done]
            if not len(going):
                break
    return found


def _search(left: pa.Table, right: pa.Table) -> pa.Table:
    columns: dict[str, list] = {"query_id": [], "query_no": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        width = max(int(np.max(t["embedding"].combine_chunks().value_lengths().to_numpy())) for t in (left, right))
        own = right["vec_id"].to_numpy()
        found = search_group(_matrix(right["embedding"], width), own, _matrix(left["embedding"], width), left["vec_id"].to_numpy())
        for i, (scores, ids) in enumerate(found):
            columns["query_id"] += [int(own[i])] * len(ids)
            columns["query_no"] += [right["query_no"][i].as_py()] * len(ids)
            columns["vec_id"] += ids.tolist()
            columns["score"] += [int(s) for s in scores]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})


def top_k(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The K best ``vectors`` (vec_id, embedding) for each of ``queries`` (same columns).

    Returns query_id, rank from 1, vec_id, score; score is the inner product of floor(256 * x), ties
    go to the smaller vec_id, a row of the query's own vec_id is no candidate.  Vectors that are
    null, empty or hold nulls, NaN or infinities take no part, nor do rows with a null vec_id.
    Vectors of different lengths meet as if filled up with zeros.  Candidates that repeat count each;
    equal query rows are one query.  Other columns are not looked at.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", good)
    vectors = vectors.select("vec_id", "embedding").where(sound)
    queries = queries.select("vec_id", "embedding").where(sound).withColumn("query_no", F.xxhash64("embedding")).dropDuplicates(["vec_id", "query_no"])
    groups = -(-vectors.count() // GROUP) or 1
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("group", dealt(groups)).withColumn("block", each(blocks))
    right = queries.withColumn("block", dealt(blocks)).withColumn("group", each(groups))
    met = left.groupBy("group", "block").cogroup(right.groupBy("group", "block"))
    best = met.applyInArrow(_search, "query_id long, query_no long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)
    return ranked.select("query_id", "rank", "vec_id", "score")
