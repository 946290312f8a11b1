"""Merkle manifest of a dataset: a tree of hashes per source, one over the sources, and proofs.

A row's leaf is the hash of its fields.  The leaves of a source, by doc_id, are joined in runs of FAN
until one node is left, the source's subroot; the subroots, by source, are joined likewise to the
root.  A proof holds the siblings of a leaf and of all nodes above it; folding it with the leaf gives
the root again, unless the row was changed.

Trees are worked on in superblocks of BLOCK consecutive nodes, which are LEVELS levels of a tree:

* Up: each superblock is reduced to one node.  These nodes are the leaves of the next stage, BLOCK
  times fewer, and so on until each tree has one superblock.
* Down: what a superblock needs from outside are the siblings above it, one row a level.  From the
  last stage to the first, the nodes of each superblock are cogrouped with these outer rows, which
  gives the outer rows of the superblocks below.
* At the leaves the same exchange ends it: one cogrouped call in applyInPandas does a superblock's
  local reduction, joins the local siblings with the outer ones, and folds.

A superblock is bounded, so a source with any share of the rows is just more superblocks.  Leaves
travel as hashes; texts are read once and are never shuffled.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curioshelf.operators.ranking import grouped_rank
from curioshelf.session import kept

FAN = 16
LEVELS = 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_OUTER = "tree string, block long, step int, before string, after string, lone boolean"
_TOP_STEPS = 1000  # steps of the tree over the sources follow those of a source's tree
_ENDS = -1  # step of the row that holds the subroot and the root


def field(value: Column) -> Column:
    """A field as it enters the hash: ``-`` for null, else its length in bytes, ``:``, the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """Hash of a row's FIELDS; ``changed`` gives other values for some of them."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], lone: bool) -> list[list[str]]:
    """The nodes of a superblock, level by level up to its one top node.  The only superblock of its
    tree ends where one node is left; any other has all its levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if lone else len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([_joined(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after a node and its ancestors in their runs, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % FAN
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])))
        at //= FAN
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The top that a node and its siblings lead to."""
    for before, after in path:
        node = sha256((before + node + after).encode()).hexdigest()
    return node


def _reduced(rows: pd.DataFrame) -> pd.DataFrame:
    nodes = rows.sort_values("pos")["hash"].tolist()
    tops = [levels_of(nodes, lone)[-1][0] for lone in (True, False)]
    return pd.DataFrame({"tree": rows["tree"].iloc[:1], "block": rows["block"].iloc[:1], "closed": tops[:1], "open": tops[1:]})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def raised(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (tree, pos from 0, hash): (nodes of each stage, the top of each tree).

    Every stage is written, BLOCK times smaller than the one before.  Only the number of the last
    superblock comes to the driver."""
    stages, tops = [nodes], None
    while True:
        grouped = _blocked(stages[-1].select("tree", "pos", "hash")).groupBy("tree", "block")
        reduced = kept(grouped.applyInPandas(_reduced, "tree string, block long, closed string, open string"))
        trees = reduced.groupBy("tree").agg(F.max("block").alias("last"), F.min("closed").alias("top"))
        done = trees.where("last = 0").select("tree", "top")
        tops = done if tops is None else tops.unionByName(done)
        if not reduced.agg(F.max("block")).first()[0]:
            return stages, kept(tops)
        more = trees.where("last > 0").select("tree")
        stages.append(kept(reduced.join(more, "tree", "left_semi").select("tree", F.col("block").alias("pos"), F.col("open").alias("hash"))))


def _path(outer: pd.DataFrame) -> list[tuple[str, str]]:
    steps = outer[outer["step"] != _ENDS].sort_values("step")
    return list(zip(steps["before"], steps["after"], strict=True))


def _handed(stage: int):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Outer rows for each node of a superblock, which is a superblock of the stage below."""
        nodes = nodes.sort_values("pos")
        tree, rows = nodes["tree"].iloc[0], []
        levels = levels_of(nodes["hash"].tolist(), bool(outer["lone"].iloc[0]))
        above = list(zip(outer["step"], outer["before"], outer["after"], strict=True))
        for at, pos in enumerate(nodes["pos"]):
            own = [(stage * LEVELS + k, *pair) for k, pair in enumerate(siblings(levels, at))]
            rows += [(tree, pos, *step, False) for step in own + above]
        return pd.DataFrame(rows, columns=["tree", "block", "step", "before", "after", "lone"])

    return run


def lowered(stages: list[DataFrame], above: DataFrame, first: int = 0) -> DataFrame:
    """The outer rows of every superblock of the first stage.  ``above`` has them for the only
    superblock of the last stage of each tree (tree, step, before, after)."""
    ends, outer = above.select("tree", F.lit(0).cast("long").alias("block"), "step", "before", "after", F.lit(True).alias("lone")), None
    for k in range(len(stages) - 1, -1, -1):
        # Trees that end at this stage take what stands above them, the others what was handed down.
        here = ends if k + 1 == len(stages) else ends.join(stages[k + 1].select("tree").distinct(), "tree", "left_anti")
        if 0 < k:
            here = here.join(stages[k].select("tree").distinct(), "tree", "left_semi")
        outer = here if outer is None else here.unionByName(outer)
        if k:
            met = _blocked(stages[k]).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
            outer = kept(met.applyInPandas(_handed(first + k), _OUTER))
    return outer


def _whole(stages: list[DataFrame], above: DataFrame, first: int) -> DataFrame:
    """The siblings of every node of the first stage, all the way up (tree, block, step, before,
    after), block being the node's place."""
    met = _blocked(stages[0]).groupBy("tree", "block").cogroup(lowered(stages, above, first).groupBy("tree", "block"))
    return met.applyInPandas(_handed(first), _OUTER)


def _finished(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    leaves = leaves.sort_values("pos")
    nodes = leaves["hash"].tolist()
    levels, above = levels_of(nodes, bool(outer["lone"].iloc[0])), _path(outer)
    ends = outer[outer["step"] == _ENDS].iloc[0]
    proofs, tops = [], []
    for at, changed in enumerate(leaves["changed"]):
        path = siblings(levels, at) + above
        proofs.append(_joined([s for pair in path for s in pair]))
        tops.append(folded(nodes[at] if changed is None else changed, path))
    out = pd.DataFrame({"doc_id": leaves["doc_id"].tolist(), "leaf": nodes, "subroot": ends["before"], "root": ends["after"], "proof_sha256": proofs, "folded_root": tops})
    return out.assign(verified=out["folded_root"] == out["root"])


def tampered(documents: DataFrame) -> Column:
    """Leaf of a row whose text has A-Z lowered, for the rows that the checksum of doc_id picks; null
    for all other rows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(text=F.translate("text", upper, upper.lower())))


def manifest(documents: DataFrame, changed: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``documents`` (FIELDS), and what the proof folds
    to from the row as it is now.

    ``changed`` gives the leaf of a row that is no longer what the manifest was made of, null for any
    other row; none have changed if it is not given.  Returns doc_id, leaf, subroot, root,
    proof_sha256 (hash of all siblings, upwards, left to right), folded_root, verified.

    Null fields have a hash of their own.  Rows with a null source form the first tree.  Null doc_ids
    come first in a tree; rows with one doc_id follow by leaf, so repeated rows have places of their
    own.  An empty table gives no rows.  Other columns are not looked at.
    """
    source = F.col("source").cast("string")
    tree = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))  # sorts as asked for
    changed = F.lit(None) if changed is None else changed
    hashed = documents.select(tree.alias("tree"), "doc_id", leaf().alias("hash"), changed.cast("string").alias("changed"))
    ranked = grouped_rank(hashed, ["tree"], [("doc_id", "asc"), ("hash", "asc")], "rank")
    # doc_id travels as text: pandas would make a float of a column with nulls.
    leaves = kept(ranked.select("tree", (F.col("rank") - 1).cast("long").alias("pos"), F.col("doc_id").cast("string").alias("doc_id"), "hash", "changed"))

    stages, subroots = raised(leaves)
    ordered = grouped_rank(subroots, [], [("tree", "asc")], "rank")
    named = kept(ordered.select(F.lit("").alias("tree"), (F.col("rank") - 1).cast("long").alias("pos"), F.col("top").alias("hash"), F.col("tree").alias("name")))
    top_stages, root = raised(named.select("tree", "pos", "hash"))
    nothing = F.lit("")
    start = root.select("tree", F.lit(_ENDS).alias("step"), nothing.alias("before"), F.col("top").alias("after"))
    found = _whole(top_stages, start, _TOP_STEPS).select(F.col("block").alias("pos"), "step", "before", "after")
    own = found.join(named.select("pos", "hash", "name"), "pos")
    above = own.select(F.col("name").alias("tree"), "step", F.when(F.col("step") == _ENDS, F.col("hash")).otherwise(F.col("before")).alias("before"), "after")

    outer = lowered(stages, kept(above))
    met = _blocked(leaves).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    done = met.applyInPandas(_finished, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))
