"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.session import kept


def _flat(hooks: DataFrame) -> DataFrame:
    """Follow (node, root) until each root is its own root; doubles the steps with each pass."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = kept(
            hooks.join(up, "root", "left").select(
                "node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved")
            )
        )
        hooks = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, flattens the hooks and contracts the
    links to the roots, so the graph at least halves.  A node with very many neighbours only meets
    a minimum, which is combined before the shuffle.  Null ends and loops are ignored.
    """
    links = kept(links.where("a <> b").select("a", "b").distinct())
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _flat(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = kept(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = kept(
            links.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        )
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
