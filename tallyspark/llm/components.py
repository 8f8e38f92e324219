"""Connected components of a link table by hooking and pointer jumping, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `links` (a, b) reaches.

    Each round hooks every node to its smallest neighbour, jumps pointers until they end in roots, and keeps
    only the links between different roots. Every table is checkpointed before it is joined, so that both sides
    of a join are dealt anew and a root with very many nodes can be split. Null ends and self links are ignored;
    an empty table gives an empty result.
    """
    edges = checkpointed(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("root")))
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = checkpointed(parents.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = checkpointed(labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        tops = [parents.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
        edges = checkpointed(
            edges.join(tops[0], "a").join(tops[1], "b").where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
