"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.session import saved


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node, component` for every node of `links`; a component is named by its smallest node.

    Each round points every node at its smallest neighbour, if smaller, follows that pointer once more, and replaces the
    links by those between the nodes pointed at, without loops and repeats. Every node with links that does not move has
    a neighbour that may move to it, so nodes shrink geometrically, and a dense group is gone after a round or two.
    Minima and repeats are folded before each shuffle; the joins that bring pointers to links may be split by adaptive
    skew handling. Each round is a written table, so a lost executor costs no more than one round.

    Links with a null end and from a node to itself are ignored; an empty table gives no rows.
    """
    named = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    edges = saved(named.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    labels = None
    while True:
        low = edges.union(edges.select("y", "x")).groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low"))
        once = saved(low.select("node", F.least("node", "low").alias("to")), "pointers")
        twice = once.alias("p").join(once.alias("q"), F.col("p.to") == F.col("q.node"))
        moved = saved(twice.select("p.node", F.col("q.to").alias("to")), "pointers")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("component"))
        else:
            after = labels.join(moved.select(F.col("node").alias("component"), "to"), "component", "left")
            labels = saved(after.select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = edges.join(moved.select(F.col("node").alias("x"), F.col("to").alias("a")), "x")
        ends = ends.join(moved.select(F.col("node").alias("y"), F.col("to").alias("b")), "y").where("a <> b")
        edges = saved(ends.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "links")
        if edges.isEmpty():
            return labels
