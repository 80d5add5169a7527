"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import SMALL, cut, meet


def follow(up: DataFrame, n: int, small: int) -> DataFrame:
    """(node, root) from (node, up), of which there are at most ``n``: every pointer followed to its end, each step doubling what it spans.

    Nodes whose pointer already ends at a root leave the loop, so a step reads only what is still on its way.
    """
    settled, moving = None, up
    while True:
        known = moving if settled is None else settled.unionByName(moving)
        step = meet(moving, known.select(F.col("node").alias("up"), F.col("up").alias("above")), ["up"], n, small=small)
        step = cut(step.select("node", F.col("above").alias("up"), (F.col("up") == F.col("above")).alias("done")))
        done = step.where("done").drop("done")
        settled = done if settled is None else settled.unionByName(done)
        moving = step.where("not done").drop("done")
        if moving.isEmpty():
            return settled.withColumnRenamed("up", "root")


def connected_components(edges: DataFrame, rounds: list[int] | None = None, small: int = SMALL) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    ``edges`` has two long columns ``a`` and ``b`` in any direction; loops and repeats do no harm.
    Each round points every node at the smallest node next to it, follows the pointers to their ends, and
    replaces each edge by the edge between its ends' roots.  A root that nobody pointed at has only smaller roots next to it in the
    following round, so two rounds at least halve what is left: at most 2 log2(n) rounds, each of at most log2(n) steps.
    Then the rounds' maps are put together from the last, which is the smallest, to the first.  Tables are written
    between steps, so neither lineage nor size estimates grow; a node that a large part of the rows name, and any
    table of at most ``small`` rows, is met by broadcast (:func:`meet`).  The driver sees counts and such nodes' names.  ``rounds`` gets the number of edges of each round.
    """
    pairs = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps, sizes = [], [] if rounds is None else rounds
    while n := pairs.count():
        sizes.append(n)
        # every node's smallest neighbour, itself included: partial minima are taken before the shuffle
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("up")), F.struct(F.col("b").alias("node"), F.col("a").alias("up")))).alias("e")).select("e.*")
        top = follow(cut(ends.groupBy("node").agg(F.min("up").alias("up"))), 2 * n, small)
        maps.append(top)
        moved = cut(meet(pairs, top.select(F.col("node").alias("a"), F.col("root").alias("ta")), ["a"], 2 * n, small=small))
        moved = meet(moved, top.select(F.col("node").alias("b"), F.col("root").alias("tb")), ["b"], 2 * n, small=small)
        pairs = cut(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not maps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = maps.pop()
    for n in sizes[-2::-1]:
        lower = cut(meet(maps.pop(), labels.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], 2 * n, "left", small=small))
        labels = lower.select("node", F.coalesce("top", "root").alias("root"))
    return labels
