"""Connected components of a link table by contraction: each round hangs every node under its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from motorlot.llm.store import saved


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root) for every node with a link; root is the smallest node it reaches.

    Each round gives every node its smallest neighbour as parent, follows parents twice, and renames the links by the
    result, so at least half of the nodes with links vanish. A node with very many links is one row of a minimum that is
    taken before the shuffle, and Spark splits it in joins. Tables of every round are written, so nothing is computed
    again. An empty table gives an empty result; loops and repeated links do no harm.
    """
    links = saved(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parents = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        step = lambda node, up: parents.select(F.col("node").alias(node), F.col("up").alias(up))  # noqa: B023, E731
        parents = saved(step("node", "x").join(step("x", "y"), "x").join(step("y", "up"), "y").select("node", "up"), "parents")
        left, right = parents.select(F.col("node").alias("a"), F.col("up").alias("x")), parents.select(F.col("node").alias("b"), F.col("up").alias("y"))
        links = saved(links.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if roots is None:
            roots = parents.select("node", F.col("up").alias("root"))
        else:
            roots = saved(roots.join(parents.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
