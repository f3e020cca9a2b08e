"""Trees and dependency graphs, walked level by level with joins.

Each level is one join of the frontier with the edges and is checkpointed, so depth and size have
no built-in limit and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlot.session import checkpointed


def tree_walk(nodes: DataFrame, node: str = "id", parent: str = "parent", name: str = "name") -> DataFrame:
    """Rows reachable from the roots with level, root name, name path and leaf flag.

    Nodes below a missing parent or inside a cycle hang off no root and are left out, as in a walk
    that starts where the parent is null.
    """
    edges = nodes.select(F.col(node).alias("_id"), F.col(parent).alias("_parent"), F.col(name).alias("_name"))
    frontier = checkpointed(edges.where(F.col("_parent").isNull()).select(
        "_id", "_name", F.lit(1).cast("long").alias("level"), F.col("_name").alias("root"), F.array("_name").alias("steps"),
        F.lit(None).cast("string").alias("_parent"),
    ))
    levels = []
    while not frontier.isEmpty():
        levels.append(frontier)
        up = frontier.select(F.col("_id").alias("_parent"), "level", "root", "steps")
        frontier = checkpointed(edges.join(up, "_parent").select(
            "_id", "_name", (F.col("level") + 1).alias("level"), "root", F.concat("steps", F.array("_name")).alias("steps"), "_parent",
        ))
    walked = levels[0] if levels else frontier
    for deeper in levels[1:]:
        walked = walked.unionByName(deeper)
    parents = edges.where(F.col("_parent").isNotNull()).select(F.col("_parent").alias("_id")).distinct()
    flagged = walked.join(parents.withColumn("_has", F.lit(True)), "_id", "left")
    return flagged.select(
        F.col("_id").alias(node), F.col("_parent").alias(parent), F.col("_name").alias(name), "level", "root", "steps",
        F.when(F.col("_has"), 0).otherwise(1).cast("long").alias("is_leaf"),
    )


def indent(level: Column, width: int) -> Column:
    return F.repeat(F.lit(" "), ((level - 1) * width).cast("int"))


def org_chart(nodes: DataFrame, **columns) -> DataFrame:
    """Indented label, level and ' > ' path."""
    tree = tree_walk(nodes, **columns)
    name = columns.get("name", "name")
    return tree.select(
        F.concat(indent(F.col("level"), 4), F.col(name)).alias("org_chart"), "level",
        F.array_join("steps", " > ").alias("path"),
    )


def connect_by(nodes: DataFrame, **columns) -> DataFrame:
    """Level, indented name, ' / ' path, root and leaf flag; order by ``steps`` to sort siblings by name."""
    tree = tree_walk(nodes, **columns)
    name = columns.get("name", "name")
    return tree.select(
        "level", F.concat(indent(F.col("level"), 2), F.col(name)).alias("member"),
        F.concat(F.lit(" / "), F.array_join("steps", " / ")).alias("full_path"), "root", "is_leaf", "steps",
    )


def dependency_edges(requirements: DataFrame) -> DataFrame:
    """(src, dst) of every ``dependsOn`` entry, by short id."""
    return requirements.select(F.col("requirementId").alias("src"), F.explode("dependsOn").alias("dst"))


def closure(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs joined by a path. Only new pairs are extended, so cycles end."""
    step = checkpointed(edges.select("src", "dst").distinct())
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    known, fresh = step, step
    while True:
        reached = fresh.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        fresh = checkpointed(reached.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def chain_depth(edges: DataFrame) -> DataFrame:
    """Longest chain below each source node; null where a cycle makes it endless.

    The nodes with a chain of k + 1 steps are those with an edge to a node with a chain of k steps.
    These sets only shrink; one that stops shrinking consists of nodes that reach a cycle.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    current = checkpointed(edges.select("src").distinct())
    size, depth, ended = current.count(), 1, None
    while size:
        longer = checkpointed(edges.join(current.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src").distinct())
        stopped = current.join(longer, "src", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        ended = stopped if ended is None else ended.unionByName(stopped)
        left = longer.count()
        if left == size:
            endless = longer.withColumn("depth", F.lit(None).cast("long"))
            return ended.unionByName(endless)
        current, size, depth = longer, left, depth + 1
    return ended if ended is not None else current.withColumn("depth", F.lit(None).cast("long"))


def closure_summary(edges: DataFrame) -> DataFrame:
    """Number of direct and indirect dependencies of each source and its longest chain."""
    reach = closure(edges).groupBy("src").agg(F.count(F.lit(1)).alias("dependencies"))
    return reach.join(chain_depth(edges), "src")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when those from pure sources and to pure sinks are taken away, again and again.

    Every cycle stays whole; a tree leaves nothing. There are as many rounds as the longest chain beside cycles has steps.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    size = edges.count()
    while size:
        entered = edges.select(F.col("dst").alias("src")).distinct()
        going_on = edges.select(F.col("src").alias("dst")).distinct()
        kept = checkpointed(edges.join(entered, "src", "left_semi").join(going_on, "dst", "left_semi"))
        left = kept.count()
        if left == size:
            break
        edges, size = kept, left
    return edges


def requirement_summary(requirements: DataFrame) -> DataFrame:
    """Requirement counts by type, priority, status and technology."""
    facets = F.array(
        *[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("type", "priority", "status")]
    )
    technologies = F.transform(
        F.coalesce("technology", F.array().cast("array<string>")), lambda t: F.struct(F.lit("technology").alias("facet"), t.alias("value"))
    )
    return requirements.select(F.inline(F.concat(facets, technologies))).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("requirements")
    )


def requirement_fields(requirements: DataFrame) -> DataFrame:
    """One row per input field."""
    return requirements.select("requirementId", F.inline("inputFields"))
