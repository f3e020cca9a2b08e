"""Trees numbered by an Euler tour and strongly connected components, without walking a graph level by level.

Pointers are doubled: in each round every element hands on to the element behind its next one, so a list or ring of n
elements takes about log2(n) rounds of one join, however deep the tree is.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from motorlot.operators.hierarchy import closure_summary, cyclic_core
from motorlot.operators.ordered import ordered_scan
from motorlot.session import checkpointed


def tour(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """(id, exits, next_id, next_exits, ended) of the Euler tour: each node is entered and left once.

    Entering leads to the first child, or out again; leaving leads to the next sibling, or to the parent's end. Siblings
    stand in ``order``, ties by id, and all roots are siblings; a parent with very many children is numbered by ranges.
    """
    listed = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), F.col(order).alias("by"), F.col(parent).isNull().alias("top"))
    keyed = listed.withColumn("up", F.coalesce("up", "id")).withColumn("group", F.when(F.col("top"), F.lit("")).otherwise(F.concat(F.lit("/"), F.col("up").cast("string"))))
    placed = checkpointed(ordered_scan(keyed, ["by"], ["id"], ["group"], ranks=False).select("id", "up", "top", "group", F.col("row_num").alias("place")))
    follower = placed.select("group", (F.col("place") - 1).alias("place"), F.col("id").alias("follower"))
    child = placed.where("not top and place = 1").select(F.col("up").alias("id"), F.col("id").alias("child"))
    enters = placed.join(child, "id", "left").select(
        "id", F.lit(False).alias("exits"), F.coalesce("child", "id").alias("next_id"), F.col("child").isNull().alias("next_exits"), F.lit(False).alias("ended"))
    leaves = placed.join(follower, ["group", "place"], "left").select(
        "id", F.lit(True).alias("exits"), F.coalesce("follower", "up").alias("next_id"), F.col("follower").isNull().alias("next_exits"),
        (F.col("follower").isNull() & F.col("top")).alias("ended"))
    return enters.unionByName(leaves)


def tree_numbering(nodes: DataFrame, node: str = "id", parent: str = "parent", order: str = "name") -> DataFrame:
    """Nodes below a root with ``number`` (depth first, siblings in order), ``last``, ``level``, ``descendants``, ``is_leaf``.

    ``last`` is the number of the last descendant, so the descendants of a node are the numbers from ``number`` + 1 to
    ``last``. Nodes below a missing parent or inside a cycle hang off no root and are left out. Node ids are unique.
    """
    step = F.when(F.col("exits"), F.lit(0)).otherwise(F.lit(1)).cast("long")
    turn = F.when(F.col("exits"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    items = checkpointed(tour(nodes, node, parent, order).withColumns({"entered": step, "rise": turn}))
    rounds = ceil(log2(max(items.count(), 2))) + 1
    for _ in range(rounds):
        if items.where("not ended").isEmpty():
            break
        behind = items.select(F.col("id").alias("next_id"), F.col("exits").alias("next_exits"), F.col("next_id").alias("_id"), F.col("next_exits").alias("_exits"),
                              F.col("ended").alias("_ended"), F.col("entered").alias("_entered"), F.col("rise").alias("_rise"))
        # An element whose next one is unknown leads to a missing parent and goes.
        moved = items.where("not ended").join(behind, ["next_id", "next_exits"]).select(
            "id", "exits", F.col("_id").alias("next_id"), F.col("_exits").alias("next_exits"), F.col("_ended").alias("ended"),
            (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("rise") + F.col("_rise")).alias("rise"))
        items = checkpointed(items.where("ended").unionByName(moved))
    done = items.where("ended")
    total = done.agg(F.max("entered")).first()[0] or 0
    per_node = done.groupBy("id").agg(
        F.max(F.when(~F.col("exits"), F.col("entered"))).alias("_in"), F.max(F.when(F.col("exits"), F.col("entered"))).alias("_out"),
        F.max(F.when(~F.col("exits"), F.col("rise"))).alias("_rise")).where("_in is not null and _out is not null")
    numbered = per_node.select(F.col("id").alias(node), (F.lit(total) - F.col("_in") + 1).cast("long").alias("number"), (F.col("_in") - F.col("_out") - 1).cast("long").alias("descendants"), (1 - F.col("_rise")).cast("long").alias("level"))
    return nodes.select(node, parent, order).join(numbered, node).select(
        node, parent, order, "number", (F.col("number") + F.col("descendants")).alias("last"), "level", "descendants",
        F.when(F.col("descendants") == 0, 1).otherwise(0).cast("long").alias("is_leaf"))


def forest_depths(edges: DataFrame) -> DataFrame | None:
    """(src, dependencies, depth) where every source depends on one other node and none on itself; None for other graphs.

    There the dependencies of a node are its ancestors: one less than its level.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    if not edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    roots = edges.select(F.col("dst").alias("src")).distinct().join(edges, "src", "left_anti").withColumn("dst", F.lit(None).cast(edges.schema["dst"].dataType))
    nodes = edges.unionByName(roots).withColumn("name", F.col("src"))
    levels = checkpointed(tree_numbering(nodes, "src", "dst", "name").where(F.col("dst").isNotNull()).select("src", (F.col("level") - 1).alias("dependencies")))
    if levels.count() != edges.count():
        return None
    return levels.withColumn("depth", F.col("dependencies"))


def dependency_summary(edges: DataFrame) -> DataFrame:
    """Number of direct and indirect dependencies of each source and its longest chain; trees form no pairs."""
    depths = forest_depths(edges)
    return closure_summary(edges) if depths is None else depths


def rings(edges: DataFrame) -> DataFrame:
    """(node, component) of rings that nothing leaves: nodes with one way out that come back to themselves.

    Each node carries the smallest node seen on its way. After as many doublings as make the way longer than any ring, the
    nodes that are still pointed to by nodes of the ring's own way are the ring.
    """
    ways = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).where("n = 1").select("src", "to")
    ways = checkpointed(ways.withColumn("low", F.least("src", "to")))
    size = ways.count()
    rounds = ceil(log2(max(size, 2))) + 1
    for _ in range(rounds if size else 0):
        hop = ways.select(F.col("src").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        # A way that leads out of these nodes ends in no ring and goes.
        ways = checkpointed(ways.join(hop, "to").select("src", F.col("_to").alias("to"), F.least("low", "_low").alias("low")))
    # After more steps than there are nodes every way stands on its ring; the smallest node of a ring is seen by a node on it.
    on_ring = ways.select(F.col("to").alias("src")).distinct()
    return ways.join(on_ring, "src", "left_semi").select(F.col("src").alias("node"), F.col("low").alias("component"))


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which each node is reached along edges (src, dst), itself included."""
    known = checkpointed(nodes.select("node", F.col("node").alias("label")))
    fresh = known
    while not fresh.isEmpty():
        sent = edges.join(fresh.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("_label"))
        updated = checkpointed(known.join(sent, "node", "left").select("node", F.least("label", F.coalesce("_label", "label")).alias("label"), (F.col("_label") < F.col("label")).alias("moved")))
        known, fresh = updated.select("node", "label"), updated.where("moved").select("node", "label")
    return known


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size): component is the smallest node that can be reached from the node and reaches it.

    Rings without a way out are found by doubling pointers. Of the rest, what lies on no cycle is trimmed; then, again and
    again, every node takes the smallest node that reaches it as its colour, and the nodes of a colour that reach its
    smallest node inside that colour are a component. So no pairs of nodes are formed; rounds follow the longest way
    between nodes of such a component, not the size of the graph.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    nodes = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    found = [checkpointed(rings(edges))]
    gone = found[0].select("node")
    rest = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    rest = cyclic_core(rest)
    while not rest.isEmpty():
        inside = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = checkpointed(_spread(inside, rest))
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("x")), colour.select(F.col("node").alias("dst"), F.col("label").alias("y"))
        back = checkpointed(rest.join(a, "src").join(b, "dst").where("x = y").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("x").alias("colour")))
        seeds = colour.where("node = label").select("node")
        reached, fresh = seeds, seeds
        while not fresh.isEmpty():
            fresh = checkpointed(back.join(fresh.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti"))
            reached = checkpointed(reached.union(fresh))
        found.append(colour.join(reached, "node", "left_semi").select("node", F.col("label").alias("component")))
        rest = rest.join(reached.withColumnRenamed("node", "src"), "src", "left_anti").join(reached.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = cyclic_core(rest)
    members = found[0]
    for part in found[1:]:
        members = members.unionByName(part)
    named = checkpointed(nodes.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    return named.join(named.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


def dependency_checks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Problems of a graph: nodes on a cycle and edges to unknown nodes."""
    on_cycle = strong_components(edges).where("size > 1").select("node").union(edges.where("src = dst").select("src")).distinct()
    dangling = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(
        F.col("dst").alias("node"), F.lit("UNKNOWN_TARGET").alias("problem")).distinct()
    return on_cycle.select("node", F.lit("CYCLE").alias("problem")).unionByName(dangling)
