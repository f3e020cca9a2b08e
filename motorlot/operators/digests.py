"""Snapshot comparison by a two-level tree of digests: only key buckets that differ are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlot.operators.changes import snapshot_diff
from motorlot.session import checkpointed

# Leaves of the tree, and leaves below one branch.
LEAVES, FAN = 1 << 14, 1 << 7


def leaf_of(key: str, leaves: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("leaf"), F.col(key)), F.lit(leaves)).cast("int")


def row_hash(columns: list[str], seed: str) -> Column:
    """64-bit hash of a row; a null is told from a missing neighbour by its flag."""
    return F.xxhash64(F.lit(seed), *[part for c in columns for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def leaf_digests(rows: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """(leaf, n, mixed, total) of the rows in each key bucket: their number, and two sums of row hashes that do not hang
    on order, one by exclusive or and one by exact addition of another hash."""
    return rows.groupBy(leaf_of(key, leaves).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row_hash(rows.columns, "a")).alias("mixed"),
        F.sum(row_hash(rows.columns, "b").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"))


def _differing(old: DataFrame, new: DataFrame, level: str) -> DataFrame:
    """Names of a level whose digests differ or stand on one side only."""
    sides = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    pairs = sides.groupBy(level, "n", "mixed", "total").agg(F.count(F.lit(1)).alias("_sides"))
    return pairs.where("_sides < 2").select(level).distinct()


def changed_leaves(old: DataFrame, new: DataFrame, key: str, leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """Leaves whose rows differ. Branches are compared first; only leaves below a differing branch are compared.

    There is one row for each leaf on each side, whatever the size of the snapshots.
    """
    sides = [checkpointed(leaf_digests(side, key, leaves).withColumn("branch", F.floor(F.col("leaf") / fan))) for side in (old, new)]
    branches = [s.groupBy("branch").agg(F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").alias("total")) for s in sides]
    open_ = _differing(*branches, "branch")
    return checkpointed(_differing(*[s.join(open_, "branch", "left_semi").drop("branch") for s in sides], "leaf"))


def rows_in(rows: DataFrame, key: str, changed: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """Rows of the changed leaves. The list has at most ``leaves`` whole numbers, so it is broadcast to the scan."""
    return rows.withColumn("_leaf", leaf_of(key, leaves)).join(F.broadcast(changed.withColumnRenamed("leaf", "_leaf")), "_leaf", "left_semi").drop("_leaf")


def digest_diff(old: DataFrame, new: DataFrame, key: str, leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """Changes between two snapshots with the same columns: key, operation, old and new row, as ``snapshot_diff`` gives them.

    Both sides are read once for their digests, which shuffles one row for each leaf and task. Then only rows whose leaf
    differs are shuffled and joined. Two different leaves with equal number and both 64-bit sums would be taken for equal.
    """
    changed = changed_leaves(old, new, key, leaves, fan)
    return snapshot_diff(rows_in(old, key, changed, leaves), rows_in(new, key, changed, leaves), key)
