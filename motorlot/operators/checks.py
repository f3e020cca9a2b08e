"""Reports of rows that break the declared rules, since Spark enforces none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def check_rules(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule. A rule holds when it is true or null, as a CHECK constraint does."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]),
        lambda name: name.isNotNull(),
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values))


def within(column: str, low, high) -> Column:
    return F.col(column).between(low, high)


def at_most_long(column: str, size: int) -> Column:
    return F.length(column) <= size


def present(column: str) -> Column:
    return F.col(column).isNotNull()


def rental_rules() -> dict[str, Column]:
    """Rules of the rental tables (fixed values: status list and fuel range)."""
    return {
        "status_list": one_of("status", ["ACTIVE", "COMPLETED", "DISPUTED"]),
        "fuel_out_range": within("fuel_level_out", 0, 100),
        "fuel_in_range": within("fuel_level_in", 0, 100),
        "dates_in_order": F.col("dropoff_date") > F.col("pickup_date"),
    }


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; a key with a null part is exempt."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child key values without a parent, with their row count.

    Children are counted per key before the join, so a hot key is one row in it.
    """
    counts = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("missing_key")).agg(
        F.count(F.lit(1)).alias("children")
    )
    keys = parent.select(F.col(parent_key).alias("missing_key"))
    return counts.join(keys, "missing_key", "left_anti")
