"""Exact money arithmetic on decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(column: Column, precision: int = 10) -> Column:
    """Money value with two decimals."""
    return column.cast(f"decimal({precision},2)")


def ratio(numerator: Column, denominator: Column, factor: int = 1, digits: int = 2) -> Column:
    """numerator * factor / denominator, rounded half up; null when the denominator is zero.

    Both operands have at most two decimals, so the quotient keeps 14 decimals before rounding.
    """
    top = (numerator.cast("decimal(22,2)") * F.lit(factor)).cast("decimal(24,2)")
    bottom = F.nullif(denominator.cast("decimal(22,2)"), F.lit(0).cast("decimal(22,2)"))
    return F.round(top / bottom, digits)


def mean(total: Column, rows: Column) -> Column:
    """Unrounded mean as a double, computed from an exact total."""
    return total.cast("double") / F.nullif(rows.cast("double"), F.lit(0.0))
