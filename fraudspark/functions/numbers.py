"""Number casts and ratios that give NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column, kind: str = "double") -> Column:
    """Text to double or bigint; blank and malformed text give NULL."""
    return F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast(kind)


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def markup(subcontract: Column, total: Column) -> Column:
    """Share added on top of the subcontract amount, as a fraction."""
    return ratio(total - subcontract, subcontract)


def cost_gap(estimated: Column, actual: Column) -> Column:
    """Relative gap between actual and estimated cost; only where both are positive."""
    return F.when(
        (estimated > 0) & (actual > 0), F.abs(actual - estimated) / estimated
    )


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def distance_similarity(distance: Column) -> Column:
    """Similarity of two strings from their edit distance: 1 - d / 10."""
    return F.lit(1.0) - distance / F.lit(10.0)
