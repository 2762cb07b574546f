"""Counts of several fact tables per key without multiplying them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_branches(
    base: DataFrame, keys: Sequence[str], branches: Sequence[DataFrame], how: str = "left"
) -> DataFrame:
    """Join tables already aggregated to `keys`; missing counts become 0.

    Each branch is reduced to one row per key before it is joined, so branches cannot multiply
    each other and a hot key crosses the network as one row.
    """
    keys = list(keys)
    out = base
    for branch in branches:
        out = out.join(branch, keys, how)
    numbers = {"bigint", "double", "int"}
    added = [n for b in branches for n, t in b.dtypes if n not in keys and t in numbers]
    return out.fillna(0, subset=added) if added else out


def count_per(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))
