"""Places of rows within their group, by a global sort: no group is gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.session import cut_lineage

#: monotonically_increasing_id() holds the partition above this bit and the row within it below.
_ROW_BITS = 33


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], *, label: str = "numbered") -> DataFrame:
    """`df` with `_pos`, its place from 0 in its group by `order`, and `_n`, the rows of the group.

    Rows are cut into ranges of (groups, order), so a hot group covers many ranges; one row for each range and
    group is summed up to where the range starts. Groups must not be null; nulls in `order` come first, and
    rows equal in all of it follow each other in any order.
    """
    # Stored first, as the choice of ranges reads its input once more; `_tie` lets equal rows be cut apart.
    fixed = cut_lineage(df.withColumn("_tie", F.monotonically_increasing_id()), label)
    keys = [*groups, *order, "_tie"]
    ranged = fixed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(ranged.drop("_tie").withColumn("_range", F.shiftright("_at", _ROW_BITS)), f"{label}-ranges")
    heads = placed.groupBy(*groups, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy(*groups)
    before = F.sum("_rows").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(
        *groups, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("_n"))
    return placed.join(heads, [*groups, "_range"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
