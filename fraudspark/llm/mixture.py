"""Mixing sources to target weights by systematic sampling: whole documents, some of them twice.

A source's documents are put in order of size and, among equals, of a hash of the id. Each expects as many copies
as the source's target is of its size; the expected copies are summed up from the first document on, one random
offset of the source is added, and a document is taken once for each integer that its own interval crosses. As
neighbours in that order are of like size, the words taken come near the target. All sums are exact: expected
copies are whole multiples of 2^-40.

A null text has size 0, and a document without words takes nothing. Null is a source of its own, the last. A
source without words has target 0. Repeated rows are documents of their own. Without any words all targets
are 0; an empty table gives an empty table. Columns are read by name; others are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import GAPS
from fraudspark.llm.ordering import numbered
from fraudspark.session import cut_lineage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Expected copies are counted in parts of this size.
PARTS = 1 << 40


def size_of(text: Column) -> Column:
    """Words of a text; the splitting leaves empty strings at the ends only."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")).cast("long")


def targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_key, source_size, target) of sources (_key, source_size).

    Sources in order of their key weigh `weights` in turn. They share `share` of all sizes; no target exceeds `most`
    times its source's size, and what is above goes to the others by weight, until none is above. Each turn is
    one aggregate whose two sums reach the driver.
    """
    placed = numbered(sizes.withColumn("_all", F.lit(0)), ["_all"], ["_key"], label="sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    sources = cut_lineage(placed.select("_key", "source_size", turn.cast("long").alias("w"), (most * F.col("source_size")).alias("top")), "weights")
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("top") <= F.lit(level) * F.col("w")
        found = sources.agg(F.count_if(above).alias("full"), F.coalesce(F.sum(F.when(above, F.col("top"))), F.lit(0)).alias("held"),
                            F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0)).alias("w")).first()
        if found["full"] == full or not found["w"]:
            break
        full, level = found["full"], (share * whole - float(found["held"])) / float(found["w"])
    return sources.select("_key", "source_size", F.least(F.col("top").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def offset(key: Column, seed: str) -> Column:
    """A number below PARTS that depends on the source and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 10), 16, 10).cast("decimal(13,0)")


def mix(docs: DataFrame, *, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row; `taken` is the copies' words."""
    sized = docs.select(
        # '1' for null, so that no key is null and null is the last.
        F.coalesce(F.concat(F.lit("0"), F.col(source_column)), F.lit("1")).alias("_key"),
        F.col(id_column).alias("id"), size_of(F.col(text_column)).alias("size"))
    sized = sized.withColumn("_shuffled", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    placed = cut_lineage(numbered(sized, ["_key"], ["size", "_shuffled", "id"], label="sized").drop("_shuffled"), "placed")
    goal = cut_lineage(targets(placed.groupBy("_key").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most), "targets")
    each = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") / F.col("source_size") * float(PARTS)), F.lit(most * PARTS))).otherwise(F.lit(0))
    goal = goal.select("_key", "source_size", "target", each.cast("decimal(13,0)").alias("_each"), offset(F.col("_key"), seed).alias("_offset"))
    upto = lambda k: F.call_function(
        "div", F.col("_offset") + F.col("_each") * k.cast("decimal(20,0)"), F.lit(PARTS).cast("decimal(13,0)"))
    copies = upto(F.col("_pos") + 1) - upto(F.col("_pos"))
    return placed.join(goal, "_key").select(
        F.col("id").alias(id_column), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
