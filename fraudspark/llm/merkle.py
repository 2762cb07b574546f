"""Merkle manifest of a dataset: a tree of fan-out 8 for each group, a tree over the groups, and a proof for every row.

A leaf hashes a row's fields, each written as its UTF-8 byte count, a colon and the value, or as `-` for null.
Every 8 consecutive nodes of a level become the SHA-256 of their hex digests, the last ones even if fewer, until one
node remains. Each aligned block of 512 nodes is one row that keeps its levels as one hex string each: fixed-width
substrings of a level are the inputs of its parents, and what stands to the left and right of a node within its
run are its siblings. Blocks' own nodes are the lowest level of the next round of blocks, so a tree needs
one shuffle for each 512-fold, and no block ever holds more than 512 nodes.

A null group is one of its own, before all others. Rows of equal order are ordered by their leaf, so repeated rows
are leaves of their own and the root does not depend on the storage. A null in the order comes first.
An empty table has no root and no proofs. Empty and very long texts are hashed whole.
Columns are read by name; others are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.ordering import numbered
from fraudspark.session import cut_lineage

FAN, LEVELS, HEX = 8, 3, 64
#: Nodes of a block, and characters of a full run.
BLOCK, RUN = FAN ** LEVELS, FAN * HEX


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _let(value: Column, use) -> Column:
    """`use` of `value`, which is computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _depth(nodes: Column) -> Column:
    """Levels above the lowest one of a tree of so many nodes."""
    return sum(((F.lit(1 << (3 * k)) < nodes).cast("int") for k in range(1, 21)), (nodes > 1).cast("int"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(_key, _block, _n, members, levels, node) of nodes (_key, _pos, _n, hash, what).

    `levels` are those that have parents within the tree; `node` is the one node above them.
    """
    held = nodes.groupBy("_key", F.shiftright("_pos", 3 * LEVELS).alias("_block")).agg(
        F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_pos", "hash", "what"))).alias("members"))
    used = F.least(F.lit(LEVELS), _depth(F.col("_n")))
    level = F.array_join(F.col("members.hash"), "")
    up = lambda at, s: F.when(used > at, _parents(s)).otherwise(s)
    all_levels = _let(level, lambda a: _let(up(0, a), lambda b: _let(up(1, b), lambda c: F.array(a, b, c, up(2, c)))))
    built = held.withColumn("levels", all_levels)
    return built.select("_key", "_block", "_n", "members", F.slice("levels", 1, used).alias("levels"), F.element_at("levels", 4).alias("node"))


def _tower(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks from the lowest round up, and (_key, hash): the node that remains of each tree."""
    rounds = []
    while True:
        rounds.append(cut_lineage(_blocks(nodes), "merkle"))
        above = rounds[-1].select(
            "_key", F.col("_block").alias("_pos"), F.shiftright(F.col("_n") + (BLOCK - 1), 3 * LEVELS).alias("_n"), F.col("node").alias("hash"), F.lit("").alias("what"))
        if above.filter("_n > 1").isEmpty():
            return rounds, above.select("_key", "hash")
        nodes = above


#: The parts of a run beside its `i`-th node, for the level of index `l`.
_BESIDE = f"""
    transform(levels, (s, l) -> named_struct(
      'left', substring(s, (shiftright(i, 3 * l) - shiftright(i, 3 * l) % {FAN}) * {HEX} + 1, shiftright(i, 3 * l) % {FAN} * {HEX}),
      'right', substring(s, (shiftright(i, 3 * l) + 1) * {HEX} + 1, ({FAN - 1} - shiftright(i, 3 * l) % {FAN}) * {HEX})))"""


def _members(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(_key, _block, hash, what, siblings, subroot, root) of every node, with `_block` its place; `above` has the siblings of blocks."""
    placed = F.expr(f"transform(members, (m, i) -> struct(m._pos AS _pos, m.hash AS hash, m.what AS what, {_BESIDE} AS beside))")
    each = blocks.join(above, ["_key", "_block"]).select("_key", "siblings", "subroot", "root", F.explode(placed).alias("m"))
    return each.select("_key", F.col("m._pos").alias("_block"), "m.hash", "m.what",
                       F.concat("m.beside", "siblings").alias("siblings"), "subroot", "root")


def proofs(docs: DataFrame, values: Sequence[Column], *, group: str, order: str, carry: Column | None = None) -> DataFrame:
    """(id, leaf, carried, subroot, root, siblings array<struct<left, right>>) of every row, level by level to the root.

    `values` are the fields of a leaf; `group` and `order` name columns, the latter the id. `carry` is one string
    that goes along with a row, null without it.
    """
    kind = docs.schema[order].dataType
    made = docs.select(
        # '0' for null, so that no key is null and the order of UTF-8 bytes stays.
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("_key"), F.col(order).alias("id"),
        leaf(values).alias("hash"), (F.lit(None).cast("string") if carry is None else carry).alias("carried"))
    nodes = numbered(made, ["_key"], ["id", "hash"], label="leaves")
    nodes = nodes.select("_key", "_pos", "_n", "hash", F.struct(F.col("id").alias("id"), "carried").alias("what"))
    rounds, subroots = _tower(nodes)
    groups = numbered(subroots.select(F.lit("").alias("_key"), F.col("_key").alias("what"), "hash"), ["_key"], ["what"], label="groups")
    top_rounds, root = _tower(groups)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    above = root.select("_key", F.lit(0).cast("long").alias("_block"), nothing.alias("siblings"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    for blocks in reversed(top_rounds):
        above = _members(blocks, above)
    above = above.select(F.col("what").alias("_key"), F.lit(0).cast("long").alias("_block"), "siblings", F.col("hash").alias("subroot"), "root")
    for blocks in reversed(rounds):
        above = _members(blocks, above)
    return above.select(F.col("what.id").cast(kind).alias("id"), F.col("hash").alias("leaf"), "what.carried", "subroot", "root", "siblings")


def fold(leaf_hash: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf_hash, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def written(siblings: Column) -> Column:
    """All siblings as one hex string, level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")
