"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of small bands are computed per set; a table is a pair of bands, one from each, so
n² tables need only 2 x n x ROWS minhashes. Two sets with similarity s share a table unless all bands
of one collection differ: (1 - s^ROWS)^n per collection. As many bands are taken as leave a pair at
the threshold unseen with a chance of at most `MISSED`: 16 at 85 %, 23 at 80 %. Bands that only one set
has are dropped before pairs of bands are formed, so documents without relatives cost 2 x n rows.

Equal sets are one vertex. Vertices that share a table form candidate clusters; within a cluster
all pairs are confirmed on the full sets, block by block, in tasks of bounded size, and a task returns
a spanning forest of its links instead of the pairs. Nothing is capped: a larger cluster has more
blocks.

Nulls, empty texts and texts without words have an empty set, link with nothing and are kept.
Rows without an id take part in no link and have a null component. Repeated rows are copies: rows
with one id count as one document. An empty table gives an empty table. Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import as_bytes, hash_words, map_batches, mix, signed, word_grams
from fraudspark.operators.graph import connected_components
from fraudspark.session import cut_lineage

ROWS, MISSED = 4, 1 / 60_000
WORDS = 5
BLOCK = 256
#: 64-bit words of the filter that keeps other texts from the network: 2 MB.
FILTER_WORDS = 1 << 18


def n_bands(percent: int) -> int:
    """Bands of one collection; above 99 %, as for 99 %."""
    unseen = 1 - (min(max(percent, 1), 99) / 100) ** ROWS
    return math.ceil(math.log(MISSED / 2) / math.log(unseen))


@functools.cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the minhashes of 2 x `n` bands."""
    draw = np.random.default_rng(20240229)
    factors = draw.integers(1, 1 << 32, 2 * n * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
    return factors, draw.integers(0, 1 << 32, 2 * n * ROWS, np.uint64).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; with fewer words, of the whole sequence."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = hash_words(words)
    if len(words) < WORDS:
        return word_grams(hashed, len(words)) + np.uint64(len(words))
    return np.unique(word_grams(hashed, WORDS))


def minhashes(grams: np.ndarray, n: int) -> np.ndarray:
    factors, offsets = _family(n)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(high), 1024):
            np.minimum(low, (high[at:at + 1024, None] * factors + offsets).min(axis=0), out=low)
    return low


def bands(grams: np.ndarray, n: int) -> np.ndarray:
    """Keys of the `n` bands of each of both collections; no two bands share a key but by chance."""
    rows = minhashes(grams, n).astype(np.uint64).reshape(2 * n, ROWS)
    keys = np.arange(1, 2 * n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix(keys) + rows[:, k]
    return mix(keys)


def signatures(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, digest, bands) of every row; digest and bands are null for empty sets."""
    kind, n = docs.schema[id_column].dataType.simpleString(), n_bands(percent)

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, keys = [], [], []
            for text in part.column(1).to_pylist():
                grams = shingles(text)
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                keys.append(signed(bands(grams, n)) if len(grams) else None)
            return pa.RecordBatch.from_arrays([
                part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], names=["id", "n_shingles", "digest", "bands"])

        return work

    return map_batches(docs.select(id_column, text_column), make, f"id {kind}, n_shingles long, digest binary, bands array<long>")


def candidate_links(classes: DataFrame) -> DataFrame:
    """(src, dst): every class that shares a table with others, to the smallest class of the table."""
    single = classes.select("rep", (F.size("bands") / 2).alias("half"), F.posexplode("bands").alias("pos", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    kept = single.join(shared, "key").groupBy("rep").agg(
        F.collect_list(F.when(F.col("pos") < F.col("half"), F.col("key"))).alias("left"),
        F.collect_list(F.when(F.col("pos") >= F.col("half"), F.col("key"))).alias("right"),
    )
    tables = kept.select("rep", F.explode("left").alias("l"), "right").select("rep", "l", F.explode("right").alias("r"))
    tables = cut_lineage(tables.select("rep", F.xxhash64("l", "r").alias("key")), "tables")
    first = tables.groupBy("key").agg(F.min("rep").alias("dst"), F.count("*").alias("n")).filter("n > 1").select("key", "dst")
    return tables.join(first, "key").filter("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct()


def _forest(ids: list, sets: list[np.ndarray], sides: list[int] | None, percent: int) -> list[tuple]:
    """Links of a spanning forest over the pairs with enough in common; with `sides`, only pairs across."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set is in no intersection
    column, owner = column[often], owner[often]
    if not len(column):
        return []
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    common = np.zeros((n, n), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for first, last in zip(cuts, cuts[1:]):
        part = np.zeros((n, width), np.float32)
        part[owner[first:last], column[first:last] % width] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
    if sides is not None:
        side = np.array(sides)
        linked &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in np.argwhere(linked).tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((ids[a], ids[b]))
    return out


def _likely_members(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of `docs` whose id is among `ids`, and few others: a Bloom filter of FILTER_WORDS 64-bit words, whatever their number."""
    h = lambda c: F.xxhash64(c)
    word = lambda c: F.pmod(h(c), F.lit(FILTER_WORDS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h(c), 40), F.lit(64)).cast("int"))
    marks = ids.select(word(F.col("node")).alias("_word"), bit(F.col("node")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # At most FILTER_WORDS rows of twelve bytes.
    found = docs.withColumn("_word", word(F.col(id_column))).join(F.broadcast(marks), "_word")
    return found.filter(F.col("_bits").bitwiseAND(bit(F.col(id_column))) != 0).select(*docs.columns)


def confirmed_links(docs: DataFrame, clusters: DataFrame, *, id_column: str, text_column: str, percent: int) -> DataFrame:
    """(src, dst) links of at least `percent` similarity that connect what all such links within clusters connect."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = clusters.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Only texts that can be a member's cross the network; the plan is the same at every size.
    likely = _likely_members(docs.select(F.col(id_column).alias("node"), F.col(text_column).alias("text")), clusters.select("node"), "node")
    texts = likely.join(members.hint("merge"), "node")
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            grams = pa.array([shingles(t).tobytes() for t in part.column(4).to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([*part.columns[:4], grams], names=["node", "component", "blocks", "block", "grams"])

        return work

    sets = map_batches(texts.select("node", "component", "blocks", "block", "text"), make,
                       f"node {kind}, component {kind}, blocks int, block int, grams binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "component", "grams", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def link(table: pa.Table) -> pa.Table:
        ids = table["node"].to_pylist()
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        across = table["i"][0].as_py() != table["j"][0].as_py()
        found = _forest(ids, sets, table["block"].to_pylist() if across else None, percent) if len(ids) > 1 else []
        kind = table["node"].type
        return pa.table({"src": pa.array([a for a, _ in found], kind), "dst": pa.array([b for _, b in found], kind)})

    return pairs.groupBy("component", "i", "j").applyInArrow(link, f"src {kind}, dst {kind}")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; links need `percent` of the union in common."""
    rows = cut_lineage(signatures(docs, id_column=id_column, text_column=text_column, percent=percent), "signatures")
    classes = cut_lineage(
        rows.filter("digest is not null and id is not null").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")
    clusters = cut_lineage(connected_components(candidate_links(classes)), "clusters")
    links = confirmed_links(docs, clusters, id_column=id_column, text_column=text_column, percent=percent)
    found = connected_components(cut_lineage(links, "links")).select(F.col("node").alias("rep"), "component")
    roots = cut_lineage(classes.select("digest", "rep").join(found, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("root")), "roots")
    component = F.when(F.col("id").isNotNull(), F.least(F.col("root"), F.col("id")))
    return rows.select("id", "n_shingles", "digest").join(roots, "digest", "left").select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
