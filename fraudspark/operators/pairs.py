"""Records that share a key, and pairs of nearly equal strings.

Listing every pair of a key grows with the square of its size. Here a shared key gives one row per
member, with the size of its group: any two members are a pair. This is one form at every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, pairwise, product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.session import cut_lineage


def group_members(df: DataFrame, key: str, member: str, values: Sequence[str] = ()) -> DataFrame:
    """Members of keys held by two or more: (key, member, values, n_members, first_member, totals).

    `values` are numbers of the member; each is carried along and summed over the group as `total_<name>`.
    """
    named = df.select(key, member, *values).na.drop(subset=[key, member]).dropDuplicates([key, member])
    sizes = (
        named.groupBy(key)
        .agg(
            F.count("*").alias("n_members"), F.min(member).alias("first_member"),
            *[F.sum(v).alias(f"total_{v}") for v in values],
        )
        .filter("n_members > 1")
    )
    # Stored, so the join shuffles both sides itself and a hot key can be split at run time;
    # joined straight from the aggregation it could not.
    return named.join(cut_lineage(sizes, "sizes"), key)


#: Segments in common that are asked for where two are not enough.
MOST_COMMON_PARTS = 3


def similar_strings(
    df: DataFrame, column: str, max_distance: int, *, bucket_limit: int = 256, most_variants: int = 2000
) -> DataFrame:
    """Pairs of distinct strings within an edit distance of 1..max_distance: (a, b, distance).

    Strings within k edits become equal when at most k characters are deleted from each. Short strings, of at most
    `most_variants` such rests, are matched on them: who shares a rest is near, whatever all strings have in common.
    Where one string of a pair is longer, candidates come from segment signatures, as in Pass-Join (Li, Deng, Wang,
    Feng, VLDB 2011), but of several segments at once: of max_distance + 2 segments, near strings have two in common, as
    every edit touches at most one. A signature of more than `bucket_limit` strings is put aside, and its strings are
    matched on three of max_distance + 3 segments, then on their rests. No pair is lost: a pair has a rare
    signature, or both strings carry the common one to the next turn, and rests are never put aside.
    """
    # Read by several branches below, so stored once.
    strings = cut_lineage(df.select(F.col(column).alias("s")).na.drop().distinct(), "strings")
    short = _longest_with(most_variants, max_distance)
    found = _sharing_rests(strings.filter(F.length("s") <= short), max_distance)
    strings = strings.filter(F.length("s") > short - max_distance)
    for common in range(2, MOST_COMMON_PARTS + 1):
        if strings.filter(F.length("s") > short).isEmpty():
            strings = None
            break
        indexed = cut_lineage(strings.select("s", F.explode(_own_parts(max_distance, common)).alias("sig")), "segments")
        probing = strings.select("s", F.explode(_probe_parts(max_distance, common)).alias("sig"))
        crowded = cut_lineage(indexed.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_limit).select("sig"), "crowded")
        none = crowded.isEmpty()
        left = indexed if none else indexed.join(crowded, "sig", "left_anti")
        pairs = left.withColumnRenamed("s", "a").hint("merge").join(probing.withColumnRenamed("s", "b"), "sig").filter("a <> b")
        found = found.unionByName(_near(pairs.select(*_in_order("a", "b")), max_distance))
        if none:
            strings = None
            break
        both = indexed.unionByName(probing).join(crowded, "sig", "left_semi")
        strings = cut_lineage(both.select("s").distinct(), "strings")
    if strings is not None:
        found = found.unionByName(_sharing_rests(strings, max_distance))
    return found.distinct()


def _near(pairs: DataFrame, max_distance: int) -> DataFrame:
    """Candidates that are near, measured before they are sent on: a pair may come several times."""
    return pairs.withColumn("distance", F.levenshtein("a", "b", max_distance)).filter("distance > 0")


def _longest_with(most: int, k: int) -> int:
    """Longest length of which a string has at most `most` rests."""
    length = k
    while sum(comb(length + 1, i) for i in range(k + 1)) <= most:
        length += 1
    return length


def _sharing_rests(strings: DataFrame, k: int) -> DataFrame:
    """Near pairs among `strings`, by what is left of each after at most `k` deletions."""
    rests = strings.select("s", F.col("s").alias("rest"), F.lit(1).alias("at"))
    for _ in range(k):
        # Deletions go from left to right, and of equal neighbours the first goes; past the end nothing is deleted.
        rests = rests.select("s", "rest", "at", F.explode(F.expr("sequence(at, length(rest) + 1)")).alias("p"))
        rests = rests.filter("p = at OR p > length(rest) OR substr(rest, p, 1) <> substr(rest, p - 1, 1)")
        rests = rests.select("s", F.expr("concat(substr(rest, 1, p - 1), substr(rest, p + 1))").alias("rest"), F.col("p").alias("at"))
    keyed = rests.select("s", F.xxhash64("rest").alias("sig")).distinct()
    pairs = keyed.withColumnRenamed("s", "a").hint("merge").join(keyed.withColumnRenamed("s", "b"), "sig").filter("a < b")
    return _near(pairs.select("a", "b"), k)


def _in_order(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _segment(n: int, i: str, length: str) -> tuple[str, str]:
    """SQL for start (from 1) and size of segment `i` of a string of that length cut into `n`, the longer ones last."""
    longer = f"({n} - ({length}) % {n})"
    return f"({i} * (({length}) div {n}) + greatest(0, {i} - {longer}) + 1)", f"(({length}) div {n} + if({i} >= {longer}, 1, 0))"


def _own_parts(k: int, common: int) -> Column:
    """Signatures of every `common` segments of a string `s`."""
    start, size = _segment(k + common, "i", "length(s)")
    chosen = ", ".join(f"array({', '.join(map(str, c))})" for c in combinations(range(k + common), common))
    return F.expr(f"transform(array({chosen}), c -> xxhash64(length(s), c, transform(c, i -> substr(s, {start}, {size}))))")


def _shifts(k: int, common: int, longer: int) -> list[tuple[int, ...]]:
    """How far segments can stand from their place in a string longer by `longer`: with k edits, all the way
    from the start of the text to its end the shift changes by at most k."""
    way = lambda by: sum(abs(y - x) for x, y in pairwise((0, *by, longer)))
    return [by for by in product(range(-k, k + 1), repeat=common) if way(by) <= k]


def _probe_parts(k: int, common: int) -> Column:
    """Signatures under which a near string that is as long as `s` or shorter is indexed."""
    length = "length(s) - c.longer"
    start, size = _segment(k + common, "i", length)
    array = lambda numbers: f"array({', '.join(map(str, numbers))})"
    tried = ", ".join(
        f"struct({longer} AS longer, {array(at)} AS at, {array(by)} AS by)"
        for longer in range(k + 1) for by in _shifts(k, common, longer) for at in combinations(range(k + common), common))
    inside = f"forall(zip_with(c.at, c.by, (i, h) -> {start} + h >= 1 AND {start} + h + {size} - 1 <= length(s)), x -> x)"
    return F.expr(f"""
        array_distinct(transform(
          filter(array({tried}), c -> {length} >= 0 AND {inside}),
          c -> xxhash64({length}, c.at, zip_with(c.at, c.by, (i, h) -> substr(s, {start} + h, {size})))))""")


def related_pairs_missing(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs (a, b) not linked yet, in either direction."""
    known = existing.select(*_in_order("a", "b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")
