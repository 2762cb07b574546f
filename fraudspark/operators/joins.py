"""Joins between datasets: shared officers, name-or-address matches, overlaps and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.numbers import ratio
from fraudspark.functions.text import match_key, normalize_name
from fraudspark.operators.pairs import group_members, similar_strings


def shared_addresses(entities: DataFrame, entity: str = "name", address: str = "address") -> DataFrame:
    """Entities at one address, compared without case and outer blanks: one row per address and entity."""
    keyed = entities.select(F.col(entity), match_key(F.col(address)).alias("address_key"))
    return group_members(keyed, "address_key", entity)


def shared_officers(companies: DataFrame, company: str = "name", officers: str = "officers") -> DataFrame:
    """Companies with a common officer: one row per officer and company."""
    named = companies.select(F.col(company), F.explode(officers).alias("_o"))
    keyed = named.select(company, match_key(F.col("_o")).alias("officer"))
    return group_members(keyed, "officer", company)


def similar_or_colocated(companies: DataFrame, *, max_distance: int = 2) -> DataFrame:
    """Companies with nearly equal names, or at the same address.

    companies(id, name, address_key). Rows are (kind, a, b, name_distance, n_a, n_b). For
    'similar_name', a and b are the first holders of two near names with n_a and n_b holders.
    For 'same_name' and 'same_address' each member b of a group of n_b has a row, under the group's
    first member a; companies at one address differ in name, so no distance is given.
    """
    named = companies.withColumn("name_key", normalize_name(F.col("name"))).filter("name_key <> ''")
    holders = named.groupBy("name_key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    side = lambda s: holders.select(
        F.col("name_key").alias(f"k{s}"), F.col("first").alias(s), F.col("n").alias(f"n_{s}")
    )
    near = similar_strings(holders, "name_key", max_distance).withColumnsRenamed({"a": "ka", "b": "kb"})
    near = near.join(side("a"), "ka").join(side("b"), "kb").select(
        F.lit("similar_name").alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.col("distance").alias("name_distance"),
        F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    )
    members = lambda key, kind, distance: group_members(named, key, "id").select(
        F.lit(kind).alias("kind"), F.col("first_member").alias("a"), F.col("id").alias("b"),
        F.lit(distance).cast("int").alias("name_distance"), F.col("n_members").alias("n_a"), F.col("n_members").alias("n_b"),
    )
    return near.unionByName(members("name_key", "same_name", 0)).unionByName(members("address_key", "same_address", None))


def activity_by_dataset(datasets: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, dataset, n): rows per key in each dataset."""
    union = None
    for name, df in datasets.items():
        counts = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("dataset", F.lit(name))
        union = counts if union is None else union.unionByName(counts)
    return union


def search_datasets(datasets: dict[str, tuple[DataFrame, Sequence[str]]], text: str, key: str) -> DataFrame:
    """(dataset, key, n): rows per key whose name fields hold `text`, over several datasets."""
    union = None
    for name, (df, fields) in datasets.items():
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.col(f), F.lit(text))
        found = df.filter(hit).groupBy(key).agg(F.count("*").alias("n"))
        found = found.select(F.lit(name).alias("dataset"), key, "n")
        union = found if union is None else union.unionByName(found)
    return union


def known_only(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Events whose key is among `known`."""
    return events.join(known.select(key), key, "left_semi")


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys on each side, in both, and the shares of each side."""
    a = left.select(F.col(left_key).alias("k")).na.drop().distinct().withColumn("in_a", F.lit(1))
    b = right.select(F.col(right_key).alias("k")).na.drop().distinct().withColumn("in_b", F.lit(1))
    sums = a.join(b, "k", "full_outer").agg(
        F.count("in_a").alias("n_left"), F.count("in_b").alias("n_right"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"),
    )
    return sums.select(
        "*", F.round(ratio(F.col("n_both"), F.col("n_left")), 6).alias("left_share"),
        F.round(ratio(F.col("n_both"), F.col("n_right")), 6).alias("right_share"),
    )


def coordination_gaps(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys with events at one agency and none at the other."""
    a = first.groupBy(key).agg(F.count("*").alias("n_first"))
    b = second.groupBy(key).agg(F.count("*").alias("n_second"))
    both = a.join(b, key, "full_outer").fillna(0)
    gap = F.when(F.col("n_second") == 0, "first_only").when(F.col("n_first") == 0, "second_only")
    return both.withColumn("gap", gap).filter("gap IS NOT NULL")


