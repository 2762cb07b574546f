"""Facts to graph tables: one row per entity, one row per relationship."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.numbers import distance_similarity
from fraudspark.functions.text import blank_to_null, owner_name
from fraudspark.operators.patterns import shared_address_owners, similar_addresses
from fraudspark.session import cut_lineage
from fraudspark.operators.temporal import first_version


def entity_key(*fields: Column) -> Column:
    """Stable id of an entity known by several fields."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def property_nodes(facts: DataFrame, load_order: Sequence[str]) -> DataFrame:
    """One row per BIN, from the first fact that names it."""
    return first_version(facts.filter(F.col("bin").isNotNull()), ["bin"], load_order)


def unique_facts(facts: DataFrame, key: str, load_order: Sequence[str]) -> DataFrame:
    """Violation rows by id, the first one kept."""
    return first_version(facts.filter(F.col(key).isNotNull()), [key], load_order)


def respondent_nodes(ecb: DataFrame) -> DataFrame:
    """Respondents by name, address, city and ZIP."""
    number, street = F.col("respondent_house_number"), F.col("respondent_street")
    both = (blank_to_null(number).isNotNull()) & (blank_to_null(street).isNotNull())
    parts = ecb.filter(blank_to_null(F.col("respondent_name")).isNotNull()).select(
        F.col("respondent_name").alias("name"),
        F.when(both, F.concat_ws(" ", number, street)).otherwise("").alias("address"),
        F.coalesce("respondent_city", F.lit("")).alias("city"),
        F.coalesce("respondent_zip", F.lit("")).alias("zip"),
    )
    fields = ["name", "address", "city", "zip"]
    return parts.distinct().withColumn("respondent_id", entity_key(*map(F.col, fields)))


def owner_nodes(jobs: DataFrame) -> DataFrame:
    """Owners by name, address, city, state, ZIP, phone, type and non-profit flag."""
    number, street = F.col("owner_house_number"), F.col("owner_street")
    both = (blank_to_null(number).isNotNull()) & (blank_to_null(street).isNotNull())
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = jobs.select(
        owner_name(F.col("owner_business_name"), F.col("owner_first_name"), F.col("owner_last_name")).alias("name"),
        F.when(both, F.concat_ws(" ", number, street)).otherwise("").alias("address"),
        blank("owner_city").alias("city"), blank("owner_state").alias("state"), blank("owner_zip").alias("zip"),
        blank("owner_phone").alias("phone"), blank("owner_type").alias("owner_type"),
        blank("non_profit").alias("non_profit"),
    ).filter(F.col("name").isNotNull())
    return parts.distinct().withColumn("owner_id", entity_key(*[F.col(c) for c in parts.columns]))


def professional_nodes(jobs: DataFrame) -> DataFrame:
    """Applicants by name, title, licence and certification."""
    first, last = blank_to_null(F.col("applicant_first_name")), blank_to_null(F.col("applicant_last_name"))
    parts = jobs.filter(first.isNotNull() & last.isNotNull()).select(
        F.concat_ws(" ", first, last).alias("name"),
        F.coalesce("applicant_title", F.lit("")).alias("title"),
        F.coalesce("applicant_license", F.lit("")).alias("license_number"),
        F.coalesce("professional_cert", F.lit("")).alias("professional_cert"),
    )
    return parts.distinct().withColumn("professional_id", entity_key(*[F.col(c) for c in parts.columns]))


def edges(facts: DataFrame, source: str, target: str, rel_type: str) -> DataFrame:
    """(src, dst, rel_type); facts without either end give no edge."""
    return facts.select(
        F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst"),
        F.lit(rel_type).alias("rel_type"),
    ).na.drop().distinct()


def node(kind: str) -> Column:
    """Id of a node, with its kind in front."""
    return F.concat_ws(":", F.lit(kind), F.col(f"{kind}_id").cast("string"))


# Weights of relationship kinds.
DIRECT_WEIGHT, INFERRED_WEIGHT = 1.0, 0.8

# Edges of a record as (source, target, relationship, weight).
PERMIT_EDGES = [
    ("permit", "applicant", "applied_by", DIRECT_WEIGHT), ("permit", "contractor", "contractor", DIRECT_WEIGHT),
    ("permit", "property", "for_property", DIRECT_WEIGHT), ("applicant", "property", "owns", INFERRED_WEIGHT),
]
VIOLATION_EDGES = [("violation", "respondent", "issued_to", DIRECT_WEIGHT), ("violation", "property", "at_property", DIRECT_WEIGHT)]
COMPLAINT_EDGES = [("complaint", "property", "about_property", DIRECT_WEIGHT)]
RELATIONSHIPS = [rel_type for _, _, rel_type, _ in [*PERMIT_EDGES, *VIOLATION_EDGES, *COMPLAINT_EDGES]]


def record_edges(records: DataFrame, kinds: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """(src, dst, rel_type, ts, weight): all edges of a record at once, so that its table is read and joined only once."""
    edges = F.explode(F.array(*[
        F.struct(node(source).alias("src"), node(target).alias("dst"), F.lit(rel_type).alias("rel_type"), F.lit(weight).alias("weight"))
        for source, target, rel_type, weight in kinds
    ])).alias("e")
    return records.select(edges, F.col("ts").cast("date").alias("ts")).select("e.src", "e.dst", "e.rel_type", "ts", "e.weight")


def relationship_graph(permits: DataFrame, violations: DataFrame, complaints: DataFrame) -> DataFrame:
    """Typed edges of permit, violation and complaint records.

    permits(permit_id, applicant_id, contractor_id, property_id, ts),
    violations(violation_id, respondent_id, property_id, ts), complaints(complaint_id, property_id, ts).
    """
    return (
        record_edges(permits, PERMIT_EDGES)
        .unionByName(record_edges(violations, VIOLATION_EDGES))
        .unionByName(record_edges(complaints, COMPLAINT_EDGES))
    )


def relationship_counts(graph: DataFrame) -> DataFrame:
    """(rel_type, n, total_weight, first_day, last_day, n_sources, n_targets) of a relationship graph.

    The graph is gone through once. A node carries all its relationship kinds in one number of bits, so it crosses
    the network once for each part of a table it is in, not once for each edge.
    """
    bit = F.lit(0)
    for i, rel_type in enumerate(RELATIONSHIPS):
        bit = F.when(F.col("rel_type") == rel_type, 1 << i).otherwise(bit)
    none = F.lit(None)
    rows = lambda side, name, weight, ts: F.struct(F.lit(side).alias("side"), F.col(name).alias("name"), weight.alias("w"), ts.alias("ts"))
    parts = F.array(
        rows("source", "src", none.cast("double"), none.cast("date")), rows("target", "dst", none.cast("double"), none.cast("date")),
        rows("kind", "rel_type", F.col("weight"), F.col("ts")))
    sums = lambda n: [n.alias("n"), F.sum("w").alias("w"), F.min("first").alias("first"), F.max("last").alias("last")]
    named = graph.select(F.explode(parts).alias("x"), bit.alias("bit")).select("x.side", "x.name", "bit", "x.w", F.col("x.ts").alias("first"), F.col("x.ts").alias("last"))
    found = named.groupBy("side", "name").agg(F.bit_or("bit").alias("bits"), *sums(F.count("*")))
    alike = found.groupBy("side", "bits").agg(F.count("*").alias("nodes"), *sums(F.sum("n")))
    held = F.explode(F.array(*[F.struct(F.lit(r).alias("rel_type"), (F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias("holds"))
                               for i, r in enumerate(RELATIONSHIPS)])).alias("k")
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    return alike.select("*", held).filter("k.holds").groupBy(F.col("k.rel_type").alias("rel_type")).agg(
        F.sum(of("kind", "n")).alias("n"), F.round(F.sum(of("kind", "w")), 4).alias("total_weight"),
        F.min(of("kind", "first")).alias("first_day"), F.max(of("kind", "last")).alias("last_day"),
        F.sum(of("source", "nodes")).alias("n_sources"), F.sum(of("target", "nodes")).alias("n_targets"))


# Properties of both owners together, and the confidence from there on.
SHELL_STEPS = [(10, 0.9), (5, 0.7)]
SHELL_LEAST = 0.5


def same_address_edges(owners: DataFrame, owns: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SHARES_ADDRESS between owners at one address: one row per owner, linked to the others of its group.

    `n_new` counts the owners of the address that `existing` (a, b) does not tie to this one; an owner
    with none left has no row.
    """
    members = shared_address_owners(owners, owns).withColumn("n_new", F.col("n_members") - 1)
    if existing is not None:
        both = existing.select("a", "b").unionByName(existing.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = members.select("owner_id", "address_key")
        known = (
            both.filter("a <> b").distinct()
            .join(place.withColumnsRenamed({"owner_id": "a"}), "a")
            .join(place.withColumnsRenamed({"owner_id": "b"}), ["b", "address_key"])
            .groupBy("address_key", F.col("a").alias("owner_id")).agg(F.count("*").alias("n_known"))
        )
        members = members.join(known, ["address_key", "owner_id"], "left")
        members = members.withColumn("n_new", F.col("n_new") - F.coalesce("n_known", F.lit(0))).filter("n_new > 0")
    return members.select(
        "address_key", "owner_id", "first_member", "n_members", "n_new", F.lit(1.0).alias("similarity"),
        F.lit("exact_address").alias("match_type"), "property_count", "total_properties",
    )


def near_address_edges(owners: DataFrame, owns: DataFrame, *, max_distance: int = 2) -> DataFrame:
    """SHARES_ADDRESS between near addresses: similarity 1 - distance / 10."""
    return similar_addresses(owners, owns, max_distance=max_distance).select(
        "a", "b", F.col("distance").alias("edit_distance"),
        F.round(distance_similarity(F.col("distance")), 4).alias("similarity"),
        F.lit("fuzzy_address").alias("match_type"),
        (F.col("n_properties_a") + F.col("n_properties_b")).alias("total_properties"),
    )


def potential_shells(members: DataFrame, *, at_least: int = 3) -> DataFrame:
    """POTENTIAL_SHELL: owners whose address holds others with enough properties together.

    members(address_key, owner_id, property_count). One row per owner and confidence, with the number
    of other owners at the address (`n_links`) whose properties and its own reach that confidence.
    From the highest step on the exact number no longer matters, so owners of an address fall into at
    most `SHELL_STEPS[0][0]` classes, and classes are compared instead of owners.
    """
    most = SHELL_STEPS[0][0]
    size = F.least("property_count", F.lit(most))
    sized = members.filter("address_key IS NOT NULL").withColumn("size", size)
    classes = cut_lineage(sized.groupBy("address_key", "size").agg(F.count("*").alias("n")), "classes")
    other = classes.withColumnsRenamed({"size": "other_size", "n": "other_n"})
    total = F.col("size") + F.col("other_size")
    confidence = F.lit(None).cast("double")
    for low, value in reversed(SHELL_STEPS):
        confidence = F.when(total >= low, value).otherwise(confidence)
    own = (F.col("size") == F.col("other_size")).cast("long")
    links = (
        classes.join(other, "address_key").filter(total >= at_least)
        .groupBy("address_key", "size", F.coalesce(confidence, F.lit(SHELL_LEAST)).alias("confidence"))
        .agg(F.sum(F.col("other_n") - own).alias("n_links")).filter("n_links > 0")
    )
    return sized.join(cut_lineage(links, "links"), ["address_key", "size"]).select(
        "address_key", "owner_id", "property_count", "confidence", "n_links"
    )


def inspectors(violations: DataFrame, device: str, date: str, area: str) -> DataFrame:
    """Inspectors by device number: first and last day, days, areas (a short code list)."""
    return violations.filter(blank_to_null(F.col(device).cast("string")).isNotNull()).groupBy(device).agg(
        F.count("*").alias("n_inspections"), F.min(date).alias("first_day"), F.max(date).alias("last_day"),
        F.array_sort(F.collect_set(area)).alias("areas"),
    )


def event_table(sources: dict[str, DataFrame]) -> DataFrame:
    """All kinds of events in one table; columns a kind lacks are NULL."""
    union = None
    for kind, df in sources.items():
        tagged = df.withColumn("kind", F.lit(kind))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return union


# The facts of a job application.
JOB_FACTS = [
    "job_number", "doc_number", "job_type", "job_status", "job_status_description", "building_type", "community_board", "cluster",
    "landmarked", "adult_establishment", "loft_board", "city_owned", "little_e", "pc_filed", "efiling_filed", "job_description",
    "initial_cost", "total_estimated_fee", "fee_status", "existing_zoning_sqft", "proposed_zoning_sqft", "existing_dwelling_units",
    "proposed_dwelling_units", "existing_stories", "proposed_stories", "existing_height", "proposed_height", "zoning_district_1",
    "zoning_district_2", "zoning_district_3", "special_district_1", "special_district_2", "building_class", "latitude", "longitude",
    "council_district", "nta_name",
]


def job_facts(jobs: DataFrame) -> DataFrame:
    """The facts of each filing with its property; numbers that are blank or cannot be read are NULL, so is a blank district."""
    facts = [blank_to_null(F.col(c)).alias(c) if c == "council_district" else F.col(c) for c in JOB_FACTS]
    return jobs.select("bin", *facts)
