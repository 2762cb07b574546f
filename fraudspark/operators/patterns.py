"""Fraud patterns over owners, properties, jobs, contractors and violations.

Tables carry these columns: owners(owner_id, owner_name, owner_address), owns(owner_id, bin),
jobs(job_id, bin, contractor_id, job_type, filing_date), violations(violation_id, bin, ...).
Fact tables are reduced to the join key before any join, so their counts never multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.numbers import ratio
from fraudspark.functions.text import normalize_address
from fraudspark.operators.enrich import count_per, with_branches
from fraudspark.operators.ordered import running
from fraudspark.operators.pairs import group_members, similar_strings
from fraudspark.session import cut_lineage


# --- properties -------------------------------------------------------------------------------

def violated_properties(
    properties: DataFrame, violations: DataFrame, jobs: DataFrame, *, at_least: int = 2, top: int = 10
) -> DataFrame:
    """Properties with the most violations over two agencies, with their job counts."""
    per_bin = violations.groupBy("bin").agg(
        F.count_if(F.col("agency") == "DOB").alias("dob_violations"),
        F.count_if(F.col("agency") == "ECB").alias("ecb_violations"),
        F.count("*").alias("total_violations"),
    )
    worst = per_bin.filter(F.col("total_violations") >= at_least)
    named = properties.select("bin", "address", "borough").join(worst, "bin")
    ranked = named.orderBy(F.desc("total_violations"), "bin").limit(top)
    return with_branches(ranked, ["bin"], [count_per(jobs, ["bin"], "job_applications")])


def violations_by_borough(properties: DataFrame, violations: DataFrame) -> DataFrame:
    """Violations per property in each borough."""
    per_bin = violations.groupBy("bin").agg(
        F.count_if(F.col("agency") == "DOB").alias("dob_violations"),
        F.count_if(F.col("agency") == "ECB").alias("ecb_violations"),
    )
    placed = properties.select("bin", "borough").filter("borough <> ''")
    return (
        with_branches(placed, ["bin"], [per_bin])
        .groupBy("borough")
        .agg(
            F.count("*").alias("properties"),
            F.sum("dob_violations").alias("dob_violations"),
            F.sum("ecb_violations").alias("ecb_violations"),
        )
        .withColumn("total_violations", F.col("dob_violations") + F.col("ecb_violations"))
        .withColumn(
            "violations_per_property",
            F.round(ratio(F.col("total_violations"), F.col("properties")), 2),
        )
    )


def violation_type_spread(violations: DataFrame, *, top: int = 10) -> DataFrame:
    """Properties with the most distinct violation types."""
    return (
        violations.groupBy("bin")
        .agg(F.countDistinct("violation_type").alias("n_types"))
        .orderBy(F.desc("n_types"), "bin")
        .limit(top)
    )


# --- people and companies ---------------------------------------------------------------------

def repeat_parties(
    facts: DataFrame,
    properties: DataFrame,
    party: str,
    *,
    count_name: str,
    at_least: int = 2,
    top: int = 10,
) -> DataFrame:
    """Parties with the most facts: count, distinct properties, three sample addresses."""
    per_bin = facts.groupBy(party, "bin").agg(F.count("*").alias("_n"))
    busiest = (
        per_bin.groupBy(party)
        .agg(F.sum("_n").alias(count_name), F.count("*").alias("property_count"))
        .filter(F.col(count_name) >= at_least)
        .orderBy(F.desc(count_name), party)
        .limit(top)
    )
    addressed = per_bin.join(busiest.select(party), party, "left_semi").join(
        properties.select("bin", "address"), "bin"
    )
    sample = three_smallest(addressed, party, "address").withColumnRenamed("values", "sample_addresses")
    return busiest.join(sample, party, "left")


def three_smallest(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the three smallest distinct values, without holding the key's list.

    Each round takes the minimum above the last one, a partially aggregated query.
    """
    found = df.groupBy(key).agg(F.min(value).alias("v1"))
    for prev, cur in (("v1", "v2"), ("v2", "v3")):
        above = df.join(found, key).filter(F.col(value) > F.col(prev))
        found = found.join(above.groupBy(key).agg(F.min(value).alias(cur)), key, "left")
    return found.select(key, F.array_compact(F.array("v1", "v2", "v3")).alias("values"))


def owners_with_violations_and_jobs(
    owns: DataFrame, violations: DataFrame, jobs: DataFrame, *, top: int = 10
) -> DataFrame:
    """Owners by violations on properties that also have job applications."""
    per_bin = violations.groupBy("bin").agg(
        F.count_if(F.col("agency") == "DOB").alias("dob"),
        F.count_if(F.col("agency") == "ECB").alias("ecb"),
    )
    both = per_bin.join(count_per(jobs, ["bin"], "n_jobs"), "bin").filter("dob + ecb > 0")
    return (
        owns.distinct()
        .join(both, "bin")
        .groupBy("owner_id")
        .agg(
            F.count("*").alias("properties_owned"),
            F.sum("dob").alias("total_dob_violations"),
            F.sum("ecb").alias("total_ecb_violations"),
            F.sum("n_jobs").alias("total_job_applications"),
            F.sum(F.col("dob") + F.col("ecb")).alias("total_violations"),
        )
        .orderBy(F.desc("total_violations"), "owner_id")
        .limit(top)
    )


def penalties_by_type(violations: DataFrame, *, at_least: int = 5, top: int = 10) -> DataFrame:
    return (
        violations.filter(F.col("penalty").isNotNull())
        .groupBy("violation_type")
        .agg(
            F.count("*").alias("violation_count"),
            F.round(F.avg("penalty"), 2).alias("avg_penalty"),
            F.round(F.sum("penalty"), 2).alias("total_penalties"),
            F.round(F.max("penalty"), 2).alias("max_penalty"),
        )
        .filter(F.col("violation_count") >= at_least)
        .orderBy(F.desc("total_penalties"))
        .limit(top)
    )


def central_entities(edges: DataFrame, source: str, target: str, *, at_least: int) -> DataFrame:
    """Entities linked to many distinct targets."""
    return (
        edges.groupBy(source)
        .agg(F.countDistinct(target).alias("connections"))
        .filter(F.col("connections") >= at_least)
    )


# --- portfolios -------------------------------------------------------------------------------

def owner_contractors(owns: DataFrame, jobs: DataFrame) -> DataFrame:
    """(owner_id, contractor_id, n_jobs, n_properties)."""
    return (
        jobs.groupBy("bin", "contractor_id")
        .agg(F.count("*").alias("n"))
        .join(owns.distinct(), "bin")
        .groupBy("owner_id", "contractor_id")
        .agg(F.sum("n").alias("n_jobs"), F.count("*").alias("n_properties"))
    )


def owner_violation_types(owns: DataFrame, violations: DataFrame) -> DataFrame:
    """(owner_id, violation_type, n_violations)."""
    return (
        violations.groupBy("bin", "violation_type")
        .agg(F.count("*").alias("n"))
        .join(owns.distinct(), "bin")
        .groupBy("owner_id", "violation_type")
        .agg(F.sum("n").alias("n_violations"))
    )


def property_counts(owns: DataFrame) -> DataFrame:
    return owns.distinct().groupBy("owner_id").agg(F.count("*").alias("property_count"))


def portfolio(
    owners: DataFrame, owns: DataFrame, jobs: DataFrame, violations: DataFrame, *, at_least: int = 2
) -> DataFrame:
    """Owners of several properties with the work and violations on them.

    Violation types come from a short code list and are given as an array; properties and
    contractors are counted here and listed by `portfolio_members`.
    """
    held = property_counts(owns).filter(F.col("property_count") >= at_least)
    work = owner_contractors(owns, jobs).groupBy("owner_id").agg(
        F.count("*").alias("contractors_used"), F.sum("n_jobs").alias("total_jobs")
    )
    found = owner_violation_types(owns, violations).groupBy("owner_id").agg(
        F.sum("n_violations").alias("total_violations"),
        F.array_sort(F.collect_set("violation_type")).alias("violation_types"),
    )
    return with_branches(owners.join(held, "owner_id"), ["owner_id"], [work, found])


def portfolio_members(
    owns: DataFrame, jobs: DataFrame, *, at_least: int = 2
) -> DataFrame:
    """(owner_id, kind, member_id, n): the properties and contractors behind `portfolio`."""
    several = property_counts(owns).filter(F.col("property_count") >= at_least).select("owner_id")
    held = owns.distinct().select(
        "owner_id", F.lit("property").alias("kind"), F.col("bin").alias("member_id"),
        F.lit(1).cast("bigint").alias("n"),
    )
    used = owner_contractors(owns, jobs).select(
        "owner_id", F.lit("contractor").alias("kind"), F.col("contractor_id").alias("member_id"),
        F.col("n_jobs").alias("n"),
    )
    return held.unionByName(used).join(several, "owner_id", "left_semi")


TIMELINE = ["filing_date", "bin", "job_type", "job_status", "job_id"]


def job_timelines(owns: DataFrame, jobs: DataFrame, *, at_least: int = 2) -> DataFrame:
    """Dated jobs over all properties of an owner of several: one row per job with its `position` in time.

    One form at every size: an owner's jobs are never put in one row.
    """
    several = property_counts(owns).filter(F.col("property_count") >= at_least).select("owner_id")
    dated = jobs.filter(F.col("filing_date").isNotNull()).join(owns.distinct(), "bin").join(several, "owner_id", "left_semi")
    stored = cut_lineage(dated.select("owner_id", *TIMELINE), "dated")
    placed = running(stored, ["owner_id"], TIMELINE, sums={"position": F.lit(1).cast("long")})
    return placed.select("owner_id", "position", *TIMELINE)


def timeline_headers(timelines: DataFrame) -> DataFrame:
    """(owner_id, n_jobs, n_properties, first_filing, last_filing): one row per owner over `job_timelines`."""
    return timelines.groupBy("owner_id").agg(
        F.count("*").alias("n_jobs"), F.countDistinct("bin").alias("n_properties"),
        F.min("filing_date").alias("first_filing"), F.max("filing_date").alias("last_filing"))


def dense_portfolios(
    owns: DataFrame, violations: DataFrame, *, min_properties: int, min_density: float
) -> DataFrame:
    """Owners of many properties with many violations per property."""
    per_owner = (
        count_per(violations, ["bin"], "n")
        .join(owns.distinct(), "bin")
        .groupBy("owner_id")
        .agg(F.sum("n").alias("n_violations"))
    )
    return (
        with_branches(property_counts(owns), ["owner_id"], [per_owner])
        .withColumn(
            "violations_per_property", F.round(ratio(F.col("n_violations"), F.col("property_count")), 4)
        )
        .filter(
            (F.col("property_count") >= min_properties)
            & (F.col("violations_per_property") >= min_density)
        )
    )


# --- shell companies --------------------------------------------------------------------------

def with_address_key(owners: DataFrame) -> DataFrame:
    return owners.withColumn("address_key", normalize_address(F.col("owner_address"))).filter(
        "address_key <> ''"
    )


def shared_address_owners(owners: DataFrame, owns: DataFrame) -> DataFrame:
    """Owners that share an address: (address_key, owner_id, property_count, n_members, first_member, total_properties).

    Any two owners of an address are a pair; `total_properties` is that of the whole group.
    """
    holding = with_address_key(owners).join(property_counts(owns), "owner_id")
    members = group_members(holding, "address_key", "owner_id", ["property_count"])
    return members.withColumnRenamed("total_property_count", "total_properties")


def shared_address_properties(owners: DataFrame, owns: DataFrame) -> DataFrame:
    """(address_key, owner_id, bin): the properties behind `shared_address_owners`."""
    places = shared_address_owners(owners, owns).select("address_key", "owner_id")
    return owns.distinct().join(places, "owner_id").select("address_key", "owner_id", "bin")


def address_totals(owners: DataFrame, owns: DataFrame) -> DataFrame:
    """(address_key, n_owners, n_properties) over owners that own something."""
    keyed = with_address_key(owners).select("owner_id", "address_key")
    return (
        keyed.join(property_counts(owns), "owner_id")
        .groupBy("address_key")
        .agg(F.count("*").alias("n_owners"), F.sum("property_count").alias("n_properties"))
    )


def similar_addresses(owners: DataFrame, owns: DataFrame, *, max_distance: int = 3) -> DataFrame:
    """Address pairs within an edit distance, with the owners and properties on each side.

    Any owner at the first address and any at the second are a pair of similar owners; the
    owners of an address are rows of `with_address_key`.
    """
    totals = address_totals(owners, owns)
    links = similar_strings(totals, "address_key", max_distance)
    side = lambda s: totals.select(
        F.col("address_key").alias(s), F.col("n_owners").alias(f"n_owners_{s}"),
        F.col("n_properties").alias(f"n_properties_{s}"),
    )
    return links.join(side("a"), "a").join(side("b"), "b")


def address_links(owners: DataFrame, *, max_distance: int = 2) -> DataFrame:
    """(a, b, distance): addresses of two or more owners (a = b), and near addresses."""
    keyed = with_address_key(owners)
    same = (
        keyed.groupBy("address_key")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("address_key").alias("a"), F.col("address_key").alias("b"), F.lit(0).alias("distance"))
    )
    # Read by several branches of the callers.
    return cut_lineage(same.unionByName(similar_strings(keyed, "address_key", max_distance)), "links")


def _address_contractors(owners: DataFrame, owns: DataFrame, jobs: DataFrame) -> DataFrame:
    keyed = with_address_key(owners).select("owner_id", "address_key")
    return (
        owner_contractors(owns, jobs)
        .join(keyed, "owner_id")
        .groupBy("address_key", "contractor_id")
        .agg(
            F.sum("n_jobs").alias("n_jobs"),
            F.sum("n_properties").alias("n_properties"),
            F.count("*").alias("n_owners"),
        )
    )


# Rows of an address and a contractor that one task takes to their links.
SERVED_ROWS = 100_000


def work_over_related_owners(
    owners: DataFrame, owns: DataFrame, jobs: DataFrame, violations: DataFrame, *, max_distance: int = 2
) -> DataFrame:
    """Jobs, contractors and violations over owners whose addresses are equal or near."""
    links = address_links(owners, max_distance=max_distance)
    # Stored, so that a link keeps its number.
    links = cut_lineage(links.withColumn("link", F.monotonically_increasing_id()), "numbered")
    ends = links.select("link", F.explode(F.array_distinct(F.array("a", "b"))).alias("address_key"))
    keyed = with_address_key(owners).select("owner_id", "address_key")
    found = (
        count_per(violations, ["bin"], "n")
        .join(owns.distinct(), "bin")
        .join(keyed, "owner_id")
        .groupBy("address_key")
        .agg(F.sum("n").alias("total_violations"))
    )
    totals = with_branches(address_totals(owners, owns), ["address_key"], [found])
    sums = (
        ends.join(totals, "address_key")
        .groupBy("link")
        .agg(
            F.sum("n_owners").alias("n_owners"),
            F.sum("n_properties").alias("n_properties"),
            F.sum("total_violations").alias("total_violations"),
        )
    )
    # Dealt by contractor before the links multiply the rows, so that the repeats of a contractor are found where they are.
    served = cut_lineage(_address_contractors(owners, owns, jobs).select("address_key", "contractor_id", "n_jobs"), "served")
    parts = max(1, served.count() // SERVED_ROWS, int(served.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = (
        served.repartition(parts, "contractor_id").join(ends, "address_key")
        .groupBy("link", "contractor_id")
        .agg(F.sum("n_jobs").alias("n_jobs"))
        .groupBy("link")
        .agg(F.count("*").alias("n_contractors"), F.sum("n_jobs").alias("total_jobs"))
    )
    return links.select("link", "a", "b", "distance").join(with_branches(sums, ["link"], [work]), "link").drop("link")


def contractors_of_shell_owners(owners: DataFrame, owns: DataFrame, jobs: DataFrame) -> DataFrame:
    """Contractors, properties and jobs over the owners at one address: one row per shared address."""
    work = _address_contractors(owners, owns, jobs).groupBy("address_key").agg(
        F.count("*").alias("n_contractors"), F.sum("n_jobs").alias("total_jobs")
    )
    return address_totals(owners, owns).filter("n_owners > 1").join(work, "address_key")


def owner_fraud_scores(
    owners: DataFrame, owns: DataFrame, jobs: DataFrame, violations: DataFrame
) -> DataFrame:
    """3 x owners at the same address, +2 above 5 properties, +2 with more violations than properties."""
    counts = property_counts(owns)
    holding = with_address_key(owners).join(counts, "owner_id", "left_semi")
    sharing = group_members(holding, "address_key", "owner_id").select(
        "owner_id", (F.col("n_members") - 1).alias("address_sharing_count")
    )
    work = owner_contractors(owns, jobs).groupBy("owner_id").agg(
        F.count("*").alias("contractor_count"), F.sum("n_jobs").alias("job_count")
    )
    found = (
        count_per(violations, ["bin"], "n")
        .join(owns.distinct(), "bin")
        .groupBy("owner_id")
        .agg(F.sum("n").alias("violation_count"))
    )
    scored = with_branches(owners.join(counts, "owner_id"), ["owner_id"], [sharing, work, found])
    return scored.withColumn(
        "fraud_risk_score",
        F.col("address_sharing_count") * 3
        + F.when(F.col("property_count") > 5, 2).otherwise(0)
        + F.when(F.col("violation_count") > F.col("property_count"), 2).otherwise(0),
    )


def fraud_rings(
    owners: DataFrame, owns: DataFrame, jobs: DataFrame, *, max_distance: int = 2
) -> DataFrame:
    """Contractors that worked for owners at equal or near addresses.

    One row per address link and contractor; the ring's owner pairs are any owner behind the
    first address with any behind the second.
    """
    served = _address_contractors(owners, owns, jobs)
    links = address_links(owners, max_distance=max_distance)
    side = lambda s: served.select(
        F.col("address_key").alias(s), "contractor_id",
        F.col("n_owners").alias(f"n_owners_{s}"), F.col("n_properties").alias(f"n_properties_{s}"),
    )
    linked = links.join(side("a"), "a").join(side("b"), ["b", "contractor_id"])
    return linked.filter("distance > 0 OR n_owners_a > 1")


# --- contractors ------------------------------------------------------------------------------

# Rows of a property and a contractor for each task that pairs them.
WORKS_ROWS = 250_000


def collaborations(jobs: DataFrame, *, at_least: int = 2, block_size: int = 64) -> DataFrame:
    """Contractor pairs working on the same properties: (a, b, times, n_properties) with a < b.

    A pair's count is the sum over shared properties of the product of their job counts. The
    contractors of a property are dealt into blocks of about `block_size` by a hash, and block
    meets block, so a crowded property is joined by many tasks. The result does not depend on it.
    """
    # Read by the block counts and by both sides of the join.
    known = jobs.na.drop(subset=["bin", "contractor_id"])
    works = cut_lineage(known.groupBy("bin", "contractor_id").agg(F.count("*").alias("n")), "works")
    blocks = works.groupBy("bin").agg(F.ceil(F.count("*") / block_size).cast("int").alias("_blocks"))
    # Stored, so that the join can split a hot property at run time.
    placed = works.join(cut_lineage(blocks, "blocks"), "bin").withColumn(
        "_block", F.pmod(F.xxhash64("contractor_id"), F.col("_blocks")).cast("int")
    )
    # As many tasks as the rows need, so that a task's memory does not grow with the table.
    parts = max(int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")), works.count() // WORKS_ROWS)
    dealt = lambda df: df.repartition(parts, "bin", "_i", "_j")
    left = dealt(placed.select(
        "bin", F.col("_block").alias("_i"), F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_j"),
        F.col("contractor_id").alias("_x"), F.col("n").alias("_nx"),
    ))
    right = dealt(placed.select(
        "bin", F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"), F.col("_block").alias("_j"),
        F.col("contractor_id").alias("_y"), F.col("n").alias("_ny"),
    ))
    met = left.hint("merge").join(right, ["bin", "_i", "_j"]).filter("_i < _j OR _x < _y")
    return (
        met.groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
        .agg(F.sum(F.col("_nx") * F.col("_ny")).alias("times"), F.count("*").alias("n_properties"))
        .filter(F.col("times") >= at_least)
    )


def contractor_profiles(contractors: DataFrame, jobs: DataFrame, properties: DataFrame) -> DataFrame:
    """Job types, boroughs and ZIP codes of a contractor; all three are short code lists."""
    spread = (
        jobs.groupBy("bin", "contractor_id", "job_type")
        .agg(F.count("*").alias("n"))
        .join(properties.select("bin", "borough", "zipcode"), "bin")
        .groupBy("contractor_id", "job_type", "borough", "zipcode")
        .agg(F.sum("n").alias("n"))
        .groupBy("contractor_id")
        .agg(
            F.sum("n").alias("total_jobs"),
            F.array_sort(F.collect_set("job_type")).alias("job_types"),
            F.array_sort(F.collect_set("borough")).alias("boroughs"),
            F.array_sort(F.collect_set("zipcode")).alias("zipcodes"),
        )
    )
    return (
        contractors.select("contractor_id", "business_name", "license_type")
        .join(spread, "contractor_id")
        .withColumn("job_type_diversity", F.size("job_types").cast("bigint"))
        .withColumn("borough_diversity", F.size("boroughs").cast("bigint"))
    )


def filing_concentration(jobs: DataFrame) -> DataFrame:
    """Share of all filings per licence, and how far it is from the mean in deviations."""
    per_license = count_per(jobs, ["contractor_id"], "filings")
    overall = per_license.agg(
        F.sum("filings").alias("total"), F.avg("filings").alias("mean"), F.stddev("filings").alias("spread")
    )
    total, mean, spread = (overall.select(c).scalar() for c in ("total", "mean", "spread"))
    return per_license.select(
        "contractor_id",
        "filings",
        F.round(ratio(F.col("filings"), total), 6).alias("share"),
        F.round(ratio(F.col("filings") - mean, spread), 4).alias("z_score"),
    )


def dismissal_rates(facts: DataFrame, keys: list[str], dismissed: str) -> DataFrame:
    """Share of dismissed facts per group, and relative to the share over all facts."""
    counted = facts.withColumn("_d", F.when(F.expr(dismissed), 1.0).otherwise(0.0))
    overall = counted.agg(F.avg("_d").alias("r")).scalar()
    return (
        counted.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.avg("_d").alias("_rate"))
        .select(
            *keys,
            "n",
            F.round("_rate", 4).alias("dismissal_rate"),
            F.round(ratio(F.col("_rate"), overall), 4).alias("vs_overall"),
        )
    )


# --- contract fraud ---------------------------------------------------------------------------

# Thresholds of the contract patterns.
PASS_THROUGH_MARKUP = 0.03
MIN_CONTRACT_VALUE = 50_000
CONTROL_PERCENT = 50
CUSTOMER_SHARE = 0.95
SHELL_EMPLOYEES = 3
SHELL_REVENUE = 100_000
SHELL_CONTRACTS = 5
TIMING_DAYS = 30


def pass_through(
    contracts: DataFrame, companies: DataFrame, *, max_markup: float = PASS_THROUGH_MARKUP,
    min_value: float = MIN_CONTRACT_VALUE,
) -> DataFrame:
    """Subcontracts to certified firms at a very small markup."""
    certified = companies.filter("dbe_certified").select("company_id")
    return contracts.filter(
        (F.col("markup") <= max_markup) & (F.col("contract_value") > min_value)
    ).join(certified, "company_id")


def control_fraud(
    controls: DataFrame, persons: DataFrame, companies: DataFrame, *, above: float = CONTROL_PERCENT
) -> DataFrame:
    """Certified firms controlled by someone outside the minority group."""
    certified = companies.filter("dbe_certified").select("company_id")
    outsiders = persons.filter("NOT minority_status").select("person_id")
    return (
        controls.filter(F.col("control_percentage") > above)
        .join(certified, "company_id")
        .join(outsiders, "person_id")
    )


def single_customer(
    contracts: DataFrame, companies: DataFrame, *, share: float = CUSTOMER_SHARE
) -> DataFrame:
    """Certified firms with one customer, or nearly all revenue from one."""
    certified = companies.filter("dbe_certified").select("company_id")
    return (
        contracts.groupBy("company_id", "customer_id")
        .agg(F.sum("contract_value").alias("revenue"))
        .groupBy("company_id")
        .agg(
            F.count("*").alias("customer_count"),
            F.sum("revenue").alias("total_revenue"),
            F.max("revenue").alias("largest"),
        )
        .withColumn("largest_share", ratio(F.col("largest"), F.col("total_revenue")))
        .filter((F.col("customer_count") == 1) | (F.col("largest_share") > share))
        .join(certified, "company_id")
        .select(
            "company_id", "customer_count", F.round("total_revenue", 2).alias("total_revenue"),
            F.round("largest_share", 6).alias("largest_share"),
        )
    )


def shell_companies(
    companies: DataFrame, *, employees: int = SHELL_EMPLOYEES, revenue: float = SHELL_REVENUE,
    contracts: int = SHELL_CONTRACTS,
) -> DataFrame:
    return companies.filter(
        (F.col("employee_count") <= employees)
        & (F.col("annual_revenue") > revenue)
        & (F.col("contract_count") > contracts)
    )


def suspicious_timing(milestones: DataFrame, *, days: int = TIMING_DAYS) -> DataFrame:
    """Companies formed, certified and awarded a contract within a few days."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("date")))
    dated = milestones.groupBy("company_id").agg(
        first("formation").alias("formed"),
        first("certification").alias("certified"),
        first("award").alias("awarded"),
    )
    span = F.datediff(
        F.greatest("formed", "certified", "awarded"), F.least("formed", "certified", "awarded")
    )
    complete = dated.na.drop()
    return complete.withColumn("span_days", span).filter(F.col("span_days") <= days)
