"""Join queries (JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import joins as op
from fraudspark.operators import patterns as pt
from fraudspark.operators.aggregates import top_or_other
from fraudspark.operators.enrich import count_per, with_branches
from fraudspark.operators.pairs import related_pairs_missing
from fraudspark.plans.entities import FUZZY_SQL, MEMBERS_SQL
from fraudspark.plans.patterns import branches
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles


@query("jn01_shared_address_pairs", branches(MEMBERS_SQL + "SELECT * FROM members"))
def jn01(r: Roles):
    return pt.shared_address_owners(r.owners(), r.owns())


@query("jn01_shared_address_properties", branches(MEMBERS_SQL + "SELECT DISTINCT address_key, owner_id, bin FROM members JOIN owns USING (owner_id)"))
def jn01_properties(r: Roles):
    return pt.shared_address_properties(r.owners(), r.owns())


@query("jn02_similar_addresses", branches(FUZZY_SQL.format(k=3) + "SELECT * FROM fuzzy"))
def jn02(r: Roles):
    return pt.similar_addresses(r.owners(), r.owns())


def group_members_sql(source: str, key: str, member: str) -> str:
    """SQL for the members of keys that two or more hold."""
    return f"""
    grouped AS (SELECT * FROM (SELECT {key}, {member}, count(*) OVER (PARTITION BY {key}) AS n_members,
                                      min({member}) OVER (PARTITION BY {key}) AS first_member
                               FROM (SELECT DISTINCT {key}, {member} FROM {source})) WHERE n_members > 1)"""


COMPANY_SQL = """
    c AS (SELECT s_suppkey AS id, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name_key, n_name AS address_key
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("jn03_similar_name_or_same_address", f"""
    WITH {COMPANY_SQL}, {group_members_sql("c", "address_key", "id")}
    SELECT 'similar_name' AS kind, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST(levenshtein(x.name_key, y.name_key) AS INTEGER) AS name_distance,
           CAST(1 AS BIGINT) AS n_a, CAST(1 AS BIGINT) AS n_b
    FROM c x JOIN c y ON x.name_key < y.name_key WHERE levenshtein(x.name_key, y.name_key) <= 2
    UNION ALL SELECT 'same_address', first_member, id, NULL, n_members, n_members FROM grouped""")
def jn03(r: Roles):
    companies = r.table("supplier").join(r.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("address_key")
    )
    return op.similar_or_colocated(companies)


@query("jn04_shared_addresses", f"""
    WITH e AS (SELECT c_name AS name, lower(trim(n_name || ' ' || c_mktsegment)) AS address_key FROM customer JOIN nation ON c_nationkey = n_nationkey),
    {group_members_sql("e", "address_key", "name")} SELECT * FROM grouped""")
def jn04(r: Roles):
    return op.shared_addresses(r.owners().withColumnRenamed("owner_name", "name"), "name", "owner_address")


@query("jn05_shared_officers", f"""
    WITH o AS (SELECT p_partkey, unnest([lower(p_name || ' ' || p_brand), lower(p_type || ' ' || p_size)]) AS officer FROM part),
    {group_members_sql("o", "officer", "p_partkey")} SELECT * FROM grouped""")
def jn05(r: Roles):
    companies = r.table("part").select(
        "p_partkey",
        F.array(F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_type", "p_size")).alias("officers"),
    )
    return op.shared_officers(companies, "p_partkey", "officers")


@query("jn06_property_enrichment", """
    WITH d AS (SELECT bin, count(*) FILTER (agency = 'DOB') AS dob, count(*) FILTER (agency = 'ECB') AS ecb FROM violations GROUP BY 1),
    j AS (SELECT bin, count(*) AS n_jobs FROM jobs GROUP BY 1), c AS (SELECT bin, count(*) AS n_complaints FROM complaints GROUP BY 1)
    SELECT bin, borough, coalesce(dob, 0) AS dob, coalesce(ecb, 0) AS ecb, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_complaints, 0) AS n_complaints
    FROM properties LEFT JOIN d USING (bin) LEFT JOIN j USING (bin) LEFT JOIN c USING (bin)""")
def jn06(r: Roles):
    found = r.violations().groupBy("bin").agg(
        F.count_if(F.col("agency") == "DOB").alias("dob"), F.count_if(F.col("agency") == "ECB").alias("ecb")
    )
    return with_branches(
        r.properties().select("bin", "borough"), ["bin"],
        [found, count_per(r.jobs(), ["bin"], "n_jobs"), count_per(r.complaints(), ["bin"], "n_complaints")],
    )


@query("jn07_unlinked_pairs", """
    SELECT DISTINCT owner_id AS a, contractor_id + 1000000 AS b FROM jobs JOIN owns USING (bin)
    EXCEPT SELECT owner_id, contractor_id + 1000000 FROM violations JOIN owns USING (bin) JOIN (SELECT DISTINCT contractor_id FROM jobs) ON contractor_id = respondent_id""")
def jn07(r: Roles):
    pair = lambda df, c: df.join(r.owns(), "bin").select(
        F.col("owner_id").alias("a"), (F.col(c) + 1_000_000).alias("b")
    )
    worked = pair(r.jobs(), "contractor_id").distinct()
    fined = pair(r.violations(), "respondent_id").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return related_pairs_missing(worked, fined)


@query("jn08_known_bins_only", "SELECT complaint_id, bin, category FROM complaints WHERE bin IN (SELECT bin FROM jobs)")
def jn08(r: Roles):
    return op.known_only(r.complaints(), r.jobs(), "bin").select("complaint_id", "bin", "category")


@query("jn09_activity_by_dataset", """
    SELECT bin, 'violations' AS dataset, count(*) AS n FROM violations GROUP BY 1 UNION ALL SELECT bin, 'jobs', count(*) FROM jobs GROUP BY 1
    UNION ALL SELECT bin, 'complaints', count(*) FROM complaints GROUP BY 1""")
def jn09(r: Roles):
    return op.activity_by_dataset(
        {"violations": r.violations(), "jobs": r.jobs(), "complaints": r.complaints()}, "bin"
    )


@query("jn10_search_datasets", """
    SELECT 'contractors' AS dataset, name, count(*) AS n FROM (SELECT s_name AS name FROM supplier) WHERE contains(name, '0007') GROUP BY 2
    UNION ALL SELECT 'owners', name, count(*) FROM (SELECT c_name AS name, c_mktsegment FROM customer)
    WHERE contains(name, '0007') OR contains(c_mktsegment, '0007') GROUP BY 2""")
def jn10(r: Roles):
    return op.search_datasets(
        {
            "contractors": (r.table("supplier").withColumnRenamed("s_name", "name"), ["name"]),
            "owners": (r.table("customer").withColumnRenamed("c_name", "name"), ["name", "c_mktsegment"]),
        },
        "0007", "name",
    )


@query("jn14_top_or_other", """
    WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 10)
    SELECT CASE WHEN l_suppkey IN (SELECT l_suppkey FROM t) THEN CAST(l_suppkey AS VARCHAR) ELSE 'Other' END AS contractor,
           count(*) AS n FROM lineitem GROUP BY 1""")
def jn14(r: Roles):
    rows = r.table("lineitem").select("l_suppkey")
    kept = top_or_other(rows, "l_suppkey", other=-1)
    name = F.when(F.col("l_suppkey") == -1, "Other").otherwise(F.col("l_suppkey").cast("string"))
    return kept.groupBy(name.alias("contractor")).agg(F.count("*").alias("n"))


@query("jn15_key_overlap", """
    WITH a AS (SELECT DISTINCT bin FROM violations), b AS (SELECT DISTINCT bin FROM complaints),
    s AS (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (bin)) AS n_both)
    SELECT *, round(n_both::DOUBLE / n_left, 6) AS left_share, round(n_both::DOUBLE / n_right, 6) AS right_share FROM s""")
def jn15(r: Roles):
    return op.key_overlap(r.violations(), r.complaints(), "bin", "bin")


@query("jn16_coordination_gaps", """
    WITH v AS (SELECT bin, count(*) FILTER (agency = 'DOB') AS n_first, count(*) FILTER (agency = 'ECB') AS n_second FROM violations GROUP BY 1)
    SELECT *, CASE WHEN n_second = 0 THEN 'first_only' ELSE 'second_only' END AS gap FROM v WHERE n_first = 0 OR n_second = 0""")
def jn16(r: Roles):
    violations = r.violations()
    return op.coordination_gaps(violations.filter("agency = 'DOB'"), violations.filter("agency = 'ECB'"), "bin")
