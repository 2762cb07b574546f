"""Entity and relationship queries (ENT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import entities as op
from fraudspark.operators.patterns import collaborations
from fraudspark.plans.patterns import branches
from fraudspark.plans.raw import RAW_ECB_SQL, RAW_JOBS_SQL, raw_ecb, raw_jobs
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.sources.schemas import ECB_VIOLATIONS, JOB_FILINGS, typed


@query("ent01_property_nodes", f"""
    WITH {RAW_ECB_SQL}, {RAW_JOBS_SQL},
    f AS (SELECT bin, boro AS borough, block, NULL AS address, 1 AS load_seq, isn AS id FROM raw_ecb
          UNION ALL SELECT bin, borough, NULL, house || ' ' || street, 2, job_number FROM raw_jobs)
    SELECT bin, borough, block, address, CAST(load_seq AS INTEGER) AS load_seq, id FROM f
    QUALIFY row_number() OVER (PARTITION BY bin ORDER BY load_seq, id) = 1""")
def ent01(r: Roles):
    ecb = typed(raw_ecb(r), ECB_VIOLATIONS).select(
        "bin", "borough", "block", F.lit(None).cast("string").alias("address"),
        F.lit(1).alias("load_seq"), F.col("violation_id").alias("id"),
    )
    jobs = typed(raw_jobs(r), JOB_FILINGS).select(
        "bin", "borough", F.lit(None).cast("string").alias("block"),
        F.concat_ws(" ", "house_number", "street").alias("address"),
        F.lit(2).alias("load_seq"), F.col("job_number").alias("id"),
    )
    return op.property_nodes(ecb.unionByName(jobs), ["load_seq", "id"])


@query("ent02_violation_nodes", """
    SELECT violation_id, bin, agency, issue_date, round(penalty, 4) AS penalty FROM violations""")
def ent02(r: Roles):
    # The load repeats one day of rows, as an overlapping incremental load does.
    rows = r.violations().select("violation_id", "bin", "agency", "issue_date", F.round("penalty", 4).alias("penalty"))
    again = rows.filter("issue_date >= '1998-01-01'")
    return op.unique_facts(rows.unionByName(again), "violation_id", ["issue_date"])


@query("ent03_ecb_nodes", f"""
    WITH {RAW_ECB_SQL}
    SELECT isn AS violation_id, bin, CASE WHEN issue_raw = 'JUNE 31' THEN NULL ELSE CAST(strptime(issue_raw, '%Y%m%d') AS DATE) END AS issue_date,
           TRY_CAST(nullif(penalty_raw, '') AS DOUBLE) AS penalty_imposed FROM raw_ecb""")
def ent03(r: Roles):
    nodes = typed(raw_ecb(r), ECB_VIOLATIONS).select("violation_id", "bin", "issue_date", "penalty_imposed")
    return op.unique_facts(nodes, "violation_id", ["issue_date"])


@query("ent04_respondent_nodes", f"""
    WITH {RAW_ECB_SQL},
    d AS (SELECT DISTINCT respondent_name AS name, CASE WHEN respondent_house <> '' THEN respondent_house || ' ' || respondent_street ELSE '' END AS address,
                 respondent_city AS city, respondent_zip AS zip FROM raw_ecb WHERE respondent_name <> '')
    SELECT *, sha256(concat_ws('|', name, address, city, zip)) AS respondent_id FROM d""")
def ent04(r: Roles):
    return op.respondent_nodes(typed(raw_ecb(r), ECB_VIOLATIONS))


@query("ent05_owner_nodes", f"""
    WITH {RAW_JOBS_SQL},
    d AS (SELECT DISTINCT CASE WHEN business <> '' THEN business WHEN first_name <> '' AND last_name <> '' THEN first_name || ' ' || last_name END AS name,
                 owner_house || ' ' || owner_street AS address FROM raw_jobs)
    SELECT name, address, '' AS city, '' AS state, '' AS zip, '' AS phone, '' AS owner_type, '' AS non_profit,
           sha256(name || '|' || address || '||||||') AS owner_id FROM d WHERE name IS NOT NULL""")
def ent05(r: Roles):
    return op.owner_nodes(typed(raw_jobs(r), JOB_FILINGS))


RAW_NAMES = {"initial_cost": "cost_raw", "existing_stories": "stories_raw"}
NUMBERS = {name: kind.upper() for _, name, kind in JOB_FILINGS if kind in ("double", "bigint")}
FACTS_SQL = ", ".join(
    f"TRY_CAST(nullif({RAW_NAMES.get(c, c)}, '') AS {NUMBERS[c]}) AS {c}" if c in NUMBERS
    else f"nullif({c}, '') AS {c}" if c == "council_district" else c for c in op.JOB_FACTS)


@query("ent06_job_facts", f"WITH {RAW_JOBS_SQL} SELECT bin, {FACTS_SQL} FROM raw_jobs")
def ent06(r: Roles):
    return op.job_facts(typed(raw_jobs(r), JOB_FILINGS))


@query("ent07_professional_nodes", f"""
    WITH {RAW_JOBS_SQL},
    d AS (SELECT DISTINCT app_first || ' ' || app_last AS name, app_title AS title, app_license AS license_number, '' AS professional_cert
          FROM raw_jobs WHERE app_first <> '')
    SELECT *, sha256(concat_ws('|', name, title, license_number, professional_cert)) AS professional_id FROM d""")
def ent07(r: Roles):
    return op.professional_nodes(typed(raw_jobs(r), JOB_FILINGS))


@query("ent08_edges", """
    SELECT DISTINCT violation_id AS src, CAST(bin AS VARCHAR) AS dst, 'VIOLATION_AT' AS rel_type FROM violations
    UNION ALL SELECT DISTINCT violation_id, CAST(respondent_id AS VARCHAR), 'ISSUED_TO' FROM violations WHERE agency = 'ECB'
    UNION ALL SELECT DISTINCT CAST(owner_id AS VARCHAR), CAST(bin AS VARCHAR), 'OWNS' FROM owns
    UNION ALL SELECT DISTINCT job_id, CAST(bin AS VARCHAR), 'JOB_APPLICATION_AT' FROM jobs
    UNION ALL SELECT DISTINCT CAST(contractor_id AS VARCHAR), job_id, 'FILED_APPLICATION' FROM jobs""")
def ent08(r: Roles):
    violations, jobs = r.violations(), r.jobs()
    return (
        op.edges(violations, "violation_id", "bin", "VIOLATION_AT")
        .unionByName(op.edges(violations.filter("agency = 'ECB'"), "violation_id", "respondent_id", "ISSUED_TO"))
        .unionByName(op.edges(r.owns(), "owner_id", "bin", "OWNS"))
        .unionByName(op.edges(jobs, "job_id", "bin", "JOB_APPLICATION_AT"))
        .unionByName(op.edges(jobs, "contractor_id", "job_id", "FILED_APPLICATION"))
    )


MEMBERS_SQL = """
    , members AS (SELECT address_key, owner_id, property_count, n_members, first_member,
                         CAST(sum(property_count) OVER (PARTITION BY address_key) AS BIGINT) AS total_properties
                  FROM holding JOIN crowd USING (address_key))
"""


@query("ent09_same_address_edges", branches(MEMBERS_SQL + """
    , known AS (SELECT x.address_key, unnest([x.owner_id, y.owner_id]) AS owner_id FROM members x JOIN members y
                ON x.address_key = y.address_key AND x.owner_id % 5 = 0 AND y.owner_id = x.owner_id + 25),
      k AS (SELECT address_key, owner_id, count(*) AS n_known FROM known GROUP BY ALL)
    SELECT address_key, owner_id, first_member, n_members, n_members - 1 - coalesce(n_known, 0) AS n_new, 1.0::DOUBLE AS similarity,
           'exact_address' AS match_type, property_count, total_properties
    FROM members LEFT JOIN k USING (address_key, owner_id) WHERE n_members - 1 > coalesce(n_known, 0)"""))
def ent09(r: Roles):
    # Existing links: every fifth owner is known to be tied to the one 25 places on.
    known = r.owners().filter("owner_id % 5 = 0").select(
        F.col("owner_id").alias("a"), (F.col("owner_id") + 25).alias("b")
    )
    return op.same_address_edges(r.owners(), r.owns(), known)


FUZZY_SQL = """
    , fuzzy AS (SELECT x.address_key AS a, y.address_key AS b, CAST(levenshtein(x.address_key, y.address_key) AS INTEGER) AS distance,
                       x.n_owners AS n_owners_a, x.n_properties AS n_properties_a, y.n_owners AS n_owners_b, y.n_properties AS n_properties_b
                FROM totals x JOIN totals y ON x.address_key < y.address_key
                WHERE levenshtein(x.address_key, y.address_key) <= {k})
"""


@query("ent10_near_address_edges", branches(FUZZY_SQL.format(k=2) + """
    SELECT a, b, distance AS edit_distance, round(1 - distance / 10.0, 4)::DOUBLE AS similarity, 'fuzzy_address' AS match_type,
           n_properties_a + n_properties_b AS total_properties FROM fuzzy"""))
def ent10(r: Roles):
    return op.near_address_edges(r.owners(), r.owns())


@query("ent11_potential_shells", branches(MEMBERS_SQL + """
    SELECT x.address_key, x.owner_id, x.property_count,
           CASE WHEN x.property_count + y.property_count >= 10 THEN 0.9 WHEN x.property_count + y.property_count >= 5 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
           count(*) AS n_links FROM members x JOIN members y ON x.address_key = y.address_key AND x.owner_id <> y.owner_id
    WHERE x.property_count + y.property_count >= 3 GROUP BY ALL"""))
def ent11(r: Roles):
    return op.potential_shells(op.same_address_edges(r.owners(), r.owns()))


@query("ent12_collaborated_with", """
    WITH w AS (SELECT bin, contractor_id, count(*) AS n FROM jobs GROUP BY 1, 2)
    SELECT x.contractor_id AS a, y.contractor_id AS b, CAST(sum(x.n * y.n) AS BIGINT) AS job_count, count(*) AS property_count
    FROM w x JOIN w y ON x.bin = y.bin AND x.contractor_id < y.contractor_id GROUP BY 1, 2 HAVING sum(x.n * y.n) >= 2""")
def ent12(r: Roles):
    return collaborations(r.jobs()).select("a", "b", F.col("times").alias("job_count"), F.col("n_properties").alias("property_count"))


GRAPH_SQL = """
    rel AS (
      SELECT 'permit:' || job_id AS src, 'applicant:' || owner_id AS dst, 'applied_by' AS rel_type, filing_date AS ts, 1.0::DOUBLE AS weight FROM jobs JOIN owns USING (bin)
      UNION ALL SELECT 'permit:' || job_id, 'contractor:' || contractor_id, 'contractor', filing_date, 1.0 FROM jobs JOIN owns USING (bin)
      UNION ALL SELECT 'permit:' || job_id, 'property:' || bin, 'for_property', filing_date, 1.0 FROM jobs JOIN owns USING (bin)
      UNION ALL SELECT 'applicant:' || owner_id, 'property:' || bin, 'owns', filing_date, 0.8 FROM jobs JOIN owns USING (bin)
      UNION ALL SELECT 'violation:' || violation_id, 'respondent:' || respondent_id, 'issued_to', issue_date, 1.0 FROM violations
      UNION ALL SELECT 'violation:' || violation_id, 'property:' || bin, 'at_property', issue_date, 1.0 FROM violations
      UNION ALL SELECT 'complaint:' || complaint_id, 'property:' || bin, 'about_property', date_entered, 1.0 FROM complaints)
"""


def relationship_graph(r: Roles):
    permits = r.jobs().join(r.owns(), "bin").select(
        F.col("job_id").alias("permit_id"), F.col("owner_id").alias("applicant_id"), "contractor_id",
        F.col("bin").alias("property_id"), F.col("filing_date").alias("ts"),
    )
    violations = r.violations().select(
        "violation_id", "respondent_id", F.col("bin").alias("property_id"), F.col("issue_date").alias("ts")
    )
    complaints = r.complaints().select(
        "complaint_id", F.col("bin").alias("property_id"), F.col("date_entered").alias("ts")
    )
    return op.relationship_graph(permits, violations, complaints)


@query("ent13_relationship_edges", "WITH " + GRAPH_SQL + """
    SELECT rel_type, count(*) AS n, round(sum(weight), 4) AS total_weight, min(ts) AS first_day, max(ts) AS last_day,
           count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM rel GROUP BY 1""")
def ent13(r: Roles):
    return op.relationship_counts(relationship_graph(r))


@query("ent14_inspectors", """
    SELECT respondent_id, count(*) AS n_inspections, min(issue_date) AS first_day, max(issue_date) AS last_day,
           string_agg(DISTINCT agency, ',' ORDER BY agency) AS areas FROM violations GROUP BY 1""")
def ent14(r: Roles):
    out = op.inspectors(r.violations(), "respondent_id", "issue_date", "agency")
    return out.withColumn("areas", F.array_join("areas", ","))


@query("ent15_event_table", """
    SELECT 'violation' AS kind, bin, issue_date AS date, round(penalty, 4) AS penalty, NULL AS contractor_id, NULL AS category, NULL AS case_type, NULL AS class, NULL AS occupancy FROM violations
    UNION ALL SELECT 'permit', bin, filing_date, NULL, contractor_id, NULL, NULL, NULL, NULL FROM jobs
    UNION ALL SELECT 'complaint', bin, date_entered, NULL, NULL, category, NULL, NULL, NULL FROM complaints
    UNION ALL SELECT 'litigation', o_orderkey, CAST(o_orderdate AS DATE), round(o_totalprice, 4), NULL, NULL, o_orderpriority, NULL, NULL FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT 'maintenance', l_orderkey, CAST(l_shipdate AS DATE), NULL, l_suppkey, NULL, NULL, chr(CAST(65 + l_linenumber % 3 AS INTEGER)), NULL FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT 'certificate', o_orderkey, CAST(o_orderdate AS DATE), NULL, NULL, NULL, NULL, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'""")
def ent15(r: Roles):
    day = lambda c: F.col(c).cast("date").alias("date")
    cases = r.table("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    upkeep = r.table("lineitem").filter("l_linestatus = 'F'")
    finished = r.table("orders").filter("o_orderstatus <> 'O'")
    return op.event_table({
        "violation": r.violations().select("bin", F.col("issue_date").alias("date"), F.round("penalty", 4).alias("penalty")),
        "permit": r.jobs().select("bin", F.col("filing_date").alias("date"), "contractor_id"),
        "complaint": r.complaints().select("bin", F.col("date_entered").alias("date"), "category"),
        "litigation": cases.select(
            F.col("o_orderkey").alias("bin"), day("o_orderdate"), F.round("o_totalprice", 4).alias("penalty"), F.col("o_orderpriority").alias("case_type")),
        "maintenance": upkeep.select(
            F.col("l_orderkey").alias("bin"), day("l_shipdate"), F.col("l_suppkey").alias("contractor_id"), F.char(65 + F.col("l_linenumber") % 3).alias("class")),
        "certificate": finished.select(F.col("o_orderkey").alias("bin"), day("o_orderdate"), F.col("o_orderstatus").alias("occupancy")),
    })
