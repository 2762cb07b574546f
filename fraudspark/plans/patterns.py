"""Fraud-pattern queries (GP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import patterns as op
from fraudspark.operators.graph import clusters
from fraudspark.operators.joins import shared_addresses
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles

BRANCHES = """
    WITH wk AS (SELECT owner_id, contractor_id, CAST(count(*) AS BIGINT) AS n_jobs,
                       count(DISTINCT bin) AS n_properties
                FROM jobs JOIN owns USING (bin) GROUP BY 1, 2),
         held AS (SELECT owner_id, count(DISTINCT bin) AS property_count FROM owns GROUP BY 1),
         keyed AS (SELECT *, lower(regexp_replace(owner_address, '[^A-Za-z0-9]', '', 'g')) AS address_key
                   FROM owners),
         holding AS (SELECT * FROM keyed JOIN held USING (owner_id)),
         vio AS (SELECT owner_id, count(*) AS n_violations FROM violations JOIN owns USING (bin) GROUP BY 1),
         crowd AS (SELECT address_key, count(*) AS n_members, min(owner_id) AS first_member
                   FROM holding GROUP BY 1 HAVING count(*) > 1),
         totals AS (SELECT address_key, count(*) AS n_owners, CAST(sum(property_count) AS BIGINT) AS n_properties
                    FROM holding GROUP BY 1),
         addr AS (SELECT DISTINCT address_key FROM keyed),
         links AS (SELECT address_key AS a, address_key AS b, CAST(0 AS INTEGER) AS distance
                   FROM keyed GROUP BY 1 HAVING count(*) > 1
                   UNION ALL
                   SELECT x.address_key, y.address_key, CAST(levenshtein(x.address_key, y.address_key) AS INTEGER)
                   FROM addr x JOIN addr y ON x.address_key < y.address_key
                   WHERE levenshtein(x.address_key, y.address_key) <= 2),
         served AS (SELECT address_key, contractor_id, CAST(sum(n_jobs) AS BIGINT) AS n_jobs,
                           CAST(sum(n_properties) AS BIGINT) AS n_properties, count(*) AS n_owners
                    FROM wk JOIN keyed USING (owner_id) GROUP BY 1, 2)
"""


def branches(sql: str) -> str:
    return BRANCHES + sql


@query("gp01_portfolio", branches("""
    , w AS (SELECT owner_id, count(*) AS contractors_used, CAST(sum(n_jobs) AS BIGINT) AS total_jobs FROM wk GROUP BY 1),
      t AS (SELECT owner_id, count(*) AS total_violations,
                   string_agg(DISTINCT violation_type, ',' ORDER BY violation_type) AS violation_types
            FROM typed_violations JOIN owns USING (bin) GROUP BY 1)
    SELECT owner_id, owner_name, owner_address, property_count,
           coalesce(contractors_used, 0) AS contractors_used, coalesce(total_jobs, 0) AS total_jobs,
           coalesce(total_violations, 0) AS total_violations, coalesce(violation_types, '') AS violation_types
    FROM owners JOIN held USING (owner_id) LEFT JOIN w USING (owner_id) LEFT JOIN t USING (owner_id)
    WHERE property_count >= 2"""))
def gp01(r: Roles):
    out = op.portfolio(r.owners(), r.owns(), r.jobs(), r.typed_violations())
    types = F.coalesce(F.array_join("violation_types", ","), F.lit(""))
    return out.withColumn("violation_types", types)


@query("gp01_portfolio_members", branches("""
    , several AS (SELECT owner_id FROM held WHERE property_count >= 2)
    SELECT DISTINCT owner_id, 'property' AS kind, bin AS member_id, CAST(1 AS BIGINT) AS n
    FROM owns JOIN several USING (owner_id)
    UNION ALL
    SELECT owner_id, 'contractor', contractor_id, n_jobs FROM wk JOIN several USING (owner_id)"""))
def gp01_members(r: Roles):
    return op.portfolio_members(r.owns(), r.jobs())


@query("gp02_related_owner_work", branches("""
    , ends AS (SELECT a, b, distance, a AS address_key FROM links
               UNION ALL SELECT a, b, distance, b FROM links WHERE a <> b),
      tv AS (SELECT address_key, CAST(sum(n_violations) AS BIGINT) AS tv
             FROM vio JOIN keyed USING (owner_id) GROUP BY 1),
      s AS (SELECT a, b, distance, CAST(sum(n_owners) AS BIGINT) AS n_owners,
                   CAST(sum(n_properties) AS BIGINT) AS n_properties,
                   CAST(sum(coalesce(tv, 0)) AS BIGINT) AS total_violations
            FROM ends JOIN totals USING (address_key) LEFT JOIN tv USING (address_key) GROUP BY 1, 2, 3),
      w AS (SELECT a, b, count(DISTINCT contractor_id) AS n_contractors, CAST(sum(n_jobs) AS BIGINT) AS total_jobs
            FROM ends JOIN served USING (address_key) GROUP BY 1, 2)
    SELECT s.*, coalesce(n_contractors, 0) AS n_contractors, coalesce(total_jobs, 0) AS total_jobs
    FROM s LEFT JOIN w USING (a, b)"""))
def gp02(r: Roles):
    return op.work_over_related_owners(r.owners(), r.owns(), r.jobs(), r.violations())


TIMELINE_SQL = """
    , tl AS (SELECT owner_id, filing_date, bin, job_type, job_status, job_id FROM jobs JOIN owns USING (bin) JOIN held USING (owner_id)
             WHERE property_count >= 2 AND filing_date IS NOT NULL)"""


@query("gp03_job_timelines", branches(TIMELINE_SQL + """
    SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY filing_date, bin, job_type, job_status, job_id) AS position,
           filing_date, bin, job_type, job_status, job_id FROM tl"""))
def gp03(r: Roles):
    return op.job_timelines(r.owns(), r.jobs())


@query("gp03_timeline_headers", branches(TIMELINE_SQL + """
    SELECT owner_id, count(*) AS n_jobs, count(DISTINCT bin) AS n_properties, min(filing_date) AS first_filing, max(filing_date) AS last_filing
    FROM tl GROUP BY 1"""))
def gp03_headers(r: Roles):
    return op.timeline_headers(op.job_timelines(r.owns(), r.jobs()))


@query("gp04_shell_owner_contractors", branches("""
    SELECT address_key, totals.n_owners, totals.n_properties, count(DISTINCT contractor_id) AS n_contractors, CAST(sum(wk.n_jobs) AS BIGINT) AS total_jobs
    FROM totals JOIN holding USING (address_key) JOIN wk USING (owner_id) WHERE totals.n_owners > 1 GROUP BY 1, 2, 3"""))
def gp04(r: Roles):
    return op.contractors_of_shell_owners(r.owners(), r.owns(), r.jobs())


@query("gp05_contractor_profile", """
    WITH d AS (SELECT contractor_id, count(*) AS total_jobs, count(DISTINCT job_type) AS job_type_diversity,
                 string_agg(DISTINCT job_type, ',' ORDER BY job_type) AS job_types,
                 count(DISTINCT borough) AS borough_diversity,
                 string_agg(DISTINCT borough, ',' ORDER BY borough) AS boroughs,
                 string_agg(DISTINCT zipcode, ',' ORDER BY zipcode) AS zipcodes
               FROM jobs JOIN properties USING (bin) GROUP BY 1)
    SELECT contractor_id, business_name, license_type, total_jobs, job_type_diversity, job_types,
           borough_diversity, boroughs, zipcodes
    FROM contractors JOIN d USING (contractor_id)""")
def gp05(r: Roles):
    out = op.contractor_profiles(r.contractors(), r.jobs(), r.properties())
    for c in ("job_types", "boroughs", "zipcodes"):
        out = out.withColumn(c, F.array_join(c, ","))
    return out


@query("gp06_contractor_collaboration", """
    WITH w AS (SELECT bin, contractor_id, count(*) AS n FROM jobs GROUP BY 1, 2)
    SELECT x.contractor_id AS a, y.contractor_id AS b, CAST(sum(x.n * y.n) AS BIGINT) AS times, count(*) AS n_properties
    FROM w x JOIN w y ON x.bin = y.bin AND x.contractor_id < y.contractor_id
    GROUP BY 1, 2 HAVING sum(x.n * y.n) >= 2""")
def gp06(r: Roles):
    return op.collaborations(r.jobs())


@query("gp07_owner_fraud_score", branches("""
    , w AS (SELECT owner_id, count(*) AS contractor_count, CAST(sum(n_jobs) AS BIGINT) AS job_count FROM wk GROUP BY 1),
      s AS (SELECT owner_id, owner_name, owner_address, property_count,
                   coalesce(n_members - 1, 0) AS address_sharing_count,
                   coalesce(contractor_count, 0) AS contractor_count, coalesce(job_count, 0) AS job_count,
                   coalesce(n_violations, 0) AS violation_count
            FROM holding LEFT JOIN crowd USING (address_key) LEFT JOIN w USING (owner_id) LEFT JOIN vio USING (owner_id))
    SELECT *, address_sharing_count * 3 + CASE WHEN property_count > 5 THEN 2 ELSE 0 END
              + CASE WHEN violation_count > property_count THEN 2 ELSE 0 END AS fraud_risk_score FROM s"""))
def gp07(r: Roles):
    return op.owner_fraud_scores(r.owners(), r.owns(), r.jobs(), r.violations())


@query("gp08_fraud_rings", branches("""
    SELECT l.a, l.b, distance, x.contractor_id, x.n_owners AS n_owners_a, x.n_properties AS n_properties_a,
           y.n_owners AS n_owners_b, y.n_properties AS n_properties_b
    FROM links l JOIN served x ON x.address_key = l.a
    JOIN served y ON y.address_key = l.b AND y.contractor_id = x.contractor_id
    WHERE distance > 0 OR x.n_owners > 1"""))
def gp08(r: Roles):
    return op.fraud_rings(r.owners(), r.owns(), r.jobs())


VIOLATED = """
    WITH v AS (SELECT bin, count(*) FILTER (agency = 'DOB') AS dob_violations,
                      count(*) FILTER (agency = 'ECB') AS ecb_violations, count(*) AS total_violations
               FROM violations GROUP BY 1),
         j AS (SELECT bin, count(*) AS job_applications FROM jobs GROUP BY 1)
"""


@query("gp09_violated_properties", VIOLATED + """
    SELECT bin, address, borough, dob_violations, ecb_violations, total_violations,
           coalesce(job_applications, 0) AS job_applications
    FROM properties JOIN v USING (bin) LEFT JOIN j USING (bin)
    WHERE total_violations >= 2 ORDER BY total_violations DESC, bin LIMIT 10""")
def gp09(r: Roles):
    return op.violated_properties(r.properties(), r.violations(), r.jobs())


REPEAT = """
    WITH f AS (SELECT {party}, count(*) AS {n}, count(DISTINCT bin) AS property_count FROM {facts}
               GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10),
         a AS (SELECT DISTINCT {party}, address FROM {facts} JOIN properties USING (bin)
               WHERE {party} IN (SELECT {party} FROM f)),
         k AS (SELECT *, row_number() OVER (PARTITION BY {party} ORDER BY address) AS rn FROM a)
    SELECT {party}, {n}, property_count,
           (SELECT string_agg(address, ';' ORDER BY address) FROM k WHERE k.{party} = f.{party} AND rn <= 3)
             AS sample_addresses
    FROM f"""


@query("gp10_repeat_respondents", REPEAT.format(
    party="respondent_id", n="violation_count", facts="(SELECT * FROM violations WHERE agency = 'ECB')"))
def gp10(r: Roles):
    ecb = r.violations().filter("agency = 'ECB'")
    out = op.repeat_parties(ecb, r.properties(), "respondent_id", count_name="violation_count")
    return out.withColumn("sample_addresses", F.array_join("sample_addresses", ";"))


@query("gp11_repeat_professionals", REPEAT.format(
    party="contractor_id", n="application_count", facts="jobs"))
def gp11(r: Roles):
    out = op.repeat_parties(r.jobs(), r.properties(), "contractor_id", count_name="application_count")
    return out.withColumn("sample_addresses", F.array_join("sample_addresses", ";"))


@query("gp12_owners_violations_and_jobs", VIOLATED + """
    SELECT owner_id, count(*) AS properties_owned, CAST(sum(dob_violations) AS BIGINT) AS total_dob_violations,
           CAST(sum(ecb_violations) AS BIGINT) AS total_ecb_violations,
           CAST(sum(job_applications) AS BIGINT) AS total_job_applications,
           CAST(sum(total_violations) AS BIGINT) AS total_violations
    FROM owns JOIN v USING (bin) JOIN j USING (bin) GROUP BY 1 ORDER BY total_violations DESC, owner_id LIMIT 10""")
def gp12(r: Roles):
    return op.owners_with_violations_and_jobs(r.owns(), r.violations(), r.jobs())


@query("gp13_borough_density", VIOLATED + """
    SELECT borough, count(*) AS properties, CAST(sum(coalesce(dob_violations, 0)) AS BIGINT) AS dob_violations,
           CAST(sum(coalesce(ecb_violations, 0)) AS BIGINT) AS ecb_violations,
           CAST(sum(coalesce(total_violations, 0)) AS BIGINT) AS total_violations,
           round(sum(coalesce(total_violations, 0))::DOUBLE / count(*), 2) AS violations_per_property
    FROM properties LEFT JOIN v USING (bin) GROUP BY 1""")
def gp13(r: Roles):
    return op.violations_by_borough(r.properties(), r.violations())


@query("gp14_penalties_by_type", """
    SELECT violation_type, count(*) AS violation_count, round(avg(penalty), 2) AS avg_penalty,
           round(sum(penalty), 2) AS total_penalties, round(max(penalty), 2) AS max_penalty
    FROM typed_violations WHERE agency = 'ECB' GROUP BY 1 HAVING count(*) >= 5
    ORDER BY total_penalties DESC LIMIT 10""")
def gp14(r: Roles):
    return op.penalties_by_type(r.typed_violations().filter("agency = 'ECB'"))


@query("gp15_central_entities", """
    SELECT contractor_id, count(DISTINCT bin) AS connections FROM jobs GROUP BY 1 HAVING count(DISTINCT bin) >= 500""")
def gp15(r: Roles):
    return op.central_entities(r.jobs(), "contractor_id", "bin", at_least=500)


@query("gp16_violation_type_spread", """
    SELECT bin, count(DISTINCT violation_type) AS n_types FROM typed_violations GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""")
def gp16(r: Roles):
    return op.violation_type_spread(r.typed_violations())


# --- contract patterns: suppliers are firms, order customers their clients ---------------------

CONTRACT_SQL = """
    WITH contracts AS (SELECT l_suppkey AS company_id, o_custkey AS customer_id, l_extendedprice AS contract_value,
                              round((l_extendedprice * (1 + l_tax) - l_extendedprice) / l_extendedprice, 6) AS markup,
                              l_discount * 1000 AS control_percentage
                       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
         companies AS (SELECT s_suppkey AS company_id, s_nationkey % 2 = 0 AS dbe_certified, s_nationkey AS employee_count,
                              annual_revenue, contract_count
                       FROM supplier JOIN (SELECT l_suppkey, sum(l_extendedprice) AS annual_revenue,
                                                  count(*) AS contract_count FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
         persons AS (SELECT c_custkey AS person_id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS minority_status FROM customer)
"""


def contracts(r: Roles):
    sub = F.col("l_extendedprice")
    total = sub * (1 + F.col("l_tax"))
    return (
        r.table("lineitem")
        .join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_suppkey").alias("company_id"),
            F.col("o_custkey").alias("customer_id"),
            sub.alias("contract_value"),
            F.round((total - sub) / sub, 6).alias("markup"),
            (F.col("l_discount") * 1000).alias("control_percentage"),
        )
    )


def companies(r: Roles):
    revenue = r.table("lineitem").groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("annual_revenue"), F.count("*").alias("contract_count")
    )
    return r.table("supplier").join(revenue, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("s_suppkey").alias("company_id"),
        (F.col("s_nationkey") % 2 == 0).alias("dbe_certified"),
        F.col("s_nationkey").alias("employee_count"),
        "annual_revenue",
        "contract_count",
    )


def persons(r: Roles):
    return r.table("customer").select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("minority_status"),
    )


@query("gp17_pass_through", CONTRACT_SQL + """
    SELECT company_id, customer_id, contract_value, markup FROM contracts JOIN companies USING (company_id)
    WHERE dbe_certified AND markup <= 0.03 AND contract_value > 50000""")
def gp17(r: Roles):
    found = op.pass_through(contracts(r), companies(r))
    return found.select("company_id", "customer_id", "contract_value", "markup")


@query("gp18_control_fraud", CONTRACT_SQL + """
    SELECT company_id, customer_id AS person_id, round(control_percentage, 2) AS control_percentage
    FROM contracts JOIN companies USING (company_id) JOIN persons ON customer_id = person_id
    WHERE dbe_certified AND NOT minority_status AND round(control_percentage, 2) > 50""")
def gp18(r: Roles):
    controls = contracts(r).select(
        "company_id", F.col("customer_id").alias("person_id"),
        F.round("control_percentage", 2).alias("control_percentage"),
    )
    return op.control_fraud(controls, persons(r), companies(r))


@query("gp19_single_customer", CONTRACT_SQL + """
    , c AS (SELECT company_id, customer_id, sum(contract_value) AS revenue FROM contracts GROUP BY 1, 2)
    SELECT company_id, count(*) AS customer_count, round(sum(revenue), 2) AS total_revenue,
           round(max(revenue) / sum(revenue), 6) AS largest_share
    FROM c JOIN companies USING (company_id) WHERE dbe_certified
    GROUP BY 1 HAVING count(*) = 1 OR max(revenue) / sum(revenue) > 0.01""")
def gp19(r: Roles):
    # No firm here depends on one client at 95 %; one percent gives rows to compare.
    return op.single_customer(contracts(r), companies(r), share=0.01)


@query("gp20_shell_companies", CONTRACT_SQL + """
    SELECT company_id, employee_count, round(annual_revenue, 2) AS annual_revenue, contract_count
    FROM companies WHERE employee_count <= 3 AND annual_revenue > 100000 AND contract_count > 5""")
def gp20(r: Roles):
    found = op.shell_companies(companies(r))
    return found.select(
        "company_id", "employee_count", F.round("annual_revenue", 2).alias("annual_revenue"), "contract_count"
    )


@query("gp21_suspicious_timing", """
    WITH m AS (SELECT user_id AS company_id,
                      min(CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END) AS formed,
                      min(CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) AS certified,
                      min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS awarded
               FROM events GROUP BY 1),
         s AS (SELECT *, CAST(greatest(formed, certified, awarded) - least(formed, certified, awarded) AS INTEGER) AS span_days
               FROM m WHERE formed IS NOT NULL AND certified IS NOT NULL AND awarded IS NOT NULL)
    SELECT * FROM s WHERE span_days <= 2""")
def gp21(r: Roles):
    kinds = {"signup": "formation", "view": "certification", "purchase": "award"}
    events = r.table("events").filter(F.col("event_type").isin(*kinds))
    kind = F.lit(None)
    for source, name in kinds.items():
        kind = F.when(F.col("event_type") == source, name).otherwise(kind)
    milestones = events.select(
        F.col("user_id").alias("company_id"), kind.alias("kind"), F.col("ts").cast("date").alias("date")
    )
    return op.suspicious_timing(milestones, days=2)


DISMISSED = "l_returnflag = 'N'"
DISMISSAL_SQL = """
    WITH f AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0 END AS d FROM {source})
    SELECT {keys}, count(*) AS n, round(avg(d), 4) AS dismissal_rate,
           round(avg(d) / (SELECT avg(d) FROM f), 4) AS vs_overall
    FROM f GROUP BY {keys}"""


@query("gp23_inspector_dismissals", DISMISSAL_SQL.format(
    source="(SELECT l_suppkey AS inspector_id, o_custkey AS owner_id, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    keys="inspector_id, owner_id"))
def gp23(r: Roles):
    facts = r.table("lineitem").join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = facts.withColumnsRenamed({"l_suppkey": "inspector_id", "o_custkey": "owner_id"})
    return op.dismissal_rates(named, ["inspector_id", "owner_id"], DISMISSED)


@query("gp23_inspector_overall", DISMISSAL_SQL.format(
    source="(SELECT l_suppkey AS inspector_id, l_returnflag FROM lineitem)", keys="inspector_id"))
def gp23_overall(r: Roles):
    facts = r.table("lineitem").withColumnRenamed("l_suppkey", "inspector_id")
    return op.dismissal_rates(facts, ["inspector_id"], DISMISSED)


@query("gp24_dense_portfolios", branches("""
    SELECT owner_id, property_count, coalesce(n_violations, 0) AS n_violations,
           round(coalesce(n_violations, 0)::DOUBLE / property_count, 4) AS violations_per_property
    FROM held LEFT JOIN vio USING (owner_id)
    WHERE property_count >= 10 AND round(coalesce(n_violations, 0)::DOUBLE / property_count, 4) >= 2.5"""))
def gp24(r: Roles):
    return op.dense_portfolios(r.owns(), r.violations(), min_properties=10, min_density=2.5)


@query("gp25_filing_concentration", """
    WITH f AS (SELECT contractor_id, count(*) AS filings FROM jobs GROUP BY 1)
    SELECT contractor_id, filings, round(filings::DOUBLE / (SELECT sum(filings) FROM f), 6) AS share,
           round((filings - (SELECT avg(filings) FROM f)) / (SELECT stddev(filings) FROM f), 4) AS z_score FROM f""")
def gp25(r: Roles):
    return op.filing_concentration(r.jobs())


@query("gp26_dismissal_by_type", DISMISSAL_SQL.format(
    source="(SELECT p_type AS violation_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)",
    keys="violation_type"))
def gp26(r: Roles):
    facts = r.table("lineitem").join(r.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return op.dismissal_rates(
        facts.withColumnRenamed("p_type", "violation_type"), ["violation_type"], DISMISSED
    )


# Risk weights of the patterns.
PATTERN_WEIGHTS = {
    "pass_through": 0.9, "control_fraud": 0.95, "single_customer": 0.8, "shell_company": 0.85,
}


def company_clusters(r: Roles):
    """Companies connected by common addresses, in groups of five or more: (company_id, component, size)."""
    named = r.table("supplier").join(r.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("name"), F.col("n_name").alias("address"))
    # The first company of an address stands for it: the others are linked to it.
    links = shared_addresses(named).filter("name <> first_member").select(F.col("first_member").alias("src"), F.col("name").alias("dst"))
    return clusters(links, at_least=5).withColumnRenamed("node", "company_id")


def all_alerts(r: Roles):
    """Alerts of every contract pattern in one table: (pattern, entity, other, risk_score)."""
    found = {
        "pass_through": gp17(r).select("company_id", F.col("customer_id").alias("other")),
        "control_fraud": gp18(r).select("company_id", F.col("person_id").alias("other")),
        "single_customer": gp19(r).select("company_id", F.lit(None).cast("bigint").alias("other")),
        "shell_company": gp20(r).select("company_id", F.lit(None).cast("bigint").alias("other")),
        "suspicious_timing": gp21(r).select("company_id", F.lit(None).cast("bigint").alias("other")),
        # `other` names the cluster: its first company.
        "network_cluster": company_clusters(r).select("company_id", F.col("component").alias("other")),
    }
    out = None
    for pattern, rows in found.items():
        tagged = rows.select(
            F.lit(pattern).alias("pattern"), "company_id", "other",
            F.lit(PATTERN_WEIGHTS.get(pattern, 0.75)).alias("risk_score"),
        )
        out = tagged if out is None else out.unionByName(tagged)
    return out


ALERTS_SQL = CONTRACT_SQL + """
    , c AS (SELECT company_id, customer_id, sum(contract_value) AS revenue FROM contracts GROUP BY 1, 2),
      m AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END) AS f,
                   min(CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) AS v,
                   min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS p FROM events GROUP BY 1),
      alerts AS (
        SELECT 'pass_through' AS pattern, company_id, customer_id AS other, 0.9::DOUBLE AS risk_score
        FROM contracts JOIN companies USING (company_id)
        WHERE dbe_certified AND markup <= 0.03 AND contract_value > 50000
        UNION ALL SELECT 'control_fraud', company_id, customer_id, 0.95
        FROM contracts JOIN companies USING (company_id) JOIN persons ON customer_id = person_id
        WHERE dbe_certified AND NOT minority_status AND round(control_percentage, 2) > 50
        UNION ALL SELECT 'single_customer', company_id, NULL, 0.8
        FROM c JOIN companies USING (company_id) WHERE dbe_certified
        GROUP BY company_id HAVING count(*) = 1 OR max(revenue) / sum(revenue) > 0.01
        UNION ALL SELECT 'shell_company', company_id, NULL, 0.85
        FROM companies WHERE employee_count <= 3 AND annual_revenue > 100000 AND contract_count > 5
        UNION ALL SELECT 'suspicious_timing', user_id, NULL, 0.75 FROM m
        WHERE f IS NOT NULL AND v IS NOT NULL AND p IS NOT NULL
          AND CAST(greatest(f, v, p) - least(f, v, p) AS INTEGER) <= 2
        UNION ALL SELECT 'network_cluster', s_suppkey, first, 0.75
        FROM (SELECT s_suppkey, count(*) OVER w AS n, min(s_suppkey) OVER w AS first FROM supplier WINDOW w AS (PARTITION BY s_nationkey)) WHERE n >= 5)
"""


@query("gp27_all_patterns", ALERTS_SQL + "SELECT * FROM alerts")
def gp27(r: Roles):
    return all_alerts(r)
