"""Nested-document queries (EP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import documents as op
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.sources.schemas import COMPLAINTS, HOUSING_LITIGATIONS, PERMITS, typed


def as_json(docs):
    return docs.withColumn("content", F.to_json("content", {"ignoreNullFields": "false"}))


def text(name: str):
    return F.col(name).cast("string")


def litigations(r: Roles):
    rows = r.table("orders").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = rows.select(
        text("o_orderkey").alias("LitigationID"), F.col("o_orderpriority").alias("CaseType"), F.col("o_orderstatus").alias("CaseStatus"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("CaseOpenDate"), F.col("c_name").alias("Respondent"),
        F.lit("No Harassment").alias("FindingOfHarassment"), text("c_nationkey").alias("Penalty"), text("o_orderkey").alias("BIN"),
        text("o_custkey").alias("BBL"), text("c_nationkey").alias("HouseNumber"), F.col("c_mktsegment").alias("StreetName"),
        (F.col("o_custkey") % 6 + 1).cast("string").alias("Boro"), F.lit("10001").alias("Zip"),
    )
    return typed(raw, HOUSING_LITIGATIONS)


@query("ep01_litigation_documents", """
    SELECT 'Housing_Litigation_' || o_orderkey AS name, 'Housing litigation case ' || o_orderpriority AS description,
      '{"litigation_id":"' || o_orderkey || '","case_type":"' || o_orderpriority || '","case_status":"' || o_orderstatus || '","open_date":"' || strftime(o_orderdate, '%m/%d/%Y')
      || '","respondent":"' || c_name || '","finding_of_harassment":"No Harassment","penalty":"' || c_nationkey || '","building":{"bin":"' || o_orderkey || '","bbl":"' || o_custkey
      || '","address":"' || c_nationkey || ' ' || c_mktsegment || '","house_number":"' || c_nationkey || '","street_name":"' || c_mktsegment || '","borough":"'
      || CASE o_custkey % 6 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens' WHEN 4 THEN 'Staten Island' ELSE '6' END
      || '","zip_code":"10001","latitude":null,"longitude":null}}' AS content,
      CAST(o_orderdate AS DATE) AS reference_date, true AS date_valid
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def ep01(r: Roles):
    return as_json(op.litigation_documents(litigations(r)))


def raw_complaints(r: Roles):
    raw = r.table("events").select(
        text("event_id").alias("Complaint Number"), F.lit("OPEN").alias("Status"), F.col("event_type").alias("Complaint Category"),
        F.when(F.col("event_id") % 9 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date Entered"),
        text("user_id").alias("BIN"), text("event_id").alias("House Number"), F.lit("MAIN ST").alias("House Street"),
    )
    return typed(raw, COMPLAINTS)


@query("ep02_complaint_documents", """
    SELECT 'Complaint_' || event_id AS name, 'DOB complaint ' || event_type AS description,
      '{"complaint_number":"' || event_id || '","status":"OPEN","complaint_category":"' || event_type || '","unit":null,"disposition_code":null,"date_entered":"'
      || CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END || '","disposition_date":null,"inspection_date":null,"building":{"bin":"' || user_id
      || '","address":"' || event_id || ' MAIN ST","house_number":"' || event_id || '","street_name":"MAIN ST","zip_code":null,"community_board":null}}' AS content,
      CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END AS reference_date, event_id % 9 <> 0 AS date_valid FROM events""")
def ep02(r: Roles):
    return as_json(op.complaint_documents(raw_complaints(r)))


def raw_permits(r: Roles):
    rows = r.table("lineitem").join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    early = F.col("l_linenumber") < 4
    filed = F.date_format("l_shipdate", "M/d/yy")
    raw = rows.select(
        F.when(early, r._line_id()).otherwise("").alias("Job #"), r._line_id().alias("Job"), F.col("l_returnflag").alias("Permit Type"),
        F.col("l_linestatus").alias("Work Type"), F.col("o_orderstatus").alias("Current Status"),
        F.when(early, filed).alias("Filing Date"), filed.alias("Pre- Filing Date"), text("l_orderkey").alias("BIN"),
        text("l_suppkey").alias("House #"), F.lit("BROADWAY").alias("Street Name"),
        (F.col("l_suppkey") % 5 + 1).cast("string").alias("Borough"), F.lit("Pat").alias("Owner's First Name"),
        text("o_custkey").alias("Owner's Last Name"),
    )
    return typed(raw, PERMITS)


@query("ep03_permit_documents", """
    WITH p AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS id, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'Permit_' || id AS name, 'DOB permit filing ' || l_returnflag AS description,
      '{"permit_details":{"permit_number":"' || id || '","permit_type":"' || l_returnflag || '","work_type":"' || l_linestatus || '","permit_status":"' || o_orderstatus
      || '","filing_date":"' || strftime(l_shipdate, '%-m/%-d/%y') || '","issue_date":null,"expiration_date":null,"job_description":null},"building":{"bin":"' || l_orderkey
      || '","bbl":null,"address":"' || l_suppkey || ' BROADWAY","house_number":"' || l_suppkey || '","street_name":"BROADWAY","borough":"'
      || CASE l_suppkey % 5 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens' ELSE 'Staten Island' END
      || '","zip_code":null},"applicant":{"owner_name":"Pat ' || o_custkey || '","owner_business_name":null,"owner_phone":null,"owner_business_type":null}}' AS content,
      CAST(l_shipdate AS DATE) AS reference_date, true AS date_valid FROM p""")
def ep03(r: Roles):
    return as_json(op.permit_documents(raw_permits(r)))


def records(r: Roles):
    permits = r.jobs().select("bin", F.col("job_id").alias("id"), F.col("filing_date").alias("date"), F.col("job_type").alias("category"))
    violations = r.violations().filter("agency = 'DOB'").select(
        "bin", F.col("violation_id").alias("id"), F.col("issue_date").alias("date"), F.col("agency").alias("category")
    )
    complaints = r.complaints().select("bin", F.col("complaint_id").alias("id"), F.col("date_entered").alias("date"), "category")
    return permits, violations, complaints


TIMELINE_SQL = """
    rows_of AS (SELECT bin, 'permit' AS kind, filing_date AS date, 'permit_filed' AS event, 'Permit ' || job_id || ' filed for ' || job_type AS details, job_id AS id, job_type AS category FROM jobs
                UNION ALL SELECT bin, 'violation', issue_date, 'violation_issued', 'Violation ' || violation_id || ' for ' || agency, violation_id, agency FROM violations WHERE agency = 'DOB'
                UNION ALL SELECT bin, 'complaint', date_entered, 'complaint_filed', 'Complaint ' || complaint_id || ' for ' || category, CAST(complaint_id AS VARCHAR), category FROM complaints),
    kept AS (SELECT * FROM rows_of WHERE bin IN (SELECT bin FROM jobs))"""


@query("ep04_project_documents", "WITH " + TIMELINE_SQL + """
    , heads AS (SELECT 'Building_Project_' || bin AS name, bin,
      'Building ' || bin || ' with ' || count(*) FILTER (kind = 'permit') || ' permits, ' || count(*) FILTER (kind = 'violation') || ' violations, '
      || count(*) FILTER (kind = 'complaint') || ' complaints' AS project_summary, count(*) FILTER (kind = 'permit') AS n_permits,
      count(*) FILTER (kind = 'violation') AS n_violations, count(*) FILTER (kind = 'complaint') AS n_complaints, min(date) AS first_date, max(date) AS last_date
      FROM kept GROUP BY bin HAVING count(*) FILTER (kind = 'permit') > 1 OR count(*) FILTER (kind <> 'permit') > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY date NULLS FIRST, event, details, id) AS position FROM kept)
    SELECT * FROM heads JOIN placed USING (bin)""")
def ep04(r: Roles):
    """Every document with its permits, violations, complaints and timeline: a row for each record in its place."""
    return op.project_contents(*records(r))


@query("ep04_project_records", "WITH " + TIMELINE_SQL + """
    SELECT bin, kind, date, event, details, id, category, row_number() OVER (PARTITION BY bin ORDER BY date NULLS FIRST, event, details, id) AS position FROM kept""")
def ep04_records(r: Roles):
    return op.project_records(*records(r))


@query("ep05_timeline", "WITH " + TIMELINE_SQL + "SELECT bin, kind, date, event, details FROM rows_of")
def ep05(r: Roles):
    return op.timeline_rows(*records(r)).select("bin", "kind", "date", "event", "details")
