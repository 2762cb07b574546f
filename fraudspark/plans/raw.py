"""The given tables written out under the city's raw headers, with the flaws raw files have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.plans.roles import Roles

LINE_ID = """concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'))"""

RAW_ECB_SQL = f"""
    raw_ecb AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS bin, n_name AS boro, CAST(l_partkey AS VARCHAR) AS block,
             CAST(l_linenumber AS VARCHAR) AS lot, {LINE_ID} AS isn,
             CASE WHEN l_linenumber = 7 THEN 'JUNE 31' ELSE strftime(l_shipdate, '%Y%m%d') END AS issue_raw,
             CASE WHEN l_linenumber = 6 THEN 'n/a' WHEN l_linenumber = 5 THEN ''
                  ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.25' END AS penalty_raw,
             CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE s_name END AS respondent_name,
             CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS respondent_house,
             n_name || ' STREET' AS respondent_street, n_name AS respondent_city,
             CAST(10000 + l_suppkey AS VARCHAR) AS respondent_zip
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      WHERE l_returnflag = 'A')"""


def raw_ecb(r: Roles) -> DataFrame:
    places = r.table("supplier").join(r.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = r.table("lineitem").filter("l_returnflag = 'A'").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        text("l_orderkey").alias("BIN"),
        F.col("n_name").alias("BORO"),
        text("l_partkey").alias("BLOCK"),
        text("l_linenumber").alias("LOT"),
        r._line_id().alias("ISN_DOB_BIS_EXTRACT"),
        F.when(F.col("l_linenumber") == 7, "JUNE 31").otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("ISSUE_DATE"),
        F.when(F.col("l_linenumber") == 6, "n/a").when(F.col("l_linenumber") == 5, "")
        .otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".25"))).alias("PENALITY_IMPOSED"),
        F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.col("s_name")).alias("RESPONDENT_NAME"),
        F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(text("l_suppkey")).alias("RESPONDENT_HOUSE_NUMBER"),
        F.concat_ws(" ", "n_name", F.lit("STREET")).alias("RESPONDENT_STREET"),
        F.col("n_name").alias("RESPONDENT_CITY"),
        (10000 + F.col("l_suppkey")).cast("string").alias("RESPONDENT_ZIP"),
    )


#: Further columns of the job filings as (header, name, text value); the values mean the same in both dialects.
JOB_EXTRAS = [
    ("Doc #", "doc_number", "CAST(l_linenumber AS STRING)"),
    ("Job Status Descrp", "job_status_description", "CASE l_returnflag WHEN 'R' THEN 'PERMIT ISSUED' ELSE 'SIGNED OFF' END"),
    ("Building Type", "building_type", "CASE WHEN l_partkey % 3 = 0 THEN '1-2-3 FAMILY' ELSE 'OTHER' END"),
    ("Community - Board", "community_board", "CAST(l_suppkey % 18 AS STRING)"),
    ("Cluster", "cluster", "CASE WHEN l_partkey % 9 = 0 THEN 'Y' ELSE '' END"),
    ("Landmarked", "landmarked", "CASE WHEN o_custkey % 11 = 0 THEN 'L' ELSE 'N' END"),
    ("Adult Estab", "adult_establishment", "CASE WHEN o_custkey % 13 = 0 THEN 'Y' ELSE 'N' END"),
    ("Loft Board", "loft_board", "CASE WHEN o_custkey % 17 = 0 THEN 'Y' ELSE 'N' END"),
    ("City Owned", "city_owned", "CASE WHEN o_custkey % 19 = 0 THEN 'Y' ELSE '' END"),
    ("Little e", "little_e", "CASE WHEN l_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END"),
    ("PC Filed", "pc_filed", "CASE WHEN l_suppkey % 7 = 0 THEN 'Y' ELSE '' END"),
    ("eFiling Filed", "efiling_filed", "CASE WHEN l_suppkey % 2 = 0 THEN 'Y' ELSE '' END"),
    ("Job Description", "job_description", "CASE WHEN l_linenumber = 1 THEN '' ELSE c_mktsegment || ', ' || s_name END"),
    ("Total Est. Fee", "total_estimated_fee", "CASE WHEN l_linenumber = 4 THEN 'n/a' ELSE CAST(l_partkey % 1000 AS STRING) || '.75' END"),
    ("Fee Status", "fee_status", "CASE WHEN l_linenumber = 2 THEN 'EXEMPT' ELSE 'STANDARD' END"),
    ("Existing Zoning Sqft", "existing_zoning_sqft", "CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey * 3 AS STRING) END"),
    ("Proposed Zoning Sqft", "proposed_zoning_sqft", "CAST(l_partkey * 3 + l_linenumber AS STRING) || '.5'"),
    ("Existing Dwelling Units", "existing_dwelling_units", "CASE WHEN l_suppkey % 6 = 0 THEN 'none' ELSE CAST(l_suppkey % 40 AS STRING) END"),
    ("Proposed Dwelling Units", "proposed_dwelling_units", "CAST(l_suppkey % 41 AS STRING)"),
    ("Proposed No. of Stories", "proposed_stories", "CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(l_linenumber + 1 AS STRING) END"),
    ("Existing Height", "existing_height", "CAST(l_linenumber * 11 AS STRING)"),
    ("Proposed Height", "proposed_height", "CASE WHEN l_linenumber = 7 THEN '?' ELSE CAST(l_linenumber * 11 + 5 AS STRING) || '.25' END"),
    ("Zoning Dist1", "zoning_district_1", "'R' || CAST(l_partkey % 10 AS STRING)"),
    ("Zoning Dist2", "zoning_district_2", "CASE WHEN l_partkey % 5 = 0 THEN 'C' || CAST(l_partkey % 8 AS STRING) ELSE '' END"),
    ("Zoning Dist3", "zoning_district_3", "CASE WHEN l_partkey % 25 = 0 THEN 'M1' ELSE '' END"),
    ("Special District 1", "special_district_1", "CASE WHEN o_custkey % 10 = 0 THEN 'MID' ELSE '' END"),
    ("Special District 2", "special_district_2", "CASE WHEN o_custkey % 20 = 0 THEN 'TMU' ELSE '' END"),
    ("BUILDING_CLASS", "building_class", "'C' || CAST(l_suppkey % 9 AS STRING)"),
    ("GIS_LATITUDE", "latitude", "CASE WHEN l_linenumber = 6 THEN '' ELSE '40.' || CAST(500 + l_suppkey % 400 AS STRING) END"),
    ("GIS_LONGITUDE", "longitude", "CASE WHEN l_linenumber = 6 THEN '' ELSE '-73.' || CAST(700 + l_suppkey % 300 AS STRING) END"),
    ("GIS_COUNCIL_DISTRICT", "council_district", "CASE WHEN l_partkey % 6 = 0 THEN '' ELSE CAST(l_partkey % 51 AS STRING) END"),
    ("GIS_NTA_NAME", "nta_name", "n_name || '-' || c_mktsegment"),
]

RAW_JOBS_SQL = f"""
    raw_jobs AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS bin, CAST(o_custkey AS VARCHAR) AS house, n_name AS street, n_name AS borough,
             CASE WHEN o_custkey % 3 = 0 THEN c_name ELSE '' END AS business,
             CASE WHEN o_custkey % 3 < 2 THEN c_mktsegment ELSE '' END AS first_name,
             CASE WHEN o_custkey % 3 < 2 THEN n_name ELSE '' END AS last_name,
             CAST(o_custkey AS VARCHAR) AS owner_house, n_name || ' STREET' AS owner_street,
             {LINE_ID} AS job_number, l_linestatus AS job_type, l_returnflag AS job_status,
             CASE WHEN l_linenumber = 5 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' END AS cost_raw,
             CAST(l_linenumber AS VARCHAR) AS stories_raw,
             CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'Pat' END AS app_first, s_name AS app_last,
             'PE' AS app_title, CAST(l_suppkey AS VARCHAR) AS app_license,
             {", ".join(f"{value} AS {name}" for _, name, value in JOB_EXTRAS)}
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey)"""


def raw_jobs(r: Roles) -> DataFrame:
    owners = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = (
        r.table("lineitem")
        .join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(owners, F.col("o_custkey") == F.col("c_custkey"))
        .join(r.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    text = lambda c: F.col(c).cast("string")
    third = F.col("o_custkey") % 3
    return rows.select(
        text("l_orderkey").alias("Bin #"),
        text("o_custkey").alias("House #"),
        F.col("n_name").alias("Street Name"),
        F.col("n_name").alias("Borough"),
        F.when(third == 0, F.col("c_name")).otherwise("").alias("Owner's Business Name"),
        F.when(third < 2, F.col("c_mktsegment")).otherwise("").alias("Owner's First Name"),
        F.when(third < 2, F.col("n_name")).otherwise("").alias("Owner's Last Name"),
        text("o_custkey").alias("Owner's House Number"),
        F.concat_ws(" ", "n_name", F.lit("STREET")).alias("Owner'sHouse Street Name"),
        r._line_id().alias("Job #"),
        F.col("l_linestatus").alias("Job Type"),
        F.col("l_returnflag").alias("Job Status"),
        F.when(F.col("l_linenumber") == 5, "")
        .otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".5"))).alias("Initial Cost"),
        text("l_linenumber").alias("ExistingNo. of Stories"),
        F.when(F.col("l_suppkey") % 10 == 0, "").otherwise("Pat").alias("Applicant's First Name"),
        F.col("s_name").alias("Applicant's Last Name"),
        F.lit("PE").alias("Applicant Professional Title"),
        text("l_suppkey").alias("Applicant License #"),
        *[F.expr(value).alias(header) for header, _, value in JOB_EXTRAS],
    )
