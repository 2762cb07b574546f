"""Profiling and data-quality queries (DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.functions.text import normalize_address, normalize_name
from fraudspark.operators import quality as op
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.plans.scalars import ADDRESS_SQL, company_addresses


def patchy_jobs(r: Roles):
    """Jobs with the gaps of real files: repeated rows, and values missing by line."""
    line = r.table("lineitem")
    return line.select(
        F.when(F.col("l_linenumber") < 6, F.col("l_orderkey")).alias("bin"),
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linestatus")).alias("job_type"),
        F.col("l_linenumber").alias("floor_number"),
    )


PATCHY_SQL = """
    p AS (SELECT CASE WHEN l_linenumber < 6 THEN l_orderkey END AS bin, CASE WHEN l_suppkey % 3 > 0 THEN l_linestatus END AS job_type,
                 l_linenumber AS floor_number FROM lineitem)"""


QUALITY_SQL = f"""
    WITH {PATCHY_SQL},
    s AS (SELECT count(*) AS row_count, CAST(count(*) * 2 - count(bin) - count(job_type) AS BIGINT) AS null_cells,
                 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS duplicate_rows FROM p),
    q AS (SELECT *, round(null_cells * 100.0 / (row_count * 3), 4)::DOUBLE AS missing_percentage, round(100 - null_cells * 100.0::DOUBLE / (row_count * 3), 4) AS completeness FROM s)
"""


@query("dq01_dataset_quality", QUALITY_SQL + """
    SELECT 'jobs' AS dataset, row_count, CAST(3 AS BIGINT) AS column_count, null_cells, duplicate_rows, missing_percentage, completeness,
           CASE WHEN completeness >= 95 THEN 'EXCELLENT' WHEN completeness >= 85 THEN 'GOOD' WHEN completeness >= 70 THEN 'FAIR' ELSE 'POOR' END AS quality_level,
           concat_ws('; ', CASE WHEN missing_percentage > 20 THEN printf('High missing data: %.1f%%', missing_percentage) END,
                     CASE WHEN duplicate_rows > 0 THEN format('Duplicate rows found: {:,}', duplicate_rows) END) AS issues FROM q""")
def dq01(r: Roles):
    out = op.dataset_quality(patchy_jobs(r), "jobs")
    return out.withColumn("issues", F.array_join("issues", "; "))


@query("dq02_column_profile", f"""
    WITH {PATCHY_SQL},
    l AS (SELECT 'bin' AS c, CAST(bin AS VARCHAR) AS v FROM p UNION ALL SELECT 'job_type', job_type FROM p UNION ALL SELECT 'floor_number', CAST(floor_number AS VARCHAR) FROM p),
    k AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS rn FROM (SELECT DISTINCT c, v FROM l WHERE v IS NOT NULL)),
    t AS (SELECT c, string_agg(v, ',' ORDER BY v) AS samples FROM k WHERE rn <= 3 GROUP BY 1)
    SELECT c AS "column", CASE c WHEN 'bin' THEN 'bigint' WHEN 'job_type' THEN 'string' ELSE 'int' END AS type, count(*) - count(v) AS null_count,
           round((count(*) - count(v)) * 100.0 / count(*), 2)::DOUBLE AS null_percentage, count(DISTINCT v) AS distinct_count, any_value(samples) AS samples,
           CASE c WHEN 'bin' THEN 'entity,join,key' WHEN 'floor_number' THEN 'entity,join,key' ELSE '' END AS roles
    FROM l JOIN t USING (c) GROUP BY c""")
def dq02(r: Roles):
    return op.column_profile(patchy_jobs(r)).withColumn("samples", F.array_join("samples", ","))


NUM = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std, min({c}) AS low, max({c}) AS high, round(median({c}), 4) AS median FROM lineitem"


@query("dq03_numeric_summary", " UNION ALL ".join(NUM.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def dq03(r: Roles):
    out = op.numeric_summary(r.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query("dq04_categorical_summary", """
    WITH l AS (SELECT 'p_name' AS c, p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part),
    n AS (SELECT c, v, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT c AS "column", CAST(row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS INTEGER) AS place, v AS value, n,
           count(v) OVER (PARTITION BY c) AS distinct_count, CAST(0 AS BIGINT) AS null_count FROM n QUALIFY place <= 5""")
def dq04(r: Roles):
    return op.categorical_summary(r.table("part"))


@query("dq08_duplicate_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def dq08(r: Roles):
    return op.duplicate_keys(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq09_missing_bin", f"""
    WITH {PATCHY_SQL} SELECT bin, floor_number, 'missing_bin' AS issue_type FROM p WHERE bin IS NULL OR bin = 0""")
def dq09(r: Roles):
    return op.missing_bin(patchy_jobs(r)).select("bin", "floor_number", "issue_type")


@query("dq10_suspicious_address", """
    WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'P.O. BOX ' || c_custkey WHEN 1 THEN 'PO BOX ' || c_custkey || ' ' || n_name
                 WHEN 2 THEN 'GENERAL DELIVERY ' || n_name WHEN 3 THEN n_name ELSE n_name || ' ' || c_mktsegment END AS address
               FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT *, 'suspicious_address' AS issue_type FROM a WHERE c_custkey % 5 < 3 OR length(address) < 10""")
def dq10(r: Roles):
    key, nation = F.col("c_custkey"), F.col("n_name")
    text = key.cast("string")
    address = (
        F.when(key % 5 == 0, F.concat(F.lit("P.O. BOX "), text))
        .when(key % 5 == 1, F.concat(F.lit("PO BOX "), text, F.lit(" "), nation))
        .when(key % 5 == 2, F.concat(F.lit("GENERAL DELIVERY "), nation))
        .when(key % 5 == 3, nation)
        .otherwise(F.concat_ws(" ", nation, "c_mktsegment"))
    )
    rows = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return op.suspicious_address(rows.select("c_custkey", address.alias("address")))


@query("dq11_invalid_license", """
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '' END AS license, 'invalid_license' AS issue_type
    FROM supplier WHERE s_suppkey % 4 < 3""")
def dq11(r: Roles):
    key = F.col("s_suppkey")
    license_no = F.when(key % 4 == 0, "0").when(key % 4 == 1, "").when(key % 4 == 3, key.cast("string"))
    return op.invalid_license(r.table("supplier").select("s_suppkey", license_no.alias("license")))


@query("dq12_normalisation_coverage", f"""
    SELECT 'companies' AS entity_type, 'normalized_address' AS field, count(*) AS total, count(address) AS filled FROM {ADDRESS_SQL}
    UNION ALL SELECT 'companies', 'normalized_name', count(*), count(name) FROM {ADDRESS_SQL}
    UNION ALL SELECT 'jobs', 'job_type', count(*), count(CASE WHEN l_suppkey % 3 > 0 THEN l_linestatus END) FROM lineitem""")
def dq12(r: Roles):
    companies = company_addresses(r).select(
        normalize_address(F.col("address")).alias("normalized_address"), normalize_name(F.col("name")).alias("normalized_name")
    )
    return op.coverage(
        {"companies": companies, "jobs": patchy_jobs(r)},
        {"companies": ["normalized_address", "normalized_name"], "jobs": ["job_type"]},
    )


@query("dq14_overall_quality", QUALITY_SQL + """
    SELECT CAST(2 AS BIGINT) AS datasets, CAST(row_count + (SELECT count(*) FROM part) AS BIGINT) AS total_rows,
           round((completeness + 100) / 2, 4) AS mean_completeness,
           CASE WHEN (completeness + 100) / 2 >= 95 THEN 'excellent' WHEN (completeness + 100) / 2 >= 85 THEN 'good' ELSE 'fair' END AS overall_quality FROM q""")
def dq14(r: Roles):
    return op.overall_quality(
        op.dataset_quality(patchy_jobs(r), "jobs").unionByName(op.dataset_quality(r.table("part"), "part"))
    )


@query("dq16_temporal_range", """
    SELECT 'o_orderdate' AS "column", CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders""")
def dq16(r: Roles):
    return op.temporal_range(r.table("orders"), ["o_orderdate"])


@query("dq17_entity_profile", f"""
    WITH {PATCHY_SQL}, u AS (SELECT 'jobs' AS dataset, bin AS v FROM p UNION ALL SELECT 'violations', bin FROM violations UNION ALL SELECT 'complaints', bin FROM complaints)
    SELECT 'property' AS entity_type, dataset, count(*) AS total, count(DISTINCT v) AS unique_values,
           round((count(v) - count(DISTINCT v))::DOUBLE / count(v), 6) AS duplicate_rate, round(count(v) * 100.0::DOUBLE / count(*), 4) AS completeness
    FROM u GROUP BY 2""")
def dq17(r: Roles):
    return op.entity_profile(
        {"jobs": (patchy_jobs(r), "bin"), "violations": (r.violations(), "bin"), "complaints": (r.complaints(), "bin")},
        "property",
    )


@query("dq18_numeric_outliers", """
    SELECT event_id, value, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev(value) FROM events), 4) AS z_score
    FROM events WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev(value) FROM events)) > 2.5""")
def dq18(r: Roles):
    found = op.numeric_outliers(r.table("events"), "value", deviations=2.5)
    return found.select("event_id", "value", F.round("z_score", 4).alias("z_score"))


@query("dq18_future_dates", "SELECT job_id, filing_date FROM jobs WHERE filing_date > DATE '2001-06-01'")
def dq18_future(r: Roles):
    return op.future_dates(r.jobs(), "filing_date", "2001-06-01").select("job_id", "filing_date")


@query("dq18_rare_values", """
    SELECT p_name, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1
    HAVING count(*)::DOUBLE / (SELECT count(*) FROM part) < 0.015""")
def dq18_rare(r: Roles):
    return op.rare_values(r.table("part"), "p_name", below=0.015).withColumn("share", F.round("share", 6))
