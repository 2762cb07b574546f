"""Window queries (WN) and time joins (JN-11 to JN-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import temporal as op
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles

FOLLOW_SQL = """
    WITH e AS (SELECT {key} event_id, ts, row_number() OVER (PARTITION BY {part} ORDER BY ts, event_id) AS pos,
                 count(*) OVER (PARTITION BY {part} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAYS FOLLOWING) AS upto,
                 max(ts) OVER (PARTITION BY {part} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAYS FOLLOWING) AS last_ts
               FROM events)
    SELECT {key} event_id, ts, upto - pos + 1 AS event_count,
           CAST(floor((epoch_us(last_ts) - epoch_us(ts)) / 86400000000) AS BIGINT) AS window_days FROM e WHERE upto - pos >= {n}"""


@query("wn01_follow_ups", FOLLOW_SQL.format(key="user_id,", part="user_id", days=2, n=2))
def wn01(r: Roles):
    return op.follow_ups(r.table("events"), "ts", "event_id", key="user_id", days=2)


@query("jn11_follow_ups_all_entities", FOLLOW_SQL.format(key="", part="1", days=1, n=2))
def jn11(r: Roles):
    return op.follow_ups(r.table("events"), "ts", "event_id", days=1)


@query("wn02_first_version", """
    SELECT bin, job_id, filing_date, job_type FROM jobs
    QUALIFY row_number() OVER (PARTITION BY bin ORDER BY filing_date, job_id) = 1""")
def wn02(r: Roles):
    jobs = r.jobs().select("bin", "job_id", "filing_date", "job_type")
    return op.first_version(jobs, ["bin"], ["filing_date", "job_id"])


@query("wn03_latest_version", """
    SELECT bin, job_id, filing_date, job_type FROM jobs
    QUALIFY row_number() OVER (PARTITION BY bin ORDER BY filing_date DESC, job_id DESC) = 1""")
def wn03(r: Roles):
    jobs = r.jobs().select("bin", "job_id", "filing_date", "job_type")
    return op.latest_version(jobs, ["bin"], ["filing_date", "job_id"])


@query("wn04_top_entities", """
    SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 15""")
def wn04(r: Roles):
    scores = r.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return op.top_entities(scores, "s_acctbal", "s_suppkey", 15)


@query("wn04_top_per_type", """
    SELECT c_custkey, c_nationkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place
    FROM customer QUALIFY place <= 5""")
def wn04_type(r: Roles):
    scores = r.table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return op.top_per_type(scores, "c_nationkey", "c_acctbal", "c_custkey", 5)


@query("wn05_monthly_windows", """
    WITH w AS (SELECT CAST(11 - i AS INTEGER) AS window_no, DATE '1998-12-31' - CAST((i + 1) * 30 AS INTEGER) AS window_start,
                      DATE '1998-12-31' - CAST(i * 30 AS INTEGER) AS window_end FROM range(12) t(i))
    SELECT window_no, window_start, window_end, count(*) AS n_jobs, count(DISTINCT contractor_id) AS n_contractors
    FROM jobs JOIN w ON filing_date BETWEEN window_start AND window_end GROUP BY 1, 2, 3""")
def wn05(r: Roles):
    placed = op.in_windows(r.jobs(), "filing_date", "1998-12-31")
    return placed.groupBy("window_no", "window_start", "window_end").agg(
        F.count("*").alias("n_jobs"), F.countDistinct("contractor_id").alias("n_contractors")
    )


@query("wn06_recent_permits", """
    SELECT contractor_id, filing_date, job_id, count(*) OVER (PARTITION BY contractor_id ORDER BY filing_date
           RANGE BETWEEN INTERVAL 183 DAYS PRECEDING AND CURRENT ROW) AS n_recent FROM jobs""")
def wn06(r: Roles):
    return op.rolling_filings(r.jobs(), ["contractor_id"], "filing_date", "job_id")


@query("wn06_ownership_changes", """
    WITH o AS (SELECT l_partkey AS bin, o_custkey AS owner_id, CAST(o_orderdate AS DATE) AS d, o_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    l AS (SELECT *, lag(owner_id) OVER (PARTITION BY bin ORDER BY d, id) AS before, max(d) OVER (PARTITION BY bin) AS last FROM o)
    SELECT bin, count(*) FILTER (before <> owner_id AND d >= last - 730) AS changes FROM l GROUP BY 1""")
def wn06_owners(r: Roles):
    facts = r.table("lineitem").join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("bin"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.concat_ws("-", "o_orderkey", "l_linenumber", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
    )
    return op.value_changes(facts, ["bin"], "d", "id", "owner_id", days=730)


@query("wn07_repeat_violations", """
    SELECT respondent_id, issue_date, violation_id, row_number() OVER w AS repeat_no,
           issue_date - lag(issue_date) OVER w AS days_since_previous
    FROM violations WINDOW w AS (PARTITION BY respondent_id ORDER BY issue_date, violation_id)""")
def wn07(r: Roles):
    return op.repeat_history(r.violations(), ["respondent_id"], "issue_date", "violation_id")


@query("wn08_serial_filings", """
    WITH r AS (SELECT bin, count(*) OVER (PARTITION BY bin ORDER BY filing_date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n,
                      job_status <> lag(job_status) OVER (PARTITION BY bin ORDER BY filing_date, job_id) AS c FROM jobs)
    SELECT bin, max(n) AS max_filings, count(*) FILTER (c) AS changes FROM r GROUP BY 1 HAVING max(n) >= 2""")
def wn08(r: Roles):
    return op.serial_filings(r.jobs(), ["bin"], "filing_date", "job_id", "job_status", at_least=2)


@query("jn12_permit_after_violation", """
    SELECT bin, violation_id, issue_date, job_id, filing_date FROM violations JOIN jobs USING (bin)
    WHERE filing_date BETWEEN issue_date AND issue_date + 30 AND job_id <> violation_id""")
def jn12(r: Roles):
    violations = r.violations().select("bin", "violation_id", "issue_date")
    jobs = r.jobs().select("bin", "job_id", "filing_date")
    found = op.within_days(violations, jobs, "bin", "issue_date", "filing_date", 30)
    return found.filter("job_id <> violation_id")


@query("jn13_complaint_before_permit", """
    WITH p AS (SELECT user_id AS bin, event_id AS permit_id, ts AS permit_ts FROM events WHERE event_type = 'purchase'),
         c AS (SELECT user_id AS bin, event_id AS complaint_id, ts AS complaint_ts FROM events WHERE event_type = 'error')
    SELECT p.bin, permit_id, permit_ts, complaint_ts, complaint_id
    FROM p ASOF LEFT JOIN c ON p.bin = c.bin AND permit_ts >= complaint_ts""")
def jn13(r: Roles):
    of = lambda kind, name: r.table("events").filter(F.col("event_type") == kind).select(
        F.col("user_id").alias("bin"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts")
    )
    return op.latest_before(
        of("purchase", "permit"), of("error", "complaint"), "bin", "permit_ts", "permit_id", "complaint_ts", "complaint_id"
    )
