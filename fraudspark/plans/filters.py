"""Filter, sort and set queries (FL, SO, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import filters as op
from fraudspark.operators.filters import All, Any_, Not, RecordQuery, Where
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles


@query("fl01_filter_spec", """
    SELECT p_partkey, p_name, p_brand, p_size FROM part
    WHERE (contains(p_name, 'ring') OR p_name LIKE 'red%' OR p_name LIKE '%box') AND NOT (p_brand = 'Brand#2')
      AND p_size >= 5 AND p_size < 45 AND p_size <> 20 AND p_retailprice > 900 AND p_retailprice <= 2000""")
def fl01(r: Roles):
    spec = All([
        Any_([Where("p_name", "contains", "ring"), Where("p_name", "startswith", "red"), Where("p_name", "endswith", "box")]),
        Not(Where("p_brand", "eq", "Brand#2")),
        Where("p_size", "ge", 5), Where("p_size", "lt", 45), Where("p_size", "ne", 20),
        Where("p_retailprice", "gt", 900), Where("p_retailprice", "le", 2000),
    ])
    return r.table("part").filter(spec.column()).select("p_partkey", "p_name", "p_brand", "p_size")


@query("fl02_record_query", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def fl02(r: Roles):
    spec = RecordQuery(
        select=["o_orderkey", "o_custkey", "o_totalprice"],
        where=[Where("o_orderstatus", "eq", "F"), Where("o_totalprice", "gt", 1000)],
        order=[("o_totalprice", "desc"), ("o_orderkey", "asc")],
        top=50,
    )
    return spec.page(2).run(r.table("orders"))


@query("fl03_bin_lookup", "SELECT bin, contractor_id, job_type, filing_date, job_id FROM jobs WHERE bin = 7")
def fl03(r: Roles):
    found = r.jobs().filter(Where("bin", "eq", 7).column())
    return found.select("bin", "contractor_id", "job_type", "filing_date", "job_id")


@query("fl04_recent_records", """
    SELECT bin, job_id, filing_date FROM jobs WHERE filing_date >= DATE '2000-06-01'""")
def fl04(r: Roles):
    return op.recent(r.jobs(), "filing_date", "2000-06-01").select("bin", "job_id", "filing_date")


@query("fl05_investigation", """
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    WHERE (contains(o_orderpriority, 'URGENT') OR contains(o_orderstatus, 'URGENT')) AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34)
      AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def fl05(r: Roles):
    found = op.investigation(
        r.table("orders"), name_fields=["o_orderpriority", "o_orderstatus"], name="URGENT",
        bin_field="o_custkey", bins=[1, 2, 3, 5, 8, 13, 21, 34], date_field="o_orderdate", since="1995-01-01",
    )
    return found.select("o_orderkey", "o_custkey", "o_orderdate")


@query("fl06_search_text", """
    SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the thing') OR contains(lower(text), 'license')
       OR contains(lower(lang), 'license') OR contains(lower(source), 'license')""")
def fl06(r: Roles):
    docs = r.table("documents")
    found = op.search_text(docs, "LICENSE").select("doc_id", "source")
    more = docs.filter(F.lower("text").contains("the thing")).select("doc_id", "source")
    return found.union(more).distinct()


@query("fl07_contractor_search", """
    SELECT business_name, job_id, filing_date FROM jobs JOIN contractors USING (contractor_id)
    WHERE contains(business_name, '00001') ORDER BY filing_date DESC, job_id LIMIT 25""")
def fl07(r: Roles):
    named = r.jobs().join(r.contractors(), "contractor_id").select("business_name", "job_id", "filing_date")
    return op.newest_matching(named, "business_name", "00001", "filing_date", "job_id", 25)


@query("fl08_alert_filter", """
    SELECT event_id AS alert_id, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS severity, 'ACTIVE' AS status, ts AS created_at
    FROM events WHERE event_type <> 'view' AND value > 50 ORDER BY ts DESC, event_id LIMIT 40""")
def fl08(r: Roles):
    alerts = r.table("events").select(
        F.col("event_id").alias("alert_id"),
        F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("severity"),
        F.when(F.col("event_type") != "view", "ACTIVE").otherwise("RESOLVED").alias("status"),
        F.col("ts").alias("created_at"),
    )
    return op.alerts_by(alerts, status="ACTIVE", severity="HIGH", top=40)


@query("fl10_edges_between", """
    SELECT bin, contractor_id, filing_date AS ts FROM jobs WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'""")
def fl10(r: Roles):
    edges = r.jobs().select("bin", "contractor_id", F.col("filing_date").alias("ts"))
    return op.edges_between(edges, "1996-01-01", "1996-03-31")


@query("fl11_drop_missing", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def fl11(r: Roles):
    joined = r.table("documents").join(r.table("labels"), "doc_id", "left")
    return joined.select("doc_id", "quality").na.drop(subset=["quality"])


@query("fl12_distinct_values", "SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL")
def fl12(r: Roles):
    return op.distinct_values(r.table("part"), "p_name")


@query("so01_multi_key_order", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier")
def so01(r: Roles):
    ordered = RecordQuery(order=[("s_nationkey", "asc"), ("s_acctbal", "desc"), ("s_suppkey", "asc")])
    return ordered.run(r.table("supplier").select("s_nationkey", "s_acctbal", "s_suppkey"))


@query("so02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def so02(r: Roles):
    spec = RecordQuery(order=[("o_totalprice", "desc"), ("o_orderkey", "asc")], top=20)
    return spec.run(r.table("orders").select("o_orderkey", "o_totalprice"))


@query("st01_tagged_union", """
    SELECT 'violation' AS record, bin, issue_date AS date FROM violations
    UNION ALL SELECT 'complaint', bin, date_entered FROM complaints""")
def st01(r: Roles):
    violations = r.violations().select(F.lit("violation").alias("record"), "bin", F.col("issue_date").alias("date"))
    complaints = r.complaints().select(F.lit("complaint").alias("record"), "bin", F.col("date_entered").alias("date"))
    return violations.unionByName(complaints)


@query("st02_entity_summaries", """
    SELECT 'owners' AS entity_type, count(*) AS total FROM customer UNION ALL SELECT 'properties', count(*) FROM orders
    UNION ALL SELECT 'contractors', count(*) FROM supplier""")
def st02(r: Roles):
    parts = [
        r.table(t).agg(F.count("*").alias("total")).select(F.lit(name).alias("entity_type"), "total")
        for name, t in (("owners", "customer"), ("properties", "orders"), ("contractors", "supplier"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("st03_duplicate_rows", """
    SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part)) AS n_distinct,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part)) AS duplicates FROM part""")
def st03(r: Roles):
    groups = r.table("part").groupBy("p_name", "p_brand", "p_type").count()
    out = groups.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_distinct"))
    return out.withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))


@query("st04_snapshot_difference", """
    WITH a AS (SELECT DISTINCT contractor_id, bin FROM jobs WHERE year(filing_date) = 1996),
         b AS (SELECT DISTINCT contractor_id, bin FROM jobs WHERE year(filing_date) = 1997)
    SELECT 'new' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'lost', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def st04(r: Roles):
    year = lambda y: r.jobs().filter(F.year("filing_date") == y).select("contractor_id", "bin").distinct()
    return snapshot_changes(year(1996), year(1997), ["contractor_id", "bin"])


def snapshot_changes(before, after, keys):
    """Rows only in the later snapshot ('new') and only in the earlier ('lost')."""
    new = after.join(before, keys, "left_anti").select(F.lit("new").alias("change"), *keys)
    lost = before.join(after, keys, "left_anti").select(F.lit("lost").alias("change"), *keys)
    return new.unionByName(lost)
