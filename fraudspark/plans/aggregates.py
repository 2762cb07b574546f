"""Aggregation queries (AG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import aggregates as op
from fraudspark.plans.patterns import ALERTS_SQL, all_alerts
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.session import cut_lineage


@query("ag01_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def ag01(r: Roles):
    return op.value_counts(r.table("part"), "p_type", top=5)


@query("ag02_groups_above", "SELECT bin, count(*) AS n FROM jobs GROUP BY 1 HAVING count(*) > 5")
def ag02(r: Roles):
    return op.groups_above(r.jobs(), "bin", 5)


@query("ag03_count_per_address", """
    SELECT owner_address, count(*) AS n FROM owners GROUP BY 1""")
def ag03(r: Roles):
    return op.value_counts(r.owners(), "owner_address").orderBy(F.desc("n"), "owner_address")


@query("ag04_label_counts", """
    SELECT 'Owner' AS label, count(*) AS total FROM customer UNION ALL SELECT 'Property', count(*) FROM orders
    UNION ALL SELECT 'Job', count(*) FROM lineitem UNION ALL SELECT 'OWNS', count(*) FROM orders
    UNION ALL SELECT 'VIOLATION_AT', count(*) FROM violations""")
def ag04(r: Roles):
    return op.label_counts({
        "Owner": r.table("customer"), "Property": r.table("orders"), "Job": r.table("lineitem"),
        "OWNS": r.owns(), "VIOLATION_AT": r.violations(),
    })


@query("ag05_correlations", """
    SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def ag05(r: Roles):
    out = op.correlations(r.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("correlation", F.round("correlation", 6))


@query("ag06_histogram", """
    SELECT CAST(floor((l_extendedprice - 0) / 5000) + 1 AS BIGINT) AS bucket, count(*) AS n,
           CAST(floor(l_extendedprice / 5000) * 5000 AS DOUBLE) AS start FROM lineitem
    WHERE l_extendedprice >= 0 AND l_extendedprice < 100000 GROUP BY ALL
    UNION ALL SELECT 21, count(*), 100000 FROM lineitem WHERE l_extendedprice >= 100000 HAVING count(*) > 0""")
def ag06(r: Roles):
    return op.histogram(r.table("lineitem"), "l_extendedprice", 0, 100000, 20)


@query("ag07_box_statistics", """
    SELECT l_returnflag, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
           max(l_extendedprice) AS high FROM lineitem GROUP BY 1""")
def ag07(r: Roles):
    box = op.box_statistics(r.table("lineitem"), "l_extendedprice", ["l_returnflag"])
    return box.select("l_returnflag", "low", "high", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("ag08_value_series", """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(avg(o_totalprice), 2) AS mean_value, count(*) AS n
    FROM orders GROUP BY 1""")
def ag08(r: Roles):
    out = op.series(r.table("orders"), "o_orderdate", "o_totalprice", "month")
    return out.withColumn("mean_value", F.round("mean_value", 2))


@query("ag09_alert_report", ALERTS_SQL + """
    , names AS (SELECT unnest(['pass_through', 'control_fraud', 'single_customer', 'shell_company', 'suspicious_timing', 'network_cluster']) AS pattern)
    SELECT pattern, count(company_id) AS n_alerts, round(coalesce(avg(risk_score), 0), 6) AS mean_risk,
           count(*) FILTER (risk_score > 0.8) AS high_risk
    FROM names FULL JOIN alerts USING (pattern) GROUP BY 1""")
def ag09(r: Roles):
    patterns = ["pass_through", "control_fraud", "single_customer", "shell_company", "suspicious_timing", "network_cluster"]
    return op.alert_report(all_alerts(r), patterns).withColumn("mean_risk", F.round("mean_risk", 6))


@query("ag10_monitoring_history", """
    SELECT CASE WHEN value > 75 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS severity, count(*) AS n_alerts,
           round(avg(value), 4) AS mean_score, count(*) FILTER (value > 60) AS high_risk
    FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11' GROUP BY 1""")
def ag10(r: Roles):
    severity = F.when(F.col("value") > 75, "CRITICAL").when(F.col("value") > 50, "HIGH").otherwise("LOW")
    alerts = r.table("events").select(
        severity.alias("severity"), F.col("value").alias("score"), F.col("ts").alias("created_at")
    )
    return op.monitoring_history(alerts, "2024-01-10", "2024-01-11")


@query("ag11_entities_per_category", "SELECT event_type AS entity_type, count(*) AS n FROM events GROUP BY 1")
def ag11(r: Roles):
    return op.value_counts(r.table("events").withColumnRenamed("event_type", "entity_type"), "entity_type")


@query("ag15_distinct_counts", """
    SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
    UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem""")
def ag15(r: Roles):
    return op.distinct_counts(r.table("lineitem"), ["l_partkey", "l_suppkey", "l_quantity"])


COUNTED = ["l_partkey", "l_suppkey", "l_quantity", "l_orderkey"]


@query("ag15_distinct_counts_approx", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_exact, true AS within_error FROM lineitem""" for c in COUNTED))
def ag15_approx(r: Roles):
    lines = r.table("lineitem").select(*COUNTED)
    near = op.distinct_counts(lines, COUNTED, error=0.02).withColumnRenamed("n_distinct", "n")
    exact = op.distinct_counts(lines, COUNTED).withColumnRenamed("n_distinct", "n_exact")
    return exact.join(near, "column").select("column", "n_exact", (F.abs(F.col("n") - F.col("n_exact")) <= 3 * 0.02 * F.col("n_exact")).alias("within_error"))


@query("ag15_merged_sketches", " UNION ALL ".join(f"""
    SELECT l_returnflag, '{c}' AS "column", count(DISTINCT {c}) AS n_exact, true AS within_error, true AS same_as_one_pass
    FROM lineitem GROUP BY 1""" for c in COUNTED))
def ag15_merged(r: Roles):
    """Sketches stored by day and return flag, merged over all days, against exact counts and against one pass."""
    lines = r.table("lineitem").select("l_returnflag", "l_shipdate", *COUNTED)
    daily = cut_lineage(op.distinct_sketches(lines, COUNTED, ["l_shipdate", "l_returnflag"]), "sketches")
    merged = op.merged_distinct(daily, ["l_returnflag"])
    once = op.merged_distinct(op.distinct_sketches(lines, COUNTED, ["l_returnflag"]), ["l_returnflag"]).withColumnRenamed("n_distinct", "n_once")
    counts = [F.countDistinct(c).alias(c) for c in COUNTED]
    exact = lines.groupBy("l_returnflag").agg(*counts).unpivot(["l_returnflag"], COUNTED, "column", "n_exact")
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 3 * op.SKETCH_ERROR * F.col("n_exact")
    return exact.join(merged, ["l_returnflag", "column"]).join(once, ["l_returnflag", "column"]).select(
        "l_returnflag", "column", "n_exact", near.alias("within_error"), (F.col("n_distinct") == F.col("n_once")).alias("same_as_one_pass"))
