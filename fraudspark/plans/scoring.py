"""Risk-score, alert and link queries (RS). Entity features are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import communities, graph
from fraudspark.operators import scoring as op
from fraudspark.operators.enrich import with_branches
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.session import cut_lineage

FEATURE_SQL = {
    "person": """
        SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'ACTIVE' END AS license_status,
               coalesce(nv, 0) AS violation_count, coalesce(nj, 0) AS recent_job_count, c_nationkey % 5 AS address_inconsistencies,
               c_acctbal < 0 AS payment_issues
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS nj, count(*) FILTER (l_returnflag IN ('R', 'A')) AS nv
                                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""",
    "property": """
        SELECT o_orderkey AS id, coalesce(n, 0) * 2 AS permit_count_6months, coalesce(nv, 0) / 100.0::DOUBLE AS violations_per_sqft,
               o_custkey % 6 AS ownership_changes_2years, coalesce(nr, 0) AS zoning_violations,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS emergency_orders
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag IN ('R', 'A')) AS nv,
                                      count(*) FILTER (l_returnflag = 'R') AS nr FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "job": """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS id,
               l_extendedprice AS estimated_cost, l_extendedprice * (1 + l_discount * 8) AS actual_cost, l_linenumber AS timeline_violations,
               CAST(l_quantity AS BIGINT) % 7 AS failed_inspections, l_suppkey % 4 AS unlicensed_work_indicators, l_returnflag = 'R' AS rapid_permit_cycling
        FROM lineitem""",
    "violation": """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS id,
               CAST(l_quantity AS BIGINT) % 10 AS severity_score, l_linenumber AS repeat_violation_count, l_partkey % 200 AS non_compliance_days,
               l_tax > 0.07 AS fine_evasion_indicators, l_suppkey % 3 AS safety_violations
        FROM lineitem WHERE l_returnflag IN ('R', 'A')""",
    "inspection": """
        SELECT event_id AS id, (event_id % 10) / 10.0::DOUBLE AS inspection_failure_rate, user_id % 5 AS inspection_avoidance_indicators,
               event_type = 'error' AS document_fraud_indicators, event_id % 3 AS inspector_red_flags, event_id % 8 AS compliance_gaming_score
        FROM events""",
    "financial": """
        SELECT s_suppkey AS id, s_nationkey % 5 AS payment_irregularities, s_acctbal * 3 AS unpaid_fees_amount, s_suppkey % 7 = 0 AS financial_document_fraud,
               s_nationkey % 10 AS money_laundering_score, s_suppkey % 3 AS tax_evasion_indicators FROM supplier""",
}


def person_features(r: Roles):
    facts = r.table("lineitem").join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = facts.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("recent_job_count"), F.count_if(F.col("l_returnflag").isin("R", "A")).alias("violation_count")
    )
    key = F.col("c_custkey")
    status = F.when(key % 4 == 0, "EXPIRED").when(key % 4 == 1, "SUSPENDED").when(key % 4 == 2, "ACTIVE")
    people = r.table("customer").select(
        key.alias("id"), status.alias("license_status"), (F.col("c_nationkey") % 5).alias("address_inconsistencies"),
        (F.col("c_acctbal") < 0).alias("payment_issues"),
    )
    return with_branches(people, ["id"], [counts])


def property_features(r: Roles):
    counts = r.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag").isin("R", "A")).alias("nv"),
        F.count_if(F.col("l_returnflag") == "R").alias("zoning_violations"),
    )
    orders = r.table("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 6).alias("ownership_changes_2years"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("emergency_orders"),
    )
    return with_branches(orders, ["id"], [counts]).withColumns({
        "permit_count_6months": F.col("n") * 2, "violations_per_sqft": F.col("nv") / 100.0
    })


def job_features(r: Roles):
    cost = F.col("l_extendedprice")
    return r.table("lineitem").select(
        r._line_id().alias("id"), cost.alias("estimated_cost"), (cost * (1 + F.col("l_discount") * 8)).alias("actual_cost"),
        F.col("l_linenumber").alias("timeline_violations"), (F.col("l_quantity").cast("bigint") % 7).alias("failed_inspections"),
        (F.col("l_suppkey") % 4).alias("unlicensed_work_indicators"), (F.col("l_returnflag") == "R").alias("rapid_permit_cycling"),
    )


def violation_features(r: Roles):
    return r.table("lineitem").filter(F.col("l_returnflag").isin("R", "A")).select(
        r._line_id().alias("id"), (F.col("l_quantity").cast("bigint") % 10).alias("severity_score"),
        F.col("l_linenumber").alias("repeat_violation_count"), (F.col("l_partkey") % 200).alias("non_compliance_days"),
        (F.col("l_tax") > 0.07).alias("fine_evasion_indicators"), (F.col("l_suppkey") % 3).alias("safety_violations"),
    )


def inspection_features(r: Roles):
    key = F.col("event_id")
    return r.table("events").select(
        key.alias("id"), (key % 10 / 10.0).alias("inspection_failure_rate"),
        (F.col("user_id") % 5).alias("inspection_avoidance_indicators"),
        (F.col("event_type") == "error").alias("document_fraud_indicators"),
        (key % 3).alias("inspector_red_flags"), (key % 8).alias("compliance_gaming_score"),
    )


def financial_features(r: Roles):
    return r.table("supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("payment_irregularities"),
        (F.col("s_acctbal") * 3).alias("unpaid_fees_amount"), (F.col("s_suppkey") % 7 == 0).alias("financial_document_fraud"),
        (F.col("s_nationkey") % 10).alias("money_laundering_score"), (F.col("s_suppkey") % 3).alias("tax_evasion_indicators"),
    )


FEATURES = {
    "person": person_features, "property": property_features, "job": job_features,
    "violation": violation_features, "inspection": inspection_features, "financial": financial_features,
}

RULE_SQL = {
    "person": (0.2, [
        ("license_status IN ('EXPIRED', 'SUSPENDED', 'REVOKED')", "25", "'License status: ' || license_status"),
        ("violation_count > 5", "least(violation_count * 3, 30)", "'High violation count: ' || violation_count"),
        ("recent_job_count > 20", "20", "'Unusually high recent job activity: ' || recent_job_count"),
        ("address_inconsistencies > 2", "15", "'Multiple address inconsistencies'"),
        ("payment_issues", "20", "'Payment processing issues'")]),
    "property": (0.25, [
        ("permit_count_6months > 10", "least(permit_count_6months * 2, 25)", "'High permit activity: ' || permit_count_6months || ' in 6 months'"),
        ("violations_per_sqft > 0.01", "20", "'High violation density: ' || violations_per_sqft"),
        ("ownership_changes_2years > 3", "15", "'Frequent ownership changes: ' || ownership_changes_2years"),
        ("zoning_violations > 2", "20", "'Multiple zoning violations'"),
        ("emergency_orders > 0", "30", "'Emergency orders issued'")]),
    "job": (0.2, [
        ("estimated_cost > 0 AND actual_cost > 0 AND abs(actual_cost - estimated_cost) / estimated_cost > 0.5", "25",
         "printf('Large cost discrepancy: %.1f%%', abs(actual_cost - estimated_cost) / estimated_cost * 100)"),
        ("timeline_violations > 2", "20", "'Multiple timeline violations'"),
        ("failed_inspections > 3", "least(failed_inspections * 5, 25)", "'High inspection failure rate: ' || failed_inspections"),
        ("unlicensed_work_indicators > 1", "30", "'Indicators of unlicensed work'"),
        ("rapid_permit_cycling", "20", "'Rapid permit cycling detected'")]),
    "violation": (0.25, [
        ("severity_score > 7", "severity_score * 3", "'High severity violations: ' || severity_score"),
        ("repeat_violation_count > 2", "least(repeat_violation_count * 8, 30)", "'Repeat violations: ' || repeat_violation_count"),
        ("non_compliance_days > 90", "25", "'Extended non-compliance period'"),
        ("fine_evasion_indicators", "20", "'Fine evasion indicators'"),
        ("safety_violations > 1", "25", "'Multiple safety violations'")]),
    "inspection": (0.2, [
        ("inspection_failure_rate > 0.4", "inspection_failure_rate * 30", "printf('High inspection failure rate: %.1f%%', inspection_failure_rate * 100)"),
        ("inspection_avoidance_indicators > 2", "25", "'Inspection avoidance patterns'"),
        ("document_fraud_indicators", "35", "'Fraudulent documentation indicators'"),
        ("inspector_red_flags > 1", "20", "'Inspector red flags raised'"),
        ("compliance_gaming_score > 5", "15", "'Compliance gaming detected'")]),
    "financial": (0.3, [
        ("payment_irregularities > 2", "25", "'Multiple payment irregularities'"),
        ("unpaid_fees_amount > 10000", "least(unpaid_fees_amount / 1000, 30)", "format('High unpaid fees: ${:,.2f}', unpaid_fees_amount)"),
        ("financial_document_fraud", "40", "'Financial document fraud indicators'"),
        ("money_laundering_score > 6", "35", "'Money laundering indicators'"),
        ("tax_evasion_indicators > 1", "20", "'Tax evasion patterns'")]),
}


def scored_sql(kind: str) -> str:
    """SELECT of the score table of one type, written as SQL of its own."""
    weight, rules = RULE_SQL[kind]
    points = " + ".join(f"CASE WHEN {c} THEN ({p})::DOUBLE ELSE 0 END" for c, p, _ in rules)
    texts = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in rules)
    held = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _, _ in rules)
    return f"""
        SELECT '{kind}' AS entity_type, CAST(id AS VARCHAR) AS entity_id, round(({points})::DOUBLE, 6) AS risk_score,
               CASE WHEN ({points}) >= 75 THEN 'CRITICAL' WHEN ({points}) >= 50 THEN 'HIGH' WHEN ({points}) >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
               concat_ws('; ', {texts}) AS risk_factors, round(least(({held}) * {weight}, 1.0), 4)::DOUBLE AS confidence
        FROM ({FEATURE_SQL[kind]})"""


def flat(scores):
    return scores.withColumns({
        "risk_factors": F.array_join("risk_factors", "; "), "risk_score": F.round("risk_score", 6)
    })


for _number, _kind in enumerate(FEATURES, start=1):
    query(f"rs{_number:02d}_{_kind}_scores", scored_sql(_kind))(
        lambda r, kind=_kind: flat(op.score(FEATURES[kind](r), kind))
    )

ALL_SCORES_SQL = "scores AS (" + " UNION ALL ".join(scored_sql(k) for k in FEATURES) + ")"


def all_scores(r: Roles):
    return op.score_all({kind: build(r) for kind, build in FEATURES.items()})


@query("rs07_risk_levels", f"""
    WITH {ALL_SCORES_SQL} SELECT entity_type, risk_level, count(*) AS n, max(risk_score) AS highest FROM scores GROUP BY 1, 2""")
def rs07(r: Roles):
    return all_scores(r).groupBy("entity_type", "risk_level").agg(
        F.count("*").alias("n"), F.round(F.max("risk_score"), 6).alias("highest")
    )


@query("rs08_confidence", f"""
    WITH {ALL_SCORES_SQL} SELECT entity_type, confidence, count(*) AS n FROM scores GROUP BY 1, 2""")
def rs08(r: Roles):
    return all_scores(r).groupBy("entity_type", "confidence").agg(F.count("*").alias("n"))


@query("rs09_mixed_scores", f"""
    WITH {ALL_SCORES_SQL} SELECT * FROM scores
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 0, 'LOW', '', 0 FROM nation""")
def rs09(r: Roles):
    """One table with the entities of all six types, and some of a type without rules."""
    mixed = r.table("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("nation").alias("entity_type"))
    for kind, build in FEATURES.items():
        tagged = build(r).withColumn("id", F.col("id").cast("string")).withColumn("entity_type", F.lit(kind))
        mixed = mixed.unionByName(tagged, allowMissingColumns=True)
    return flat(op.score_mixed(cut_lineage(mixed, "mixed")))


COMPOSITE_SQL = """
    c AS (SELECT {keys} count(*) AS entities, least(sum(risk_score * confidence) / count(*), 100) AS s,
                 count(*) FILTER (risk_score > 60) AS high_risk_entities FROM scores GROUP BY ALL)
    SELECT {keys} entities, high_risk_entities, round(s, 2) AS composite_score,
           CASE WHEN s >= 75 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS composite_level"""


@query("rs10_composite", f"WITH {ALL_SCORES_SQL}, " + COMPOSITE_SQL.format(keys="") + " FROM c")
def rs10(r: Roles):
    return op.composite(all_scores(r))


@query("rs10_composite_per_type", f"WITH {ALL_SCORES_SQL}, " + COMPOSITE_SQL.format(keys="entity_type,") + " FROM c")
def rs10_type(r: Roles):
    return op.composite(all_scores(r), ["entity_type"])


@query("rs11_recommendations", f"""
    WITH {ALL_SCORES_SQL.replace("scores AS", "all_scores AS")},
    scores AS (SELECT CAST(entity_id AS BIGINT) % 500 AS case_id, * FROM all_scores WHERE entity_type = 'inspection'),
    c AS (SELECT case_id, count(*) AS entities, round(least(sum(risk_score * confidence) / count(*), 100), 2) AS s,
                 count(*) FILTER (risk_score > 60) AS hr FROM scores GROUP BY 1)
    SELECT case_id, entities, hr AS high_risk_entities, s AS composite_score,
           CASE WHEN s >= 75 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS composite_level,
           concat_ws(' | ', CASE WHEN s > 75 THEN '{" | ".join(op.RECOMMENDATIONS[0][1])}' WHEN s > 50 THEN '{" | ".join(op.RECOMMENDATIONS[1][1])}'
                                 WHEN s > 25 THEN '{" | ".join(op.RECOMMENDATIONS[2][1])}' END,
                     CASE WHEN hr > 0 THEN 'Focus investigation on high-risk entities' END) AS recommendations FROM c""")
def rs11(r: Roles):
    scores = op.score(inspection_features(r), "inspection")
    cases = scores.withColumn("case_id", F.col("entity_id").cast("bigint") % 500)
    out = op.recommendations(cases, ["case_id"])
    return out.withColumn("recommendations", F.array_join("recommendations", " | "))


@query("rs11_focus_entities", f"""
    WITH {ALL_SCORES_SQL} SELECT CAST(entity_id AS BIGINT) % 500 AS case_id, entity_type, entity_id, round(risk_score, 4) AS risk_score
    FROM scores WHERE entity_type = 'inspection' AND risk_score > 60""")
def rs11_entities(r: Roles):
    scores = op.score(inspection_features(r), "inspection")
    cases = scores.withColumn("case_id", F.col("entity_id").cast("bigint") % 500)
    return op.focus_entities(cases, ["case_id"]).withColumn("risk_score", F.round("risk_score", 4))


@query("rs12_building_risk", """
    WITH v AS (SELECT bin, count(*) AS violation_count FROM violations GROUP BY 1), c AS (SELECT bin, count(*) AS complaint_count FROM complaints GROUP BY 1),
    s AS (SELECT bin, coalesce(violation_count, 0) AS violation_count, coalesce(complaint_count, 0) AS complaint_count FROM v FULL JOIN c USING (bin)),
    t AS (SELECT *, round(least(1.0, violation_count * 0.1 + complaint_count * 0.05), 4)::DOUBLE AS risk_score FROM s)
    SELECT *, CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.5 THEN 'high' WHEN risk_score >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level FROM t""")
def rs12(r: Roles):
    return op.building_risk(r.violations(), r.complaints())


@query("rs13_property_scores", """
    SELECT bin, count(*) AS violation_count, count(DISTINCT violation_type) AS n_types,
           round(count(*) * 0.3 + count(DISTINCT violation_type) * 0.7, 2)::DOUBLE AS fraud_score
    FROM typed_violations GROUP BY 1 ORDER BY violation_count DESC, bin LIMIT 50""")
def rs13(r: Roles):
    return op.property_scores(r.typed_violations())


def nation_communities(r: Roles):
    """Records grouped by the nation they belong to, as members of communities."""
    member = lambda df, node, kind, group: df.select(
        F.col(group).alias("community_id"), F.concat_ws(":", F.lit(kind), F.col(node).cast("string")).alias("node_id"),
        F.lit(kind).alias("node_type"),
    )
    supplier = r.table("supplier").withColumn("g", F.col("s_suppkey") % 40)
    part = r.table("part").withColumn("g", F.col("p_partkey") % 60)
    customer = r.table("customer").withColumn("g", F.col("c_custkey") % 50)
    orders = r.table("orders").withColumn("g", F.col("o_orderkey") % 45)
    return (
        member(supplier, "s_suppkey", "contractor", "g")
        .unionByName(member(part, "p_partkey", "permit", "g"))
        .unionByName(member(customer, "c_custkey", "property", "g"))
        .unionByName(member(orders, "o_orderkey", "violation", "g"))
    )


MEMBERS_SQL = """
    members AS (SELECT s_suppkey % 40 AS community_id, 'contractor' AS node_type FROM supplier UNION ALL SELECT p_partkey % 60, 'permit' FROM part
                UNION ALL SELECT c_custkey % 50, 'property' FROM customer UNION ALL SELECT o_orderkey % 45, 'violation' FROM orders),
    n AS (SELECT community_id, count(*) AS size, count(*) FILTER (node_type = 'contractor') AS contractors, count(*) FILTER (node_type = 'permit') AS permits,
                 count(*) FILTER (node_type = 'violation') AS violations, count(*) FILTER (node_type = 'property') AS properties FROM members GROUP BY 1),
    i AS (SELECT *, CASE WHEN contractors = 1 AND permits > 5 THEN 'single_contractor_multiple_permits' END AS i1,
                 CASE WHEN permits > 0 AND violations > 0 THEN 'permit_violation_correlation' END AS i2,
                 CASE WHEN properties > size * 0.3 THEN 'high_property_concentration' END AS i3 FROM n)
"""


@query("rs14_community_indicators", "WITH " + MEMBERS_SQL + """
    SELECT community_id, size, contractors, permits, violations, properties, concat_ws(',', i1, i2, i3) AS indicators FROM i""")
def rs14(r: Roles):
    out = op.community_indicators(nation_communities(r))
    return out.withColumn("indicators", F.array_join("indicators", ","))


COMMUNITY_RISK_SQL = MEMBERS_SQL + """
    , p AS (SELECT community_id, size, (i1 IS NOT NULL)::INT + (i2 IS NOT NULL)::INT + (i3 IS NOT NULL)::INT + (size > 10)::INT + (size > 20)::INT AS pts FROM i),
      risk AS (SELECT community_id, size, CASE WHEN pts >= 4 THEN 'critical' WHEN pts >= 3 THEN 'high' WHEN pts >= 1 THEN 'medium' ELSE 'low' END AS risk_level FROM p)
"""


def community_risks(r: Roles):
    out = op.community_indicators(nation_communities(r))
    return out.select("community_id", "size", op.community_risk(F.col("indicators"), F.col("size")).alias("risk_level"))


@query("rs15_community_risk", "WITH " + COMMUNITY_RISK_SQL + "SELECT * FROM risk")
def rs15(r: Roles):
    return community_risks(r)


@query("ag16_community_summary", "WITH " + COMMUNITY_RISK_SQL + """
    SELECT count(*) AS total_communities, count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk_communities,
           CASE WHEN count(*) FILTER (risk_level IN ('high', 'critical')) > 5 THEN 'HIGH' WHEN count(*) FILTER (risk_level IN ('high', 'critical')) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk_level,
           count(*) FILTER (risk_level IN ('high', 'critical')) > 3 AS requires_investigation FROM risk""")
def ag16(r: Roles):
    from fraudspark.operators.aggregates import community_summary

    return community_summary(community_risks(r))


@query("rs15_detected_communities", """
    WITH m AS (SELECT DISTINCT 'contractor' AS node_type, l_suppkey AS id FROM lineitem UNION ALL SELECT DISTINCT 'property', l_orderkey FROM lineitem
               UNION ALL SELECT DISTINCT 'violation_type', CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END FROM lineitem)
    SELECT node_type, count(*) AS nodes, true AS consistent FROM m GROUP BY 1""")
def rs15_detected(r: Roles):
    """From links to risk in one chain: contractors and properties in communities found by propagation, scored.

    Rows say how many nodes of each type the communities hold, and whether every community's indicators and level fit its members.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    lines = r.table("lineitem").withColumn("code", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3))
    links = lines.select(node("contractor", "l_suppkey").alias("src"), node("property", "l_orderkey").alias("dst")).unionByName(
        lines.select(node("contractor", "l_suppkey").alias("src"), node("violation_type", "code").alias("dst")).distinct())
    labels = communities.label_propagation(graph.canonical(links))
    members = cut_lineage(labels.select(F.col("label").alias("community_id"), F.col("node").alias("node_id"), F.substring_index("node", ":", 1).alias("node_type")), "members")
    found = op.community_indicators(members)
    rated = found.withColumn("level", op.community_risk(F.col("indicators"), F.col("size")))
    few = (F.size("indicators") == 0) & (F.col("size") <= 10)
    fits = ((F.col("level") == "low") == few) & (F.col("size") >= F.col("contractors") + F.col("properties")) & (
        F.array_contains("indicators", "high_property_concentration") == (F.col("properties") > 0.3 * F.col("size")))
    return members.join(rated.select("community_id", fits.alias("fits")), "community_id").groupBy("node_type").agg(
        F.count("*").alias("nodes"), F.every("fits").alias("consistent"))


@query("rs16_oversized_communities", "WITH " + MEMBERS_SQL + """
    SELECT community_id, size FROM n WHERE size > 0.8 * (SELECT max(size) FROM n)""")
def rs16(r: Roles):
    return op.oversized_communities(nation_communities(r))


@query("rs17_narrow_communities", """
    SELECT l_suppkey AS community_id, count(DISTINCT l_orderkey) AS properties, count(DISTINCT l_returnflag) AS types
    FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 2 AND count(DISTINCT l_returnflag) <= 2""")
def rs17(r: Roles):
    lines = r.table("lineitem")
    member = lambda node, kind: lines.select(
        F.col("l_suppkey").alias("community_id"), F.col(node).cast("string").alias("node_id"), F.lit(kind).alias("node_type")
    ).distinct()
    return op.narrow_communities(member("l_orderkey", "property").unionByName(member("l_returnflag", "violation_type")))


# Every kind of link that the tables have keys for: 11 of the 15. Nothing leads from an inspection (an event of a
# user) to a property, job, violation or payment.
_LINE = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'))"
LINKED_SQL = f"""
    {ALL_SCORES_SQL.replace("scores AS (", "scores AS MATERIALIZED (")},
    line AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS person, CAST(l_orderkey AS VARCHAR) AS property, {_LINE} AS job,
             CASE WHEN l_returnflag IN ('R', 'A') THEN {_LINE} END AS violation, CAST(l_suppkey AS VARCHAR) AS financial
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    links AS MATERIALIZED (SELECT DISTINCT 'person' AS a_type, CAST(o_custkey AS VARCHAR) AS a_id, 'property' AS b_type, CAST(o_orderkey AS VARCHAR) AS b_id FROM orders
              UNION SELECT 'person', CAST(user_id AS VARCHAR), 'inspection', CAST(event_id AS VARCHAR) FROM events
              {"".join(f" UNION SELECT '{a}', {a}, '{b}', {b} FROM line WHERE {b} IS NOT NULL AND {a} IS NOT NULL"
                       for a, b in (("person", "job"), ("person", "violation"), ("person", "financial"), ("property", "job"), ("property", "violation"),
                                    ("property", "financial"), ("job", "violation"), ("job", "financial"), ("violation", "financial")))}),
    weight AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {w}::DOUBLE)" for (a, b), w in op.LINK_WEIGHTS.items())}) t(a_type, b_type, w)),
    corr AS MATERIALIZED (SELECT a_type, a_id, b_type, b_id, round(w * least(x.confidence, y.confidence), 6) AS strength, greatest(x.risk_score, y.risk_score) AS top
             FROM links JOIN weight USING (a_type, b_type)
             JOIN scores x ON x.entity_type = a_type AND x.entity_id = a_id JOIN scores y ON y.entity_type = b_type AND y.entity_id = b_id)
"""

#: Pairs of keys that lie on one line of the job table.
LINE_LINKS = [
    ("person", "job"), ("person", "violation"), ("person", "financial"), ("property", "job"), ("property", "violation"),
    ("property", "financial"), ("job", "violation"), ("job", "financial"), ("violation", "financial"),
]


def entity_links(r: Roles):
    """All links, bundled by the end they are dealt by, with one pass over the lines for those between their keys."""
    text = lambda c: F.col(c).cast("string")
    owned = r.table("orders").select(text("o_custkey").alias("person"), text("o_orderkey").alias("property"))
    visits = r.table("events").select(text("user_id").alias("person"), text("event_id").alias("inspection"))
    lines = r.table("lineitem").join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = lines.select(
        text("o_custkey").alias("person"), text("l_orderkey").alias("property"), r._line_id().alias("job"),
        F.when(F.col("l_returnflag").isin("R", "A"), r._line_id()).alias("violation"), text("l_suppkey").alias("financial"))
    alone = op.bundled_links(owned, [("person", "property")]).unionByName(op.bundled_links(visits, [("person", "inspection")]))
    return alone.unionByName(op.bundled_links(keys, LINE_LINKS))


def linked_scores(r: Roles):
    # Read by both sides of the links.
    return cut_lineage(all_scores(r).select("entity_type", "entity_id", "risk_score", "confidence"), "scores")


@query("rs18_correlated_entities", "WITH " + LINKED_SQL + """
    SELECT a_type, a_id, b_type, b_id, strength, round(top * (1 + strength), 4) AS combined_risk FROM corr WHERE strength >= 0.3""")
def rs18(r: Roles):
    return op.correlated_entities(linked_scores(r), entity_links(r))


@query("rs20_create_alerts", "WITH " + ALL_SCORES_SQL + """
    SELECT risk_level AS severity, entity_type || ':' || entity_id AS entities, risk_score AS score, risk_factors, 'ACTIVE' AS status,
           DATE '2024-02-01' AS created_at FROM scores WHERE risk_score >= 50""")
def rs20(r: Roles):
    alerts = op.create_alerts(all_scores(r), F.lit("2024-02-01").cast("date"))
    return alerts.select(
        "severity", F.array_join("entities", ",").alias("entities"), F.round("score", 6).alias("score"),
        F.array_join("risk_factors", "; ").alias("risk_factors"), "status", "created_at",
    )


STATUS_OF = {"signup": "ACTIVE", "view": "INVESTIGATING", "purchase": "RESOLVED", "error": "FALSE_POSITIVE"}


def status_changes(r: Roles):
    """Events of users as a log of alert status changes; clicks are not a status."""
    status = F.lit("UNKNOWN")
    for kind, name in STATUS_OF.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return r.table("events").select(
        F.col("user_id").alias("alert_id"), status.alias("status"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id")
    )


@query("rs21_current_status", """
    WITH l AS (SELECT user_id AS alert_id, CASE event_type WHEN 'signup' THEN 'ACTIVE' WHEN 'view' THEN 'INVESTIGATING' WHEN 'purchase' THEN 'RESOLVED'
                      WHEN 'error' THEN 'FALSE_POSITIVE' END AS status, ts, event_id FROM events)
    SELECT alert_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS changed_at, count(*) AS n_changes FROM l WHERE status IS NOT NULL GROUP BY 1""")
def rs21(r: Roles):
    return op.current_status(status_changes(r))


@query("rs22_payment_features", """
    SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'N')::DOUBLE / count(*), 6) AS dismissal_rate,
           round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS payment_rate,
           round(count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*), 6) AS inspection_rate,
           round(sum(l_extendedprice * (1 + l_tax)) / sum(l_extendedprice) - 1, 6) AS value_gap FROM lineitem GROUP BY 1""")
def rs22(r: Roles):
    price = F.col("l_extendedprice")
    facts = r.table("lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "N").alias("dismissed"), (price * F.col("l_discount")).alias("paid"),
        price.alias("imposed"), (F.col("l_linestatus") == "F").alias("inspected"), price.alias("estimated"),
        (price * (1 + F.col("l_tax"))).alias("actual"),
    )
    return op.payment_features(facts, "l_suppkey")


@query("rs23_contractor_summary", """
    WITH w AS (SELECT contractor_id, count(*) AS permits, count(*) FILTER (job_status = 'N') AS active_permits, count(DISTINCT bin) AS buildings FROM jobs GROUP BY 1),
    v AS (SELECT respondent_id AS contractor_id, count(*) AS violations FROM violations GROUP BY 1)
    SELECT contractor_id, permits, active_permits, buildings, coalesce(violations, 0) AS violations, n_name AS community,
           round(coalesce(violations, 0)::DOUBLE / permits, 6) AS violation_rate
    FROM w LEFT JOIN v USING (contractor_id) LEFT JOIN supplier ON s_suppkey = contractor_id LEFT JOIN nation ON s_nationkey = n_nationkey""")
def rs23(r: Roles):
    communities = r.contractors().select("contractor_id", F.col("license_type").alias("community"))
    return op.contractor_summary(r.jobs(), r.violations(), communities, F.col("job_status") == "N")
