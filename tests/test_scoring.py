import random

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import scoring

CASES = {
    "person": ("id string, license_status string, violation_count bigint, recent_job_count bigint, address_inconsistencies bigint, payment_issues boolean", [
        (("person_001", "SUSPENDED", 8, 25, 3, True), 104, "CRITICAL"), (("person_002", "EXPIRED", 3, 15, 1, False), 25, "MEDIUM"),
        (("person_003", "ACTIVE", 1, 5, 0, False), 0, "LOW"), (("person_004", None, None, None, None, None), 0, "LOW")]),
    "property": ("id string, permit_count_6months bigint, violations_per_sqft double, ownership_changes_2years bigint, zoning_violations bigint, emergency_orders bigint", [
        (("property_001", 15, 0.02, 5, 3, 2), 110, "CRITICAL"), (("property_002", 8, 0.008, 2, 1, 0), 0, "LOW")]),
    "job": ("id string, estimated_cost double, actual_cost double, timeline_violations bigint, failed_inspections bigint, unlicensed_work_indicators bigint, rapid_permit_cycling boolean", [
        (("job_001", 50000.0, 100000.0, 4, 5, 2, True), 120, "CRITICAL"), (("job_002", 30000.0, 40000.0, 1, 2, 0, False), 0, "LOW")]),
    "violation": ("id string, severity_score bigint, repeat_violation_count bigint, non_compliance_days bigint, fine_evasion_indicators boolean, safety_violations bigint", [
        (("violation_001", 9, 4, 120, True, 3), 127, "CRITICAL"), (("violation_002", 6, 2, 60, False, 1), 0, "LOW")]),
    "inspection": ("id string, inspection_failure_rate double, inspection_avoidance_indicators bigint, document_fraud_indicators boolean, inspector_red_flags bigint, compliance_gaming_score bigint", [
        (("inspection_001", 0.7, 3, True, 2, 8), 116, "CRITICAL"), (("inspection_002", 0.3, 1, False, 1, 4), 0, "LOW")]),
    "financial": ("id string, payment_irregularities bigint, unpaid_fees_amount double, financial_document_fraud boolean, money_laundering_score bigint, tax_evasion_indicators bigint", [
        (("financial_001", 4, 25000.0, True, 8, 2), 145, "CRITICAL"), (("financial_002", 2, 8000.0, False, 4, 1), 0, "LOW")]),
}


def table(spark, kind):
    schema, rows = CASES[kind]
    return spark.createDataFrame([r for r, _, _ in rows], schema)


@pytest.mark.parametrize("kind", CASES)
def test_scores(spark, kind):
    got = {r.entity_id: (round(r.risk_score, 6), r.risk_level) for r in scoring.score(table(spark, kind), kind).collect()}
    assert got == {r[0]: (points, level) for r, points, level in CASES[kind][1]}


def test_factors_and_confidence(spark):
    first = scoring.score(table(spark, "financial"), "financial").filter("entity_id = 'financial_001'").first()
    assert first.confidence == 1.0 and "High unpaid fees: $25,000.00" in first.risk_factors and len(first.risk_factors) == 5
    rate = scoring.score(table(spark, "inspection"), "inspection").filter("entity_id = 'inspection_001'").first()
    assert "High inspection failure rate: 70.0%" in rate.risk_factors


def test_composite_of_all_high(spark):
    high = scoring.score_all({k: table(spark, k).limit(1) for k in CASES})
    row = scoring.recommendations(high).first()
    assert row.composite_score == 100 and row.composite_level == "CRITICAL" and row.high_risk_entities == 6
    assert row.recommendations[0].startswith("IMMEDIATE ACTION") and "high-risk entities" in row.recommendations[-1]
    named = {(r.entity_type, r.entity_id) for r in scoring.focus_entities(high).collect()}
    assert len(named) == 6 and ("person", "person_001") in named


def test_levels(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 10.0, 24.9, 35.0, 60.0, 85.0, 100.0)], "s double")
    assert [r[0] for r in df.select(scoring.risk_level(F.col("s"))).collect()] == ["LOW", "LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL"]


def test_unknown_type(spark):
    df = spark.createDataFrame([("a", "person", "EXPIRED"), ("b", "alien", None), (None, None, None)], "id string, entity_type string, license_status string")
    for name, kind in [("violation_count", "bigint"), ("recent_job_count", "bigint"), ("address_inconsistencies", "bigint"), ("payment_issues", "boolean")]:
        df = df.withColumn(name, F.lit(None).cast(kind))
    for other in CASES:
        for part in CASES[other][0].split(", "):
            name, kind = part.split(" ")
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
    got = {(r.entity_id, r.entity_type): (r.risk_score, r.risk_level) for r in scoring.score_mixed(df).collect()}
    assert got == {("a", "person"): (25.0, "MEDIUM"), ("b", "alien"): (0.0, "LOW"), ("unknown", "unknown"): (0.0, "LOW")}


@pytest.mark.parametrize("indicators,size,level", [(0, 3, "low"), (1, 5, "medium"), (3, 8, "high"), (4, 25, "critical")])
def test_community_risk(spark, indicators, size, level):
    df = spark.range(1).select(F.array_repeat(F.lit("x"), indicators).alias("i"), F.lit(size).alias("s"))
    assert df.select(scoring.community_risk(F.col("i"), F.col("s"))).first()[0] == level


def test_community_indicators(spark):
    rows = [("c", "k", "contractor"), ("c", "v", "violation")] + [("c", f"p{i}", "permit") for i in range(6)]
    row = scoring.community_indicators(spark.createDataFrame(rows, "community_id string, node_id string, node_type string")).first()
    assert row.indicators == ["single_contractor_multiple_permits", "permit_violation_correlation"]


def test_links_cross_the_network_twice_and_give_all_strong_pairs(spark):
    draw = random.Random(4)
    types = ["person", "property", "job", "violation", "inspection", "financial"]
    known = [(t, str(i), draw.random() * 100, draw.choice([0.0, 0.2, 0.4, 0.8, 1.0])) for t in types for i in range(8)]
    links = [(a, str(draw.randrange(9)), b, str(draw.randrange(9))) for a, b in scoring.LINK_WEIGHTS for _ in range(30)]
    by_key = {k[:2]: k[2:] for k in known}
    want = {}
    for a, i, b, j in links:
        if (a, i) in by_key and (b, j) in by_key:
            strength = scoring.LINK_WEIGHTS[a, b] * min(by_key[a, i][1], by_key[b, j][1])
            if round(strength, 6) >= 0.3:
                want[a, i, b, j] = (strength, max(by_key[a, i][0], by_key[b, j][0]) * (1 + strength))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = spark.createDataFrame(known, "entity_type string, entity_id string, risk_score double, confidence double")
        found = scoring.correlated_entities(scores, spark.createDataFrame(links, "a_type string, a_id string, b_type string, b_id string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.a_type, r.a_id, r.b_type, r.b_id): (r.strength, r.combined_risk) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found.count() == len(got) and set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
    assert plan.count("Exchange hashpartitioning") <= 4


def test_bundled_links_are_the_links_one_by_one(spark):
    """an id that is long travels once for all its links; ids may be missing, and records come twice."""
    draw = random.Random(6)
    types = list(dict.fromkeys(t for p in scoring.LINK_WEIGHTS for t in p))
    known = [(t, str(i), draw.random() * 100, draw.choice([0.0, 0.4, 0.8, 1.0])) for t in types for i in range(8)] + [("job", "1", 5.0, 1.0)]
    records = [tuple(draw.choice([None, *map(str, range(9))]) for _ in types) for _ in range(40)]
    records += records[:9]
    pairs = [p for p in scoring.LINK_WEIGHTS if p != ("person", "inspection")]
    flat = [(a, x[types.index(a)], b, x[types.index(b)]) for x in records for a, b in pairs if x[types.index(a)] and x[types.index(b)]]
    scores = spark.createDataFrame(known, "entity_type string, entity_id string, risk_score double, confidence double")
    bundled = scoring.bundled_links(spark.createDataFrame(records, ", ".join(f"{t} string" for t in types)), pairs)
    assert bundled.count() < len(flat)
    rows = lambda links: sorted(map(tuple, scoring.correlated_entities(scores, links).collect()))
    got = rows(bundled)
    assert got and got == rows(spark.createDataFrame(flat, "a_type string, a_id string, b_type string, b_id string"))
