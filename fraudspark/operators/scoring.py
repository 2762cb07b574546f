"""Rule-based risk scores of entities, and what follows from them.

A rule is (condition, points, text of the factor). A score is the sum of the points of the rules
that hold; it is not capped. Missing numbers read as 0 and missing flags as false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.numbers import ratio
from fraudspark.session import cut_lineage

SCORE_COLUMNS = ["entity_type", "entity_id", "risk_score", "risk_level", "risk_factors", "confidence"]


@dataclass(frozen=True)
class Rule:
    when: Callable[[], Column]
    points: Callable[[], Column]
    factor: Callable[[], Column]


@dataclass(frozen=True)
class Scorer:
    rules: list[Rule]
    factor_weight: float  # confidence gained per factor


def _num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _rule(when, points, *factor) -> Rule:
    """`points` is a number or a column; `factor` pieces are concatenated."""
    as_col = lambda p: F.lit(p) if isinstance(p, (int, float, str)) else p()
    return Rule(when, lambda: as_col(points).cast("double"), lambda: F.concat(*[as_col(f) for f in factor]))


def _over(name: str, limit: float):
    return lambda: _num(name) > limit


def _capped(name: str, factor: float, cap: float):
    return lambda: F.least(_num(name) * factor, F.lit(float(cap)))


def _percent(value: Callable[[], Column]):
    return lambda: F.format_string("%.1f%%", value() * 100)


def _cost_ratio() -> Column:
    est, act = _num("estimated_cost"), _num("actual_cost")
    return F.when((est > 0) & (act > 0), F.abs(act - est) / est)


# The rules of each entity type.
SCORERS: dict[str, Scorer] = {
    "person": Scorer([
        _rule(lambda: F.coalesce(F.col("license_status").isin("EXPIRED", "SUSPENDED", "REVOKED"), F.lit(False)), 25,
              "License status: ", lambda: F.col("license_status")),
        _rule(_over("violation_count", 5), _capped("violation_count", 3, 30),
              "High violation count: ", lambda: _text("violation_count")),
        _rule(_over("recent_job_count", 20), 20,
              "Unusually high recent job activity: ", lambda: _text("recent_job_count")),
        _rule(_over("address_inconsistencies", 2), 15, "Multiple address inconsistencies"),
        _rule(lambda: _flag("payment_issues"), 20, "Payment processing issues"),
    ], 0.2),
    "property": Scorer([
        _rule(_over("permit_count_6months", 10), _capped("permit_count_6months", 2, 25),
              "High permit activity: ", lambda: _text("permit_count_6months"), " in 6 months"),
        _rule(_over("violations_per_sqft", 0.01), 20,
              "High violation density: ", lambda: _text("violations_per_sqft")),
        _rule(_over("ownership_changes_2years", 3), 15,
              "Frequent ownership changes: ", lambda: _text("ownership_changes_2years")),
        _rule(_over("zoning_violations", 2), 20, "Multiple zoning violations"),
        _rule(_over("emergency_orders", 0), 30, "Emergency orders issued"),
    ], 0.25),
    "job": Scorer([
        _rule(lambda: F.coalesce(_cost_ratio() > 0.5, F.lit(False)), 25,
              "Large cost discrepancy: ", _percent(_cost_ratio)),
        _rule(_over("timeline_violations", 2), 20, "Multiple timeline violations"),
        _rule(_over("failed_inspections", 3), _capped("failed_inspections", 5, 25),
              "High inspection failure rate: ", lambda: _text("failed_inspections")),
        _rule(_over("unlicensed_work_indicators", 1), 30, "Indicators of unlicensed work"),
        _rule(lambda: _flag("rapid_permit_cycling"), 20, "Rapid permit cycling detected"),
    ], 0.2),
    "violation": Scorer([
        _rule(_over("severity_score", 7), lambda: _num("severity_score") * 3,
              "High severity violations: ", lambda: _text("severity_score")),
        _rule(_over("repeat_violation_count", 2), _capped("repeat_violation_count", 8, 30),
              "Repeat violations: ", lambda: _text("repeat_violation_count")),
        _rule(_over("non_compliance_days", 90), 25, "Extended non-compliance period"),
        _rule(lambda: _flag("fine_evasion_indicators"), 20, "Fine evasion indicators"),
        _rule(_over("safety_violations", 1), 25, "Multiple safety violations"),
    ], 0.25),
    "inspection": Scorer([
        _rule(_over("inspection_failure_rate", 0.4), lambda: _num("inspection_failure_rate") * 30,
              "High inspection failure rate: ", _percent(lambda: _num("inspection_failure_rate"))),
        _rule(_over("inspection_avoidance_indicators", 2), 25, "Inspection avoidance patterns"),
        _rule(lambda: _flag("document_fraud_indicators"), 35, "Fraudulent documentation indicators"),
        _rule(_over("inspector_red_flags", 1), 20, "Inspector red flags raised"),
        _rule(_over("compliance_gaming_score", 5), 15, "Compliance gaming detected"),
    ], 0.2),
    "financial": Scorer([
        _rule(_over("payment_irregularities", 2), 25, "Multiple payment irregularities"),
        _rule(_over("unpaid_fees_amount", 10_000), lambda: F.least(_num("unpaid_fees_amount") / 1000, F.lit(30.0)),
              lambda: F.format_string("High unpaid fees: $%,.2f", _num("unpaid_fees_amount"))),
        _rule(lambda: _flag("financial_document_fraud"), 40, "Financial document fraud indicators"),
        _rule(_over("money_laundering_score", 6), 35, "Money laundering indicators"),
        _rule(_over("tax_evasion_indicators", 1), 20, "Tax evasion patterns"),
    ], 0.3),
}

# Lower ends of the risk levels.
RISK_LEVELS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")]


def risk_level(score: Column) -> Column:
    ladder = None
    for low, name in RISK_LEVELS:
        ladder = F.when(score >= low, name) if ladder is None else ladder.when(score >= low, name)
    return ladder.otherwise("LOW")


#: Columns that the rules read; an absent one counts as 0 or false.
FEATURES = {
    "person": {"license_status": "string", "violation_count": "long", "recent_job_count": "long", "address_inconsistencies": "long",
               "payment_issues": "boolean"},
    "property": {"permit_count_6months": "long", "violations_per_sqft": "double", "ownership_changes_2years": "long",
                 "zoning_violations": "long", "emergency_orders": "long"},
    "job": {"estimated_cost": "double", "actual_cost": "double", "timeline_violations": "long", "failed_inspections": "long",
            "unlicensed_work_indicators": "long", "rapid_permit_cycling": "boolean"},
    "violation": {"severity_score": "long", "repeat_violation_count": "long", "non_compliance_days": "long",
                  "fine_evasion_indicators": "boolean", "safety_violations": "long"},
    "inspection": {"inspection_failure_rate": "double", "inspection_avoidance_indicators": "long", "document_fraud_indicators": "boolean",
                   "inspector_red_flags": "long", "compliance_gaming_score": "long"},
    "financial": {"payment_irregularities": "long", "unpaid_fees_amount": "double", "financial_document_fraud": "boolean",
                  "money_laundering_score": "long", "tax_evasion_indicators": "long"},
}


def confidence(factors: Column, weight: float) -> Column:
    return F.round(F.least(F.size(factors) * F.lit(weight), F.lit(1.0)), 4)


def score(features: DataFrame, entity_type: str, entity_id: str = "id") -> DataFrame:
    """Scores of one entity type; an unknown type scores 0 and LOW."""
    scorer = SCORERS.get(entity_type)
    named = [F.col(c).cast("string") for c in dict.fromkeys((entity_id, "entity_id")) if c in features.columns]
    who = F.coalesce(*named, F.lit("unknown"))
    features = features.withColumns({
        name: F.lit(None).cast(kind) for name, kind in FEATURES.get(entity_type, {}).items() if name not in features.columns})
    base = [F.lit(entity_type).alias("entity_type"), who.alias("entity_id")]
    if scorer is None:
        return features.select(
            *base, F.lit(0.0).alias("risk_score"), F.lit("LOW").alias("risk_level"),
            F.array().cast("array<string>").alias("risk_factors"), F.lit(0.0).alias("confidence"),
        )
    points = [F.when(r.when(), r.points()).otherwise(0.0) for r in scorer.rules]
    factors = F.array_compact(F.array(*[F.when(r.when(), r.factor()) for r in scorer.rules]))
    scored = features.select(
        *base, reduce(lambda a, b: a + b, points).alias("risk_score"), factors.alias("risk_factors")
    )
    return scored.select(
        "entity_type", "entity_id", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"),
        "risk_factors", confidence(F.col("risk_factors"), scorer.factor_weight).alias("confidence"),
    )


def score_all(features: dict[str, DataFrame], entity_id: str = "id") -> DataFrame:
    """One score table over several entity types."""
    return reduce(DataFrame.unionByName, [score(df, kind, entity_id) for kind, df in features.items()])


def score_mixed(entities: DataFrame, entity_id: str = "id") -> DataFrame:
    """Scores of one table with an `entity_type` column and the features of all types."""
    known = list(SCORERS)
    parts = [score(entities.filter(F.col("entity_type") == k), k, entity_id) for k in known]
    others = entities.filter(~F.coalesce(F.col("entity_type").isin(known), F.lit(False)))
    kind = F.coalesce("entity_type", F.lit("unknown"))
    rest = others.select(kind.alias("entity_type"), F.coalesce(F.col(entity_id).cast("string"), F.lit("unknown")).alias("entity_id"))
    rest = rest.select(
        "entity_type", "entity_id", F.lit(0.0).alias("risk_score"), F.lit("LOW").alias("risk_level"),
        F.array().cast("array<string>").alias("risk_factors"), F.lit(0.0).alias("confidence"),
    )
    return reduce(DataFrame.unionByName, [*parts, rest])


def composite(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of score x confidence over the number of entities, at most 100; overall or per case."""
    keys = keys or []
    out = scores.groupBy(*keys).agg(
        F.count("*").alias("entities"),
        F.least(F.sum(F.col("risk_score") * F.col("confidence")) / F.count("*"), F.lit(100.0)).alias("_c"),
        F.count_if(F.col("risk_score") > 60).alias("high_risk_entities"),
    )
    rounded = F.round("_c", 2)
    return out.select(
        *keys, "entities", "high_risk_entities", rounded.alias("composite_score"),
        risk_level(F.col("_c")).alias("composite_level"),
    )


# Recommendations above a composite score.
RECOMMENDATIONS = [
    (75, [
        "IMMEDIATE ACTION: Suspend all active permits and licenses",
        "Initiate comprehensive fraud investigation",
        "Coordinate with law enforcement agencies",
        "Freeze all financial transactions pending investigation",
    ]),
    (50, [
        "Conduct priority investigation within 48 hours",
        "Implement enhanced monitoring protocols",
        "Require additional documentation for all transactions",
        "Schedule comprehensive audit of all related activities",
    ]),
    (25, [
        "Schedule routine investigation within 2 weeks",
        "Increase inspection frequency",
        "Verify compliance with all regulations",
        "Monitor for pattern escalation",
    ]),
]


def recommendations(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Composite scores with what to do about them; `focus_entities` names the high-risk entities."""
    keys = keys or []
    composites = composite(scores, keys)
    ladder = None
    for low, texts in RECOMMENDATIONS:
        hit, value = F.col("composite_score") > low, F.array(*[F.lit(t) for t in texts])
        ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
    general = ladder.otherwise(F.array().cast("array<string>"))
    focus = F.when(F.col("high_risk_entities") > 0, "Focus investigation on high-risk entities")
    return composites.withColumn("recommendations", F.array_compact(F.concat(general, F.array(focus))))


def focus_entities(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, entity_type, entity_id, risk_score): the high-risk entities behind each case of `recommendations`."""
    return high_risk(scores).select(*(keys or []), "entity_type", "entity_id", "risk_score")


def high_risk(scores: DataFrame, *, above: float = 60) -> DataFrame:
    return scores.filter(F.col("risk_score") > above)


# --- properties and buildings -----------------------------------------------------------------

def building_risk(violations: DataFrame, complaints: DataFrame) -> DataFrame:
    """Per BIN: min(1, 0.1 x violations + 0.05 x complaints) and a level."""
    v = violations.groupBy("bin").agg(F.count("*").alias("violation_count"))
    c = complaints.groupBy("bin").agg(F.count("*").alias("complaint_count"))
    both = v.join(c, "bin", "full_outer").fillna(0)
    raw = F.col("violation_count") * 0.1 + F.col("complaint_count") * 0.05
    out = both.withColumn("risk_score", F.round(F.least(F.lit(1.0), raw), 4))
    s = F.col("risk_score")
    level = F.when(s >= 0.8, "critical").when(s >= 0.5, "high").when(s >= 0.2, "medium").otherwise("low")
    return out.withColumn("risk_level", level)


def property_scores(violations: DataFrame, *, top: int = 50) -> DataFrame:
    """0.3 x violations + 0.7 x distinct types over the properties with most violations."""
    per_type = violations.groupBy("bin", "violation_type").agg(F.count("*").alias("n"))
    out = per_type.groupBy("bin").agg(F.sum("n").alias("violation_count"), F.count("violation_type").alias("n_types"))
    top_rows = out.orderBy(F.desc("violation_count"), "bin").limit(top)
    return top_rows.withColumn("fraud_score", F.round(F.col("violation_count") * 0.3 + F.col("n_types") * 0.7, 2))


# --- communities ------------------------------------------------------------------------------

def community_indicators(members: DataFrame) -> DataFrame:
    """Indicators of each community of members(community_id, node_id, node_type)."""
    kind = F.col("node_type")
    counts = members.groupBy("community_id").agg(
        F.count("*").alias("size"), F.count_if(kind == "contractor").alias("contractors"),
        F.count_if(kind == "permit").alias("permits"), F.count_if(kind == "violation").alias("violations"),
        F.count_if(kind == "property").alias("properties"),
    )
    indicators = F.array_compact(F.array(
        F.when((F.col("contractors") == 1) & (F.col("permits") > 5), "single_contractor_multiple_permits"),
        F.when((F.col("permits") > 0) & (F.col("violations") > 0), "permit_violation_correlation"),
        F.when(F.col("properties") > F.col("size") * 0.3, "high_property_concentration"),
    ))
    return counts.withColumn("indicators", indicators)


def community_risk(indicators: Column, size: Column) -> Column:
    points = F.size(indicators) + F.when(size > 10, 1).otherwise(0) + F.when(size > 20, 1).otherwise(0)
    return (
        F.when(points >= 4, "critical").when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")
    )


def oversized_communities(members: DataFrame, *, share: float = 0.8) -> DataFrame:
    """Communities larger than a share of the largest one."""
    sizes = members.groupBy("community_id").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max("size")).scalar()
    return sizes.filter(F.col("size") > largest * share)


def narrow_communities(members: DataFrame) -> DataFrame:
    """Communities of more than two properties with at most two violation types."""
    kind = F.col("node_type")
    counts = members.groupBy("community_id").agg(
        F.count_if(kind == "property").alias("properties"), F.count_if(kind == "violation_type").alias("types")
    )
    return counts.filter("properties > 2 AND types <= 2")


# --- links between scored entities ------------------------------------------------------------

# Weight of a link between two entity types.
LINK_WEIGHTS = {
    ("person", "property"): 0.8,
    ("person", "job"): 0.9,
    ("person", "violation"): 0.85,
    ("person", "inspection"): 0.7,
    ("person", "financial"): 0.95,
    ("property", "job"): 0.9,
    ("property", "violation"): 0.85,
    ("property", "inspection"): 0.8,
    ("property", "financial"): 0.75,
    ("job", "violation"): 0.9,
    ("job", "inspection"): 0.85,
    ("job", "financial"): 0.9,
    ("violation", "inspection"): 0.8,
    ("violation", "financial"): 0.85,
    ("inspection", "financial"): 0.7,
}


#: Types by how few links one entity has: links are dealt by their end that comes first here. Only those of a person to
#: financial entities are dealt by an end that may be hot.
_FEW_LINKS = ["job", "violation", "inspection", "property", "person", "financial"]

#: Scores for each task in which links meet the first of their ends.
SCORES_A_TASK = 250_000


def correlated_entities(scores: DataFrame, links: DataFrame, *, at_least: float = 0.3) -> DataFrame:
    """Linked scored entities: strength = type weight x the smaller confidence.

    links(a_type, a_id, b_type, b_id) in the type order of LINK_WEIGHTS, or `bundled_links`. `combined_risk` is the
    larger score raised by the strength. Links cross the network once to drop repeats and meet the scores of
    their end with few links, and once more, if its confidence is enough, to meet the other.
    """
    weights = F.create_map(*[
        F.lit(x) for (a, b), w in LINK_WEIGHTS.items() for x in (f"{a}|{b}", w)
    ])
    weight = F.when(F.col("turned"), weights[F.concat_ws("|", "far_type", "near_type")]).otherwise(
        weights[F.concat_ws("|", "near_type", "far_type")])
    strength = lambda confidence: F.round(weight * confidence, 6)
    some = F.round(F.lit(max(LINK_WEIGHTS.values())) * F.col("confidence"), 6) >= at_least
    # The last type is never the near end of a link between two types, and the first never the far one.
    never = {"near": _FEW_LINKS[-1], "far": _FEW_LINKS[0]}
    side = lambda s: scores.filter(some & (F.col("entity_type") != never[s])).select(
        F.col("entity_type").alias(f"{s}_type"), F.col("entity_id").alias(f"{s}_id"),
        F.col("risk_score").alias(f"{s}_score"), F.col("confidence").alias(f"{s}_conf"),
    )
    place = lambda c: F.array_position(F.array(*map(F.lit, _FEW_LINKS)), F.col(c))
    # As many tasks as the rows need, so that a task's memory does not grow with the table.
    tasks = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), scores.count() // SCORES_A_TASK)
    if "others" in links.columns:
        dealt = _unbundled(links, tasks)
    else:
        turned = place("b_type") < place("a_type")
        ends = [F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)).alias(name) for name, x, y in (
            ("near_type", "a_type", "b_type"), ("near_id", "a_id", "b_id"), ("far_type", "b_type", "a_type"), ("far_id", "b_id", "a_id"))]
        dealt = links.withColumn("turned", turned).select("turned", *ends).repartition(tasks, "near_type", "near_id")
    joined = dealt.distinct().join(side("near"), ["near_type", "near_id"]).filter(strength(F.col("near_conf")) >= at_least)
    # Stored, so that what was shuffled up to here is gone before the links travel again.
    joined = cut_lineage(joined, "near").join(side("far"), ["far_type", "far_id"])
    joined = joined.withColumn("strength", strength(F.least("near_conf", "far_conf"))).filter(F.col("strength") >= at_least)
    end = lambda x, y, name: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)).alias(name)
    return joined.select(
        end("near_type", "far_type", "a_type"), end("near_id", "far_id", "a_id"), end("far_type", "near_type", "b_type"),
        end("far_id", "near_id", "b_id"), "strength",
        F.round(F.greatest("near_score", "far_score") * (1 + F.col("strength")), 4).alias("combined_risk"),
    )


def bundled_links(records: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The links between the ids of a record, as one row for each end that they are dealt by.

    `records` has a column of ids for each type; `pairs` are the pairs of types that are linked. A row names the
    end and the ids of all it is linked to, so an id that is long travels once and not once for each link.
    """
    near_of = lambda pair: min(pair, key=_FEW_LINKS.index)
    bundles = []
    for near in dict.fromkeys(map(near_of, pairs)):
        far = {t for p in pairs if near_of(p) == near for t in p if t != near}
        ids = [(F.col(t) if t in far else F.lit(None).cast("string")).alias(t) for t in _FEW_LINKS]
        bundles.append(F.struct(F.lit(near).alias("near_type"), F.col(near).alias("near_id"), F.struct(*ids).alias("others")))
    rows = records.select(F.explode(F.array(*bundles)).alias("x")).select("x.*")
    return rows.filter(F.col("near_id").isNotNull() & F.coalesce(*[F.col(f"others.{t}") for t in _FEW_LINKS]).isNotNull())


def _unbundled(links: DataFrame, tasks: int) -> DataFrame:
    """(turned, near_type, near_id, far_type, far_id), taken apart where the near ends are."""
    order = list(dict.fromkeys(t for pair in LINK_WEIGHTS for t in pair))
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    ends = F.explode(F.array(*[F.struct(F.lit(t).alias("far_type"), F.col(f"others.{t}").alias("far_id")) for t in _FEW_LINKS])).alias("x")
    apart = links.repartition(tasks, "near_type", "near_id").select("near_type", "near_id", ends).select("near_type", "near_id", "x.*")
    return apart.filter("far_id IS NOT NULL").select((place("far_type") < place("near_type")).alias("turned"), "*")


def fraud_networks(components: DataFrame, scores: DataFrame, *, at_least: int = 3) -> DataFrame:
    """Connected scored entities: size, mean risk, high-risk members and types.

    components(component, entity_type, entity_id).
    """
    joined = components.join(scores, ["entity_type", "entity_id"])
    return joined.groupBy("component").agg(
        F.count("*").alias("size"), F.round(F.avg("risk_score"), 4).alias("mean_risk"),
        F.max("risk_score").alias("max_risk"), F.count_if(F.col("risk_score") > 60).alias("high_risk"),
        F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
    ).filter(F.col("size") >= at_least)


# --- features ---------------------------------------------------------------------------------

def payment_features(facts: DataFrame, key: str) -> DataFrame:
    """Rates per entity over facts(dismissed, paid, imposed, inspected, estimated, actual)."""
    sums = facts.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.col("dismissed").cast("long")).alias("d"),
        F.sum("paid").alias("p"), F.sum("imposed").alias("i"), F.sum(F.col("inspected").cast("long")).alias("ins"),
        F.sum("estimated").alias("e"), F.sum("actual").alias("a"),
    )
    return sums.select(
        key, F.round(ratio(F.col("d"), F.col("n")), 6).alias("dismissal_rate"),
        F.round(ratio(F.col("p"), F.col("i")), 6).alias("payment_rate"),
        F.round(ratio(F.col("ins"), F.col("n")), 6).alias("inspection_rate"),
        F.round(ratio(F.col("a") - F.col("e"), F.col("e")), 6).alias("value_gap"),
    )


def contractor_summary(jobs: DataFrame, violations: DataFrame, communities: DataFrame, active: Column) -> DataFrame:
    """Permits, active permits, buildings, violation rate and community per contractor."""
    per_bin = jobs.groupBy("contractor_id", "bin").agg(F.count("*").alias("n"), F.count_if(active).alias("a"))
    work = per_bin.groupBy("contractor_id").agg(
        F.sum("n").alias("permits"), F.sum("a").alias("active_permits"), F.count("*").alias("buildings")
    )
    fined = violations.groupBy(F.col("respondent_id").alias("contractor_id")).agg(F.count("*").alias("violations"))
    joined = work.join(fined, "contractor_id", "left").join(communities, "contractor_id", "left").fillna(0, ["violations"])
    return joined.withColumn("violation_rate", F.round(ratio(F.col("violations"), F.col("permits")), 6))


# --- alerts -----------------------------------------------------------------------------------

def alert_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def create_alerts(scores: DataFrame, created_at: Column, *, from_level: str = "HIGH") -> DataFrame:
    """An ACTIVE alert for every score at or above a level; the same score gives the same id."""
    lowest = dict((n, low) for low, n in RISK_LEVELS)[from_level]
    return scores.filter(F.col("risk_score") >= lowest).select(
        alert_id(F.col("entity_type"), F.col("entity_id"), F.col("risk_score").cast("string")).alias("alert_id"),
        F.col("risk_level").alias("severity"),
        F.array(F.concat_ws(":", "entity_type", "entity_id")).alias("entities"),
        F.col("risk_score").alias("score"), "risk_factors", created_at.alias("created_at"),
        F.lit("ACTIVE").alias("status"),
    )


ALERT_STATUSES = ["ACTIVE", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE"]


def current_status(changes: DataFrame) -> DataFrame:
    """The latest status of each alert, from an append-only log(alert_id, status, changed_at, change_id)."""
    valid = changes.filter(F.col("status").isin(ALERT_STATUSES))
    position = F.struct("changed_at", "change_id")
    return valid.groupBy("alert_id").agg(
        F.max_by("status", position).alias("status"), F.max("changed_at").alias("changed_at"),
        F.count("*").alias("n_changes"),
    )
