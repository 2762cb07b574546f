"""Counts, distributions and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.numbers import ratio
from fraudspark.operators.ordered import quantiles


def value_counts(df: DataFrame, column: str, *, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top is not None else counts


def groups_above(df: DataFrame, column: str, above: int) -> DataFrame:
    return value_counts(df, column).filter(F.col("n") > above)


def top_or_other(df: DataFrame, column: str, *, top: int = 10, other: str = "Other") -> DataFrame:
    """Replace values outside the `top` most frequent ones."""
    kept = value_counts(df, column, top=top).select(column, F.col(column).alias("_kept"))
    # The kept table has `top` rows at most.
    marked = df.join(F.broadcast(kept), column, "left")
    return marked.withColumn(column, F.coalesce("_kept", F.lit(other))).drop("_kept")


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, total): rows of each table."""
    out = None
    for label, df in tables.items():
        one = df.agg(F.count("*").alias("total")).select(F.lit(label).alias("label"), "total")
        out = one if out is None else out.unionByName(one)
    return out


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, correlation) for all pairs, from one pass over the data."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{a}|{b}`").alias("correlation"))
        for a, b in pairs
    ])
    return row.select(F.inline(entries))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, start, n): equal-width buckets 1..bins; 0 and bins + 1 hold what lies outside."""
    width = (high - low) / bins
    buckets = df.filter(F.col(column).isNotNull()).select(
        F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bucket")
    )
    counted = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    return counted.withColumn("start", F.lit(float(low)) + (F.col("bucket") - 1) * width)


def box_statistics(df: DataFrame, column: str, keys: Sequence[str] = (), *, accuracy: int | None = None) -> DataFrame:
    """Minimum, quartiles and maximum; exact, or approximate in one pass with an `accuracy`."""
    cuts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    value, keys = F.col(column).cast("double"), list(keys)
    ends = [F.min(value).alias("low"), F.max(value).alias("high")]
    if accuracy:
        box = df.groupBy(*keys).agg(*ends, F.percentile_approx(value, list(cuts.values()), accuracy).alias("_q"))
        return box.select(*keys, "low", *[F.col("_q")[i].alias(n) for i, n in enumerate(cuts)], "high")
    return quantiles(df, keys, column, cuts, ends=True).select(*keys, "low", *cuts, "high")


def series(df: DataFrame, ts: str, value: str, unit: str = "day") -> DataFrame:
    """Mean value per time unit; unparseable times are left out."""
    when = F.col(ts).try_cast("timestamp")
    dated = df.select(F.date_trunc(unit, when).cast("date").alias("period"), F.col(value).alias("v"))
    return dated.filter("period IS NOT NULL").groupBy("period").agg(
        F.avg("v").alias("mean_value"), F.count("*").alias("n")
    )


def alert_report(alerts: DataFrame, patterns: Sequence[str], *, high_above: float = 0.8) -> DataFrame:
    """Per pattern: alerts, mean risk, high-risk alerts; listed patterns without alerts give zeros, others are reported too."""
    spark = alerts.sparkSession
    names = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = alerts.groupBy("pattern").agg(
        F.count("*").alias("n_alerts"),
        F.avg("risk_score").alias("mean_risk"),
        F.count_if(F.col("risk_score") > high_above).alias("high_risk"),
    )
    return names.join(found, "pattern", "full_outer").fillna(0, ["n_alerts", "mean_risk", "high_risk"])


def monitoring_history(alerts: DataFrame, start, end, *, high_above: float = 60) -> DataFrame:
    """Per severity between two times: alerts, mean score, scores above `high_above`."""
    inside = alerts.filter(F.col("created_at").between(F.lit(start), F.lit(end)))
    return inside.groupBy("severity").agg(
        F.count("*").alias("n_alerts"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.count_if(F.col("score") > high_above).alias("high_risk"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], *, error: float | None = None) -> DataFrame:
    """(column, n_distinct): exact, or approximate with a relative `error`."""
    if error is not None:
        row = df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in columns])
        return row.unpivot([], columns, "column", "n_distinct")
    # One shuffle by (column, value) instead of copying each row once per counted column.
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.countDistinct("value").alias("n_distinct"))


# Error of a sketch with 2^LG_K registers; three times that is met by 997 of 1000 counts.
LG_K = 14
SKETCH_ERROR = 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, column, sketch): distinct values of each column in each part of the data, as mergeable sketches.

    Stored once for each day or file, they answer for any union of parts without reading the data again.
    """
    values = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(*by, F.explode(F.array(*values)).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "column").agg(F.hll_sketch_agg("value", LG_K).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n_distinct): estimates for the union of all sketches of a group.

    A sketch that saw its values one by one estimates from their order, one that was merged from its registers
    alone. Each is merged with itself, so equal values give the same number however they were dealt.
    """
    union = sketches.groupBy(*by, "column").agg(F.hll_union_agg("sketch").alias("sketch"))
    return union.select(*by, "column", F.hll_sketch_estimate(F.hll_union("sketch", "sketch")).alias("n_distinct"))


def community_summary(communities: DataFrame) -> DataFrame:
    """Totals over communities with a `risk_level`, and the overall level."""
    out = communities.agg(
        F.count("*").alias("total_communities"),
        F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_communities"),
    )
    high = F.col("high_risk_communities")
    return out.select(
        "*",
        F.when(high > 5, "HIGH").when(high > 0, "MEDIUM").otherwise("LOW").alias("overall_risk_level"),
        (high > 3).alias("requires_investigation"),
    )


def share_of_total(counts: DataFrame, column: str) -> DataFrame:
    total = counts.agg(F.sum(column)).scalar()
    return counts.withColumn("share", ratio(F.col(column), total))
