"""Profiles and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudspark.functions.numbers import ratio
from fraudspark.functions.patterns import column_roles
from fraudspark.operators.ordered import quantiles
from fraudspark.session import cut_lineage


def quality_level(completeness: Column) -> Column:
    return (
        F.when(completeness >= 95, "EXCELLENT").when(completeness >= 85, "GOOD")
        .when(completeness >= 70, "FAIR").otherwise("POOR")
    )


def dataset_quality(df: DataFrame, name: str) -> DataFrame:
    """One row: size, completeness, duplicates, level and issues of a table."""
    columns = df.columns
    # Equal rows are counted together first, so one pass gives NULLs and duplicates.
    groups = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    nulls = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in columns), F.lit(0))
    sums = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("_distinct"),
        F.coalesce(F.sum(nulls * F.col("_n")), F.lit(0)).alias("null_cells"),
    )
    cells = F.col("row_count") * len(columns)
    missing = F.coalesce(ratio(F.col("null_cells"), cells) * 100, F.lit(0.0))
    out = sums.select(
        F.lit(name).alias("dataset"), "row_count", F.lit(len(columns)).cast("bigint").alias("column_count"),
        "null_cells", (F.col("row_count") - F.col("_distinct")).alias("duplicate_rows"),
        F.round(missing, 4).alias("missing_percentage"), F.round(100 - missing, 4).alias("completeness"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("row_count") == 0, "Empty dataset"),
        F.when(F.col("missing_percentage") > 20, F.format_string("High missing data: %.1f%%", "missing_percentage")),
        F.when(F.col("duplicate_rows") > 0, F.format_string("Duplicate rows found: %,d", "duplicate_rows")),
    ))
    return out.withColumn("quality_level", quality_level(F.col("completeness"))).withColumn("issues", issues)


def overall_quality(qualities: DataFrame) -> DataFrame:
    out = qualities.agg(
        F.count("*").alias("datasets"), F.sum("row_count").alias("total_rows"),
        F.round(F.avg("completeness"), 4).alias("mean_completeness"),
    )
    level = F.lower(quality_level(F.col("mean_completeness")))
    return out.withColumn("overall_quality", F.when(F.col("datasets") == 0, "unknown").otherwise(level))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, NULLs, distinct values, the three smallest values, roles."""
    names = df.columns
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    values = texts.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    # Values are distinct here, so the three smallest are found by three cheap minimums.
    stats = values.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min("value").alias("v1"),
    )
    for prev, cur in (("v1", "v2"), ("v2", "v3")):
        # `stats` has one row per column of the table.
        above = values.join(F.broadcast(stats.select("column", prev)), "column").filter(F.col("value") > F.col(prev))
        stats = stats.join(above.groupBy("column").agg(F.min("value").alias(cur)), "column", "left")
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    roles = F.create_map(*[F.lit(x) for c in names for x in (c, ",".join(column_roles(c)))])
    return stats.select(
        "column", kinds[F.col("column")].alias("type"), "null_count",
        F.round(F.coalesce(ratio(F.col("null_count"), F.col("row_count")) * 100, F.lit(0.0)), 2).alias("null_percentage"),
        "distinct_count", F.array_compact(F.array("v1", "v2", "v3")).alias("samples"),
        roles[F.col("column")].alias("roles"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)][:limit]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, mean, std, low, high, median) of the numeric columns."""
    columns = list(columns or numeric_columns(df))
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = cut_lineage(numbers.unpivot([], columns, "column", "value"), "numbers")
    moments = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )
    return moments.join(quantiles(long, ["column"], "value", {"median": 0.5}, stored=True), "column", "left")


def categorical_summary(df: DataFrame, *, top: int = 5, max_columns: int = 10) -> DataFrame:
    """The most common values of the first text columns, with distinct and NULL counts."""
    columns = text_columns(df, max_columns)
    long = df.select(*columns).unpivot([], columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(
        F.count("value").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # The rank limit is applied in each task before rows of a column meet.
    best = counts.filter("value IS NOT NULL").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    # `totals` has one row per column of the table.
    return best.join(F.broadcast(totals), "column").select("column", "place", "value", "n", "distinct_count", "null_count")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_bin(df: DataFrame, column: str = "bin") -> DataFrame:
    text = F.trim(F.col(column).cast("string"))
    bad = text.isNull() | text.isin("", "0")
    return df.filter(bad).withColumn("issue_type", F.lit("missing_bin"))


def suspicious_address(df: DataFrame, column: str = "address") -> DataFrame:
    """Post-office boxes, general delivery, and very short addresses."""
    address = F.col(column)
    bad = address.rlike(r"P\.?O\.? BOX") | address.contains("GENERAL DELIVERY") | (F.length(address) < 10)
    return df.filter(bad).withColumn("issue_type", F.lit("suspicious_address"))


def invalid_license(df: DataFrame, column: str = "license") -> DataFrame:
    text = F.trim(F.col(column).cast("string"))
    bad = text.isNull() | text.isin("", "0")
    return df.filter(bad).withColumn("issue_type", F.lit("invalid_license"))


def coverage(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(entity_type, field, total, filled): how far normalised fields are filled."""
    union = None
    for kind, df in tables.items():
        fields = list(columns[kind])
        row = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in fields])
        long = row.unpivot(["total"], fields, "field", "filled")
        one = long.select(F.lit(kind).alias("entity_type"), "field", "total", "filled")
        union = one if union is None else union.unionByName(one)
    return union


def temporal_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    dates = df.select(*[F.col(c).cast("date").alias(c) for c in columns])
    long = dates.unpivot([], list(columns), "column", "value")
    return long.groupBy("column").agg(F.min("value").alias("first_day"), F.max("value").alias("last_day"))


def entity_profile(datasets: dict[str, tuple[DataFrame, str]], entity_type: str) -> DataFrame:
    """Totals, distinct, duplicate rate, completeness and rows per dataset of one entity."""
    union = None
    for name, (df, column) in datasets.items():
        one = df.select(F.lit(name).alias("dataset"), F.col(column).cast("string").alias("value"))
        union = one if union is None else union.unionByName(one)
    per_value = union.groupBy("dataset", "value").agg(F.count("*").alias("n"))
    out = per_value.groupBy("dataset").agg(
        F.sum("n").alias("total"), F.count("value").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
    )
    return out.select(
        F.lit(entity_type).alias("entity_type"), "dataset", "total", "unique_values",
        F.round(ratio(F.col("filled") - F.col("unique_values"), F.col("filled")), 6).alias("duplicate_rate"),
        F.round(ratio(F.col("filled"), F.col("total")) * 100, 4).alias("completeness"),
    )


def numeric_outliers(df: DataFrame, column: str, *, deviations: float = 3.0) -> DataFrame:
    """Rows further than some standard deviations from the mean."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev(column).alias("s"))
    score = ratio(F.col(column) - stats.select("m").scalar(), stats.select("s").scalar())
    return df.withColumn("z_score", score).filter(F.abs("z_score") > deviations)


def future_dates(df: DataFrame, column: str, today: str) -> DataFrame:
    return df.filter(F.col(column) > F.lit(today).cast("date"))


def rare_values(df: DataFrame, column: str, *, below: float) -> DataFrame:
    """Values with less than a share of the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", ratio(F.col("n"), total)).filter(F.col("share") < below)
