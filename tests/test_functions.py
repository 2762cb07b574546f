import datetime as dt

from pyspark.sql import functions as F

from fraudspark.functions import dates, numbers, patterns, text
from fraudspark.operators import quality


def values(spark, rows, expr):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_compact_date(spark):
    good = dt.date(2023, 1, 15)
    rows = ["20230115", "20230115.0", "20230229", "JUNE 31", "", None, "18990101", "20230431", "20240229", "nan", "2023-01-15"]
    assert values(spark, rows, dates.compact_date) == [good, good, None, None, None, None, None, None, dt.date(2024, 2, 29), None, None]


def test_portal_date(spark):
    good = dt.date(2023, 1, 5)
    rows = ["01/05/2023", "1/5/2023", "2023-01-05", "1/5/23", "1/5/70", "2/30/2023", "", None, "5 Jan 2023", "1/5/023"]
    assert values(spark, rows, dates.portal_date) == [good] * 4 + [dt.date(1970, 1, 5)] + [None] * 5


def test_normalisation(spark):
    assert values(spark, ["123 Main Street", "123 MAIN STREET.", "45 5th Avenue", "9 Streetwise Rd"], text.normalize_address) == [
        "123mainst", "123mainst", "455thave", "9streetwiserd"]
    assert values(spark, ["Acme Holdings, LLC", "ACME HOLDINGS INC", "Incline Co"], text.normalize_name) == [
        "acmeholdings", "acmeholdings", "inclineco"]
    assert values(spark, ["11001 QUEENS BLVD 11375", "none"], text.zip_in_text) == ["11001", None]
    assert values(spark, ["1 X, BRONX", "NEW YORK", "elsewhere", None], text.borough_in_text) == ["Bronx", "Manhattan", "Unknown", None]
    assert values(spark, ["1", "5", "9"], text.borough_name) == ["Manhattan", "Staten Island", "9"]


def test_numbers(spark):
    assert values(spark, ["12", " 3.5 ", "", "x", None], numbers.to_number) == [12.0, 3.5, None, None, None]
    row = spark.range(1).select(
        numbers.markup(F.lit(100000), F.lit(103000)), numbers.markup(F.lit(0), F.lit(5)),
        numbers.cost_gap(F.lit(50000.0), F.lit(100000.0)), numbers.cost_gap(F.lit(0.0), F.lit(1.0)),
    ).first()
    assert tuple(row) == (0.03, None, 1.0, None)


def test_names_and_lists(spark):
    df = spark.createDataFrame([("", "Al", "Bo"), ("X Corp", "Al", "Bo"), ("", "Al", ""), (None, None, None)], "b string, f string, l string")
    assert [r[0] for r in df.select(text.owner_name(F.col("b"), F.col("f"), F.col("l"))).collect()] == ["Al Bo", "X Corp", None, None]
    assert values(spark, ["a, b ,c"], text.split_list) == [["a", "b", "c"]]
    assert values(spark, ["dob_violations", "ll_permits", "rats", "Complaint_permit"], patterns.dataset_category) == [
        "violations", "permits", "properties", "permits"]
    assert patterns.column_roles("filing_date") == ["temporal"]
    assert "key" in patterns.column_roles("permit_id") and "entity" in patterns.column_roles("owner_name")


def test_profile(spark):
    i = F.col("id")
    permits = spark.range(1000).select(
        F.format_string("P%06d", i).alias("permit_id"), (1000000 + i).cast("string").alias("bin"),
        F.when(i % 10 != 0, F.concat(F.lit("Company "), i % 100)).alias("owner_name"),
        F.concat(F.lit("Contractor "), i % 50).alias("contractor_name"),
        F.element_at(F.array(*map(F.lit, ["ALT1", "NB", "DM", "ALT2"])), (i % 4 + 1).cast("int")).alias("work_type"),
        (10000 + 1000 * i).alias("estimated_cost"), F.date_add(F.lit("2020-01-01").cast("date"), i.cast("int")).alias("filing_date"),
        F.concat((i + 1).cast("string"), F.lit(" Main St, New York, NY")).alias("address"),
    )
    row = quality.dataset_quality(permits, "permits").first()
    assert (row.row_count, row.column_count, row.completeness, row.quality_level, row.duplicate_rows) == (1000, 8, 98.75, "EXCELLENT", 0)
    roles = {r["column"]: r.roles.split(",") for r in quality.column_profile(permits).collect()}
    assert "key" in roles["permit_id"] and "key" in roles["bin"] and "temporal" in roles["filing_date"]
    empty = quality.dataset_quality(permits.filter("false"), "none").first()
    assert empty.row_count == 0 and "Empty dataset" in empty.issues
