"""Nested documents of cases, complaints, permits and building projects.

A document has a name, a description, nested content and a reference date; a date that cannot be
read is NULL with `date_valid` false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.dates import portal_date
from fraudspark.functions.text import borough_name, first_present, join_words
from fraudspark.operators.ordered import running


def _document(df: DataFrame, name: Column, description: Column, content: Column, date: Column) -> DataFrame:
    out = df.select(
        name.alias("name"), description.alias("description"), content.alias("content"), portal_date(date).alias("reference_date")
    )
    return out.withColumn("date_valid", F.col("reference_date").isNotNull())


def litigation_documents(cases: DataFrame) -> DataFrame:
    """One document per housing case."""
    building = F.struct(
        "bin", "bbl", join_words(F.col("house_number"), F.col("street_name")).alias("address"), "house_number",
        "street_name", borough_name(F.col("borough_code")).alias("borough"), "zip_code", "latitude", "longitude",
    )
    content = F.struct(
        "litigation_id", "case_type", "case_status", "open_date", "respondent", "finding_of_harassment", "penalty",
        building.alias("building"),
    )
    return _document(
        cases, F.concat(F.lit("Housing_Litigation_"), "litigation_id"),
        F.concat(F.lit("Housing litigation case "), "case_type"), content, F.col("open_date"),
    )


def complaint_documents(complaints: DataFrame) -> DataFrame:
    building = F.struct(
        "bin", join_words(F.col("house_number"), F.col("street_name")).alias("address"), "house_number", "street_name",
        "zip_code", "community_board",
    )
    content = F.struct(
        "complaint_number", "status", "complaint_category", "unit", "disposition_code", "date_entered",
        "disposition_date", "inspection_date", building.alias("building"),
    )
    return _document(
        complaints, F.concat(F.lit("Complaint_"), "complaint_number"),
        F.concat(F.lit("DOB complaint "), "complaint_category"), content, F.col("date_entered"),
    )


def permit_documents(permits: DataFrame) -> DataFrame:
    """One document per permit; alternative columns fill in for missing ones."""
    number = first_present(F.col("job_number"), F.col("job"))
    kind = first_present(F.col("permit_type"), F.col("job_type"))
    filed = first_present(F.col("filing_date"), F.col("pre_filing_date"))
    details = F.struct(
        number.alias("permit_number"), kind.alias("permit_type"), "work_type", "permit_status", filed.alias("filing_date"),
        "issue_date", "expiration_date", "job_description",
    )
    building = F.struct(
        "bin", "bbl", join_words(F.col("house_number"), F.col("street_name")).alias("address"), "house_number",
        "street_name", borough_name(F.col("borough_code")).alias("borough"), "zip_code",
    )
    applicant = F.struct(
        F.concat_ws(" ", "owner_first_name", "owner_last_name").alias("owner_name"), "owner_business_name", "owner_phone",
        "owner_business_type",
    )
    content = F.struct(details.alias("permit_details"), building.alias("building"), applicant.alias("applicant"))
    return _document(
        permits, F.concat(F.lit("Permit_"), number), F.concat(F.lit("DOB permit filing "), kind), content, filed
    )


# Name of the event a record stands for.
EVENTS = {"permit": "permit_filed", "violation": "violation_issued", "complaint": "complaint_filed"}


# Words of a record's line in the timeline, around its id.
WORDS = {"permit": ("Permit ", " filed for "), "violation": ("Violation ", " for "), "complaint": ("Complaint ", " for ")}


def _union_records(permits: DataFrame, violations: DataFrame, complaints: DataFrame) -> DataFrame:
    union = None
    for kind, df in (("permit", permits), ("violation", violations), ("complaint", complaints)):
        one = df.select("bin", F.lit(kind).alias("kind"), "date", F.col("id").cast("string").alias("id"), F.col("category").cast("string").alias("category"))
        union = one if union is None else union.unionByName(one)
    return union


def _told(records: DataFrame) -> DataFrame:
    """Records with the event that they stand for and their line in the timeline."""
    by_kind = lambda values: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in values.items()])
    head, middle = (by_kind({k: w[i] for k, w in WORDS.items()}) for i in (0, 1))
    details = F.concat(head, "id", middle, "category")
    return records.select("bin", "kind", "date", by_kind(EVENTS).alias("event"), details.alias("details"), "id", "category")


def timeline_rows(permits: DataFrame, violations: DataFrame, complaints: DataFrame) -> DataFrame:
    """(bin, kind, date, event, details, id, category) over three kinds of records.

    permits(bin, id, date, category), and the same for violations and complaints.
    """
    return _told(_union_records(permits, violations, complaints))


def project_records(permits: DataFrame, violations: DataFrame, complaints: DataFrame) -> DataFrame:
    """Records of buildings with permits: one row per record with its `position` in time, undated ones first.

    One form at every size: the records of a building are never put in one row. Their lines are put together
    after the join that deals records by building, so they are neither sent nor stored.
    """
    known = permits.select("bin").filter("bin IS NOT NULL").distinct()
    rows = _told(_union_records(permits, violations, complaints).join(known, "bin", "left_semi"))
    return running(rows, ["bin"], ["date", "event", "details", "id"], sums={"position": F.lit(1).cast("long")})


def project_documents(permits: DataFrame, violations: DataFrame, complaints: DataFrame) -> DataFrame:
    """One document head per building with permits and more than one permit or any other record.

    Its permits, violations, complaints and activity timeline are the rows of `project_records`.
    """
    counts = None
    for kind, df in (("permit", permits), ("violation", violations), ("complaint", complaints)):
        own = df.filter("bin IS NOT NULL").groupBy("bin").agg(
            F.count("*").alias(f"n_{kind}s"), F.min("date").alias(f"first_{kind}"), F.max("date").alias(f"last_{kind}"))
        counts = own if counts is None else counts.join(own, "bin", "left")
    counts = counts.fillna(0, [f"n_{k}s" for k in EVENTS]).filter("n_permits > 1 OR n_violations > 0 OR n_complaints > 0")
    summary = F.format_string(
        "Building %s with %d permits, %d violations, %d complaints", F.col("bin").cast("string"), "n_permits", "n_violations", "n_complaints"
    )
    return counts.select(
        F.concat(F.lit("Building_Project_"), F.col("bin").cast("string")).alias("name"), "bin", summary.alias("project_summary"),
        *[f"n_{k}s" for k in EVENTS], F.least(*[f"first_{k}" for k in EVENTS]).alias("first_date"), F.greatest(*[f"last_{k}" for k in EVENTS]).alias("last_date"),
    )


def project_contents(permits: DataFrame, violations: DataFrame, complaints: DataFrame) -> DataFrame:
    """Whole documents: every record of a building in its place, with the head of the document.

    One row per record, so that a building with any number of records needs no row longer than one record.
    """
    heads = project_documents(permits, violations, complaints)
    return project_records(permits, violations, complaints).join(heads, "bin")
